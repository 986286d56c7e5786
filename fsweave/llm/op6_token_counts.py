"""Token counts from a two-tier table of pre-token lengths, without a shuffle of pre-tokens."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

#: Entries of the broadcast tier (at most), of each task's report, and of a worker's cache; characters of a unit beyond which it is in none of them.
FREQUENT, REPORT, CACHE, LONG = 65_536, 8_192, 400_000, 64
_SPACED = re.compile(r" +[^ ]*")


def pre_tokens(text: str) -> list[str]:
    """Units between which the piece model merges nothing.

    The model writes each space as a mark and puts one mark in front of the text.
    No piece has a mark after another character, and none has a line feed in it.
    So a text parts before each run of marks and before each line feed.  A unit is
    named by what follows its single mark; one that starts with a line feed has
    none; one with a longer run keeps the further marks as leading spaces.
    """
    text = text.replace("\u2581", " ")
    if "  " not in text and not text.startswith(" "):
        return text.replace("\n", " \n").split(" ")
    out = []
    for unit in _SPACED.findall(" " + text):
        head, *rest = unit[1:].split("\n")
        out.append(head)
        out += ["\n" + x for x in rest]
    return out


class PieceLengths(dict):
    """unit -> number of tokens: the broadcast tier, then a bounded cache of encoded misses."""

    def __init__(self, model_file: str, frequent: dict[str, int] | None = None):
        import sentencepiece

        super().__init__(frequent or {})
        self.frequent = frequent or {}
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)

    def __missing__(self, unit: str) -> int:
        if not unit:
            n = 1
        else:
            n = len(self.model.encode(unit, num_threads=1)) - (unit[0] == "\n")
        if len(unit) <= LONG:
            self[unit] = n
        return n

    def trim(self) -> None:
        if len(self) > len(self.frequent) + CACHE:
            self.clear()
            self.update(self.frequent)

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, pre_tokens(text))) if text else 0


def frequent_units(docs: DataFrame, limit: int = FREQUENT) -> list[str]:
    """The most frequent pre-tokens, from bounded summaries of all tasks.

    Each task keeps a lossy count (it drops the rare half when its table is full)
    and reports its largest entries; only those reports are added up.  Which units
    are chosen affects speed alone, never a count of tokens.  Long units are left out,
    so that the reports and the broadcast are bounded in bytes as well.
    """

    @tidy
    def summarise(batches):
        seen: Counter = Counter()
        for batch in batches:
            column = batch.column(0)
            for a in range(0, len(column), 256):
                for text in column.slice(a, 256).to_pylist():
                    if text:
                        seen.update([u for u in pre_tokens(text) if len(u) <= LONG])
                if len(seen) > CACHE:
                    seen = Counter(dict(seen.most_common(CACHE // 4)))
        top = seen.most_common(REPORT)
        yield pa.RecordBatch.from_pydict({"unit": pa.array([u for u, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    reports = docs.select("text").mapInArrow(summarise, "unit string, n long")
    top = reports.groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(limit)
    return [r[0] for r in top.collect()]


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text.

    Null and empty texts have 0 bytes and 0 tokens.  Null doc_ids and repeated rows
    pass through; other columns are ignored.  The broadcast tier has at most
    ``frequent`` entries, whatever the input's size; misses are encoded where they
    occur and kept in a worker's bounded cache.  No text and no pre-token moves.
    """
    spark = docs.sparkSession
    units = frequent_units(docs, frequent)
    own = PieceLengths(model_file)
    tier = spark.sparkContext.broadcast(("\0".join(u for u in units if "\0" not in u), bytes(min(255, own[u]) for u in units if "\0" not in u)))

    @tidy
    def count(batches):
        names, lengths = tier.value
        known = {u: n for u, n in zip(names.split("\0"), lengths) if n < 255} if lengths else {}
        lens = PieceLengths(model_file, known)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for a in range(0, len(column), 256):
                texts = column.slice(a, 256).to_pylist()
                n = [lens.count(t) for t in texts]
                lens.trim()
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": ids.slice(a, 256), "n_bytes": pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())}
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
