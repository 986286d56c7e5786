"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hashed_share, table, tidy

#: Bounds of the fit: documents read for it (about), known words, longest character n-gram.
FIT_DOCS, WORDS, LONGEST = 20_000, 100_000, 5
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case.  Numbers that are no digits (fractions, Roman ones) are no letters, but may stand in a word."""
    return [w for w in _WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def is_held_out(doc_id="doc_id"):
    """crc32 of the doc_id as text, mod 4, is 2; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class LanguageModel:
    """Log frequencies of words and of character n-grams for each language.

    ``counts`` has (language, word, occurrences).  N-grams are those of the known
    words, marked at both ends, weighted by the words' occurrences.
    """

    def __init__(self, counts: list[tuple[str, str, int]], longest: int = LONGEST):
        self.langs = sorted({l for l, _, _ in counts})
        at = {l: i for i, l in enumerate(self.langs)}
        words = sorted({w for _, w, _ in counts})
        row = {w: i for i, w in enumerate(words)}
        table = np.zeros((len(words), len(at)))
        for lang, word, n in counts:
            table[row[word], at[lang]] += n
        self.words, self.word_logs = row, self._logs(table).astype(np.float32)
        self.grams: list[tuple[dict[str, int], np.ndarray]] = []
        for n in range(1, longest + 1):
            keys: dict[str, int] = {}
            rows, ws = [], []
            for w, i in row.items():
                for g in self._split(w, n):
                    rows.append(keys.setdefault(g, len(keys)))
                    ws.append(i)
            at_rows, weights = np.array(rows, np.int64), table[np.array(ws, np.int64)] if ws else np.zeros((0, len(at)))
            sums = np.stack([np.bincount(at_rows, weights[:, k], len(keys)) for k in range(len(at))], 1) if keys else np.zeros((0, len(at)))
            self.grams.append((keys, self._logs(sums).astype(np.float32)))

    @staticmethod
    def _split(word: str, n: int) -> list[str]:
        word = f"<{word}>" if n > 1 else word
        return [word[i : i + n] for i in range(len(word) - n + 1)]

    @staticmethod
    def _logs(table: np.ndarray) -> np.ndarray:
        """Smoothed log share within each language."""
        return np.log((table + 0.5) / (table.sum(0) + 0.5 * max(1, len(table))))

    def of_word(self, word: str) -> np.ndarray:
        """Known words by their log frequency; others by the longest n-grams that are known."""
        k = self.words.get(word)
        if k is not None:
            return self.word_logs[k]
        for n in range(len(self.grams), 0, -1):
            keys, logs = self.grams[n - 1]
            known = [keys[g] for g in self._split(word, n) if g in keys]
            if known:
                return logs[known].mean(0)
        return np.zeros(len(self.langs), np.float32)


class Scorer(dict):
    """word -> row of a growing matrix of scores, bounded; long words are not remembered."""

    LIMIT, LONG = 300_000, 64

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model
        self.matrix, self.n = np.zeros((1024, len(model.langs)), np.float32), 0

    def __missing__(self, word: str) -> int:
        k, self.n = self.n, self.n + 1
        if k == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[k] = self.model.of_word(word)
        if len(word) <= self.LONG:
            self[word] = k
        return k

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.model.langs:
            return "und", 0.0
        total = np.zeros(len(self.model.langs))
        for a in range(0, len(words), 100_000):
            if self.n > self.LIMIT:
                self.clear()
                self.n = 0
            rows = list(map(self.__getitem__, words[a : a + 100_000]))
            total += self.matrix[rows].sum(0, dtype=np.float64)
        e = np.exp(total - total.max())
        return self.model.langs[int(total.argmax())], float(e.max() / e.sum())


def fit(docs: DataFrame, bound: int = FIT_DOCS, words: int = WORDS) -> LanguageModel:
    """Count words of about ``bound`` learnable documents, chosen by hash of the id.

    Learnable rows have text and a language and are not held out.  Tasks count what
    they read before anything moves.  Of ``words`` words each language has an equal share,
    its most frequent ones, so that a rare language is not crowded out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & ~is_held_out())
    share = hashed_share(rows.count(), bound)
    sample = rows.where(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 20)) < share).where(F.col("text").isNotNull())

    def count(batches):
        seen: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen.setdefault(lang, Counter()).update(words_of(text.as_py()))
        for lang, c in seen.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(c), pa.string()), "word": pa.array(list(c), pa.string()), "n": pa.array(list(c.values()), pa.int64())})

    summed = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    langs = sample.select("lang").distinct().count()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = summed.withColumn("rank", rank).where(F.col("rank") <= max(1, words // max(1, langs))).collect()
    return LanguageModel([(r["lang"], r["word"], r["n"]) for r in top])


def identify(docs: DataFrame, bound: int = FIT_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text.

    ``und`` with score 0 where the text is null, empty or has no letter, or where
    nothing could be learned (no labelled rows).  Equal scores go to the language
    that sorts first.  Texts may have any length.  Null doc_ids are not held out; repeated rows and other
    columns do no harm.  The model is bounded by its parameters, so it is broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, bound))

    @tidy
    def predict(batches):
        scorer = Scorer(model.value)
        for batch in batches:
            got = [scorer.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
