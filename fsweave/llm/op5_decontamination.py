"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from array import array

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import runs, staged, table, tidy

#: Words of a window, words of a block of the shift table, bytes of benchmark text in one search machine.
WIDTH, BLOCK, SHARD_BYTES = 10, 2, 2 << 20
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and non-ASCII characters, as UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


class Machine:
    """Wu-Manber search for word sequences of one length.

    ``shift`` says for a block of words how far the window may move without missing a
    pattern; a block that no pattern has allows the longest move.  Where the shift is
    nought, the block is some pattern's suffix: its bucket has the patterns to compare.
    A pattern is a place in an item's words (``texts``), not a copy of them; equal
    patterns are one, with all their items.
    """

    def __init__(self, length: int, texts: list[list[bytes]], names: list[str | None]):
        self.length, self.texts, self.names = length, texts, names
        self.block = min(BLOCK, length)
        self.far = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, int | list[int]] = {}
        self.item, self.start = array("i"), array("i")
        self.owners: dict[int, list[int]] = {}  # of patterns that several items have
        known: dict[bytes, int] = {}
        for k, words in enumerate(texts):
            keys = [b" ".join(words[i : i + self.block]) for i in range(len(words) - self.block + 1)]
            for i in range(len(words) - length + 1):
                digest = xxhash.xxh3_128_digest(b" ".join(words[i : i + length]))
                n = known.setdefault(digest, len(self.item))
                if n < len(self.item):
                    self.owners.setdefault(n, [self.item[n]]).append(k)
                    continue
                self.item.append(k)
                self.start.append(i)
                for j in range(self.far):
                    key, step = keys[i + j], self.far - 1 - j
                    if step < self.shift.get(key, self.far):
                        self.shift[key] = step
                there = self.bucket.get(key)
                self.bucket[key] = n if there is None else [*there, n] if isinstance(there, list) else [there, n]

    def search(self, words: list[bytes]):
        """(start, items) of every occurrence, starts ascending."""
        at, n, length, block, far = self.length, len(words), self.length, self.block, self.far
        shift = self.shift.get
        while at <= n:
            key = words[at - 1] if block == 1 else words[at - 2] + b" " + words[at - 1]
            step = shift(key, far)
            if step:
                at += step
                continue
            start, found = at - length, self.bucket[key]
            for k in found if isinstance(found, list) else (found,):
                item, i = self.item[k], self.start[k]
                if words[start:at] == self.texts[item][i : i + length]:
                    yield start, [self.names[o] for o in self.owners.get(k, (item,)) if self.names[o] is not None]
            at += 1


def machines(items: list[tuple[str | None, str | None]], width: int = WIDTH) -> list[Machine]:
    """A machine for each length among the items' windows."""
    by_length: dict[int, tuple[list, list]] = {}
    same: dict[bytes, bytes] = {}  # one object for each word
    for item, text in items:
        if words := [same.setdefault(w, w) for w in words_of(text)]:
            texts, names = by_length.setdefault(min(width, len(words)), ([], []))
            texts.append(words)
            names.append(item)
    return [Machine(length, *group) for length, group in sorted(by_length.items())]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ascending spans that cover the same words."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search_text(search: list[Machine], text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Words of the text, disjoint spans of hit words, items found."""
    words = words_of(text)
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    for m in search:
        for start, owners in m.search(words):
            spans.append((start, start + m.length))
            items.update(owners)
    return len(words), merge_spans(spans), sorted(items)


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_SCHEMA = "doc_id long, row long, n_words long, spans array<struct<a:int,b:int>>, items array<string>"


def _item_shards(benchmark: DataFrame) -> list:
    """Broadcasts of the items, each of a checked size; a large benchmark is several."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // SHARD_BYTES))
    sc = benchmark.sparkSession.sparkContext
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [sc.broadcast([(r[0], r[1]) for r in items.where(part == k).collect()]) for k in range(n)]


def _scan(docs: DataFrame, shard) -> DataFrame:
    @tidy
    def scan(batches):
        search = machines(shard.value)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in runs((len(t or "") for t in texts), 4 << 20):
                got = [search_text(search, t) for t in texts[a:b]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(a, b - a),
                        "row": batch.column(1).slice(a, b - a),
                        "n_words": pa.array([g[0] for g in got], pa.int64()),
                        "spans": pa.array([[{"a": x, "b": y} for x, y in g[1]] for g in got], _SPANS),
                        "items": pa.array([g[2] for g in got], pa.list_(pa.string())),
                    }
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    return rows.mapInArrow(scan, _SCHEMA)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, spans of hit words, items, for every whole text.

    Null and empty texts have no words.  Items without words match nothing; null item
    ids mark words but are not listed; equal item ids count once.  Null doc_ids and
    repeated rows pass through.  Texts may have any length.  No documents give no rows.

    The benchmark is broadcast in shards of at most 2 MB of text, which bounds what a
    worker holds.  With more than one shard, all documents are searched for each in
    turn, and the spans of equal rows, which are alike, are united once.
    """
    shards = _item_shards(benchmark)
    if len(shards) == 1:
        return _scan(docs, shards[0]).drop("row")
    key, found = ["doc_id", "row", "n_words"], None
    for shard in shards:
        one = _scan(docs, shard).groupBy(*key).agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
        found = one if found is None else found.unionByName(one)

    @tidy
    def unite(batches):
        for batch in batches:
            spans = [[{"a": a, "b": b} for a, b in merge_spans([(s["a"], s["b"]) for s in row])] for row in batch.column("spans").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("spans"), "spans", pa.array(spans, _SPANS))

    grouped = found.groupBy(*key).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    united = grouped.mapInArrow(unite, grouped.schema)
    united = united.select(F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("none"), "row", "n_words", "spans", "items")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("none"), "row")
    return rows.join(united.hint("merge"), ["k", "none", "row"]).select("doc_id", "n_words", "spans", "items")


def decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The report of :func:`find`: counts, digest of the items, and whether any word is hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["b"] - x["a"]).cast("long"))
    return find(docs, benchmark).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns.

    Null and empty texts have no words and stay; repeated rows are judged alike; no
    documents give no rows, and with no items all stay.  Whole texts are searched.
    Other columns may have any names.  Shards of a large benchmark take their turn, so
    that a worker holds one at a time; what is left is written in between.
    """

    def without(shard):
        @tidy
        def keep(batches):
            search = machines(shard.value)
            for batch in batches:
                clean = [not any(next(m.search(w), None) for m in search) for w in (words_of(t.as_py()) for t in batch.column("text"))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return keep

    first, *others = _item_shards(benchmark)
    for shard in others:
        docs = staged(docs.mapInArrow(without(shard), docs.schema), "decontaminated")
    return docs.mapInArrow(without(first), docs.schema)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
t AS (
  SELECT r, i, n, array_to_string(ws[i : i + n - 1], ' ') AS s
  FROM (SELECT w.*, l.n, unnest(range(1, len(ws) - l.n + 2)) AS i FROM w, (SELECT DISTINCT n FROM p) l WHERE len(ws) >= l.n)),
h AS (SELECT t.r, t.i, t.n, p.item_id FROM t JOIN p ON t.n = p.n AND t.s = p.s),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY r),
g AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(g.n_items, 0) AS n_items,
       sha256(coalesce(g.s, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (r) LEFT JOIN g USING (r)
"""
