"""Substring deduplication with a log-structured index of window fingerprints."""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, WordHashes, mix64, pack_ints, pack_sorted, remove, scratch, table, tidy, tidy_shuffles, unpack_ints, unpack_sorted, window_hashes

import zstandard

#: Words of a window; bytes of text in a block; windows for which a bucket is meant; runs of a level that are merged into one of the next.
WIDTH, BLOCK_BYTES, BUCKET_WINDOWS, FAN = 13, 4 << 20, 1 << 19, 2
#: Fixed odd multipliers of the two fingerprints, and the id of a document without one (after all others).
BASE_A, BASE_B, NO_ID = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, (1 << 63) - 1

_ROW = "bucket int, block long, n long, h binary, c binary, d binary"
_NAMES = ["bucket", "block", "n", "h", "c", "d"]


class Prints:
    """Fingerprints of a block's or bucket's windows: key h (64 bits), check c (32 bits), smallest doc_id d."""

    def __init__(self, h: np.ndarray, c: np.ndarray, d: np.ndarray):
        self.h, self.c, self.d = h, c, d

    @staticmethod
    def grouped(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order that brings equal (h, c) together, and where each group starts."""
        order = np.argsort(h)
        hs, cs = h[order], c[order]
        same = hs[1:] == hs[:-1]
        if (same & (cs[1:] != cs[:-1])).any():  # equal keys of different windows: the check parts them
            order = np.lexsort((c, h))
            hs, cs = h[order], c[order]
            same = (hs[1:] == hs[:-1]) & (cs[1:] == cs[:-1])
        starts = np.flatnonzero(np.concatenate([[True], ~same])) if len(h) else np.empty(0, np.int64)
        return order, starts

    def distinct(self) -> Prints:
        order, starts = self.grouped(self.h, self.c)
        if not len(starts):
            return self
        first = order[starts]
        return Prints(self.h[first], self.c[first], np.minimum.reduceat(self.d[order], starts))

    def packed(self, a: int = 0, b: int | None = None) -> tuple[int, bytes, bytes, bytes]:
        """Arrays in ascending order of h, compressed; d as distance from NO_ID so that high bytes agree."""
        h, c, d = self.h[a:b], self.c[a:b], self.d[a:b]
        return len(h), pack_sorted(h), pack_ints(c), pack_ints((np.int64(NO_ID) - d).view(np.uint64))

    @staticmethod
    def unpacked(h: bytes, c: bytes, d: bytes) -> Prints:
        return Prints(unpack_sorted(h), unpack_ints(c, np.uint32), np.int64(NO_ID) - unpack_ints(d, np.uint64).view(np.int64))


class Block:
    """Some documents' words and the fingerprints of their windows."""

    def __init__(self, ids: np.ndarray, body: bytes, hashes: WordHashes):
        self.ids = ids
        self.texts = body.split(b"\n") if len(ids) else []
        self.words = [t.split() for t in self.texts]
        counts = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(counts)
        x = hashes.of([w for ws in self.words for w in ws])
        owner = np.repeat(np.arange(len(ids)), counts)
        last = len(x) - WIDTH + 1
        self.at = np.flatnonzero(owner[:last] == owner[WIDTH - 1 :]) if last > 0 else np.empty(0, np.int64)
        self.owner = owner[self.at]
        doc = self.ids[self.owner] if len(self.at) else np.empty(0, np.int64)
        a, b = window_hashes(x, WIDTH, BASE_A), window_hashes(mix64(x), WIDTH, BASE_B)
        self.prints = Prints(a[self.at], (b[self.at] >> np.uint64(32)).astype(np.uint32), doc)

    @staticmethod
    def pack(ids: list, texts: list[bytes]) -> tuple[bytes, bytes]:
        known = np.array([NO_ID if i is None else i for i in ids], np.int64)
        return pack_ints((np.int64(NO_ID) - known).view(np.uint64)), zstandard.ZstdCompressor(level=3).compress(b"\n".join(texts))

    @staticmethod
    def unpack(ids: bytes, body: bytes, hashes: WordHashes) -> Block:
        known = np.int64(NO_ID) - unpack_ints(ids, np.uint64).view(np.int64)
        return Block(known, zstandard.ZstdDecompressor().decompress(body), hashes)


@tidy
def _blocks(batches):
    """Documents as words joined by one space, about BLOCK_BYTES together."""
    from pyspark import TaskContext

    part, turn = TaskContext.get().partitionId(), 0
    ids, texts, size = [], [], 0

    def flush():
        a, b = Block.pack(ids, texts)
        return pa.RecordBatch.from_pydict({"block": pa.array([part << 24 | turn], pa.int64()), "ids": pa.array([a], pa.binary()), "body": pa.array([b], pa.binary())})

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = b" ".join(t.encode().split()) if (t := text.as_py()) else b""
            ids.append(doc_id)
            texts.append(words)
            size += len(words) + 1
            if size >= BLOCK_BYTES:
                yield flush()
                ids, texts, size, turn = [], [], 0, turn + 1
    if ids:
        yield flush()


def _windows(shift: int):
    @tidy
    def windows(batches):
        """The distinct fingerprints of each block, parted by the high bits of h."""
        hashes = WordHashes()
        for batch in batches:
            for block, ids, body in zip(*(batch.column(k) for k in range(3))):
                p = Block.unpack(ids.as_py(), body.as_py(), hashes).prints.distinct()
                bucket = (p.h >> np.uint64(shift)).astype(np.int64)
                edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else [0]
                rows = [(int(bucket[a]), block.as_py(), *p.packed(a, b)) for a, b in zip(edges[:-1], edges[1:])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=_NAMES)

    return windows


def _merge(batch: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    """Merge the batch's fingerprints of a bucket with the runs' (block -1).

    Gives the new run's part (block -1): fingerprints that no run has, or not with so
    small a doc_id; and for each block those whose smallest doc_id lies elsewhere.
    """
    if not len(batch):
        return pd.DataFrame([], columns=_NAMES)
    pdf = pd.concat([batch[_NAMES], runs[_NAMES]], ignore_index=True)
    parts = [Prints.unpacked(*row) for row in pdf[["h", "c", "d"]].itertuples(index=False)]
    sizes = [len(p.h) for p in parts]
    h, c, d = (np.concatenate([getattr(p, k) for p in parts]) for k in "hcd")
    source = np.repeat(np.arange(len(parts)), sizes)
    old = np.repeat((pdf["block"] < 0).to_numpy(), sizes)
    del parts
    order, starts = Prints.grouped(h, c)
    h, c, d, source, old = h[order], c[order], d[order], source[order], old[order]
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
    least = np.minimum.reduceat(d, starts)
    history = np.minimum.reduceat(np.where(old, d, NO_ID), starts)
    seen = np.logical_or.reduceat(old, starts)
    fresh = ~seen | (least < history)
    bucket = int(pdf["bucket"].iloc[0])
    rows = []
    if fresh.any():
        rows.append((bucket, -1, *Prints(h[starts][fresh], c[starts][fresh], least[fresh]).packed()))
    told = ~old & (d > least[group])
    for k in np.unique(source[told]):
        mine = told & (source == k)
        rows.append((bucket, int(pdf["block"].iloc[k]), *Prints(h[mine], c[mine], least[group][mine]).packed()))
    return pd.DataFrame(rows, columns=_NAMES)


def _compact(pdf: pd.DataFrame) -> pd.DataFrame:
    """The runs' parts of a bucket as one."""
    parts = [Prints.unpacked(*row) for row in pdf[["h", "c", "d"]].itertuples(index=False)]
    whole = Prints(*(np.concatenate([getattr(p, k) for p in parts]) for k in "hcd")).distinct()
    return pd.DataFrame([(int(pdf["bucket"].iloc[0]), -1, *whole.packed())], columns=_NAMES)


def _cut(keep_text: bool):
    @tidy
    def cut(batches):
        """Remove covered words of each block's documents, given the smallest doc_ids elsewhere."""
        hashes = WordHashes()
        for batch in batches:
            for ids, body, told in zip(*(batch.column(k) for k in range(3))):
                block = Block.unpack(ids.as_py(), body.as_py(), hashes)
                p = block.prints
                least = np.empty(len(p.h), np.int64)
                order, starts = Prints.grouped(p.h, p.c)
                if len(starts):
                    least[order] = np.repeat(np.minimum.reduceat(p.d[order], starts), np.diff(np.append(starts, len(order))))
                answers = [Prints.unpacked(x["h"], x["c"], x["d"]) for x in told.as_py() or []]
                if answers:
                    far = Prints(*(np.concatenate([getattr(a, k) for a in answers]) for k in "hcd")).distinct()
                    at = np.searchsorted(far.h, p.h)
                    for step in range(int(np.unique(far.h, return_counts=True)[1].max())):  # one, unless keys collide
                        k = np.minimum(at + step, len(far.h) - 1)
                        hit = (far.h[k] == p.h) & (far.c[k] == p.c)
                        least[hit] = np.minimum(least[hit], far.d[k][hit])
                gone = block.at[least < p.d]
                total = int(block.ends[-1]) if len(block.ends) else 0
                edge = np.zeros(total + WIDTH + 1, np.int32)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + WIDTH, -1)
                covered = np.cumsum(edge)[:total] > 0
                removed, kept = [], []
                for k, end in enumerate(block.ends):
                    words, start = block.words[k], int(end) - len(block.words[k])
                    mask = covered[start:end]
                    removed.append(int(mask.sum()))
                    kept.append(block.texts[k] if not removed[-1] else b" ".join([w for w, m in zip(words, mask.tolist()) if not m]))
                columns = {
                    "doc_id": pa.array([None if i == NO_ID else int(i) for i in block.ids], pa.int64()),
                    "n_words": pa.array([len(w) for w in block.words], pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()),
                }
                if keep_text:
                    columns["kept_text"] = pa.array([t.decode() for t in kept], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return cut


class FingerprintIndex:
    """Immutable sorted runs of window fingerprints under ``path``.

    ``buckets``, a power of two, parts the keys; choose it for the size expected.  A
    run has one row for each bucket, with its keys ascending.  All runs are bucketed by
    bucket into ``files`` files, so that a batch is merged with them without moving
    them.  Runs have levels: a batch makes one of level 0, and ``fan`` runs of a level
    are merged into one of the next, so that each fingerprint is rewritten about
    log(batches) times.  A run counts once its note in ``_runs``, which lists its files,
    is written; a merged run is noted before the notes and files of its parts go, which
    at worst leaves fingerprints twice.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, files: int = 64, fan: int = FAN):
        self.spark, self.path, self.buckets, self.files, self.fan = spark, path, buckets, files, fan
        self.shift = 64 - (buckets.bit_length() - 1)
        self.name = "fingerprints_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({_ROW}, run string) USING parquet "
            f"CLUSTERED BY (bucket) SORTED BY (bucket) INTO {files} BUCKETS LOCATION '{path}'"
        )

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def runs(self, level: int | None = None) -> list[str]:
        """Runs that were written to their end: level, dash, name."""
        names = self._names(f"{self.path}/_runs")
        return names if level is None else [n for n in names if int(n.split("-")[0]) == level]

    def read(self, runs: list[str] | None = None) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name).where(F.col("run").isin(self.runs() if runs is None else runs))

    def _append(self, rows: DataFrame, level: int = 0) -> None:
        run, before = f"{level:03d}-{uuid.uuid4().hex}", set(self._names(self.path))
        out = rows.select(*_NAMES, F.lit(run).alias("run"))
        out.write.bucketBy(self.files, "bucket").sortBy("bucket").mode("append").format("parquet").option("path", self.path).saveAsTable(self.name)
        fs, p = self._fs(f"{self.path}/_runs/{run}")
        note = fs.create(p, True)
        note.write(bytearray(json.dumps([n for n in self._names(self.path) if n not in before and n[0] not in "._"]).encode()))
        note.close()

    def _forget(self, runs: list[str]) -> None:
        """Delete runs' notes, then their files."""
        for run in runs:
            fs, p = self._fs(f"{self.path}/_runs/{run}")
            note = fs.open(p)
            files = json.loads(bytes(note.readAllBytes()))
            note.close()
            fs.delete(p, False)
            for name in files:
                remove(self.spark, f"{self.path}/{name}")

    def compact(self, level: int | None = None) -> None:
        """Merge the runs of a level, or all runs, into one of the next level."""
        old = self.runs(level)
        if len(old) > 1:
            above = 1 + max(int(n.split("-")[0]) for n in old)
            self._append(self.read(old).groupBy("bucket").applyInPandas(_compact, _ROW), above)
            self._forget(old)

    def settle(self) -> None:
        """Merge levels that are full, from the lowest up."""
        level = 0
        while self.runs():
            if len(self.runs(level)) >= self.fan:
                self.compact(level)
            level += 1
            if level > max(int(n.split("-")[0]) for n in self.runs()):
                break

    def drop(self) -> None:
        """Forget the index and delete its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)

    def deduplicate(self, docs: DataFrame, keep_text: bool = False) -> str:
        """Judge one batch against the runs and itself, and add its run; the path of the result.

        The texts are written once, as compressed blocks bucketed by block, and are not
        shuffled.  What is shuffled are distinct fingerprints of blocks, compressed.
        """
        spark, out = self.spark, scratch(self.spark, "substring-dedup")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        with Work(spark, "substring-batch") as work, tidy_shuffles(spark):
            merged_at = f"{work.at}/merged"
            blocks = work.bucketed(rows.mapInArrow(_blocks, "block long, ids binary, body binary"), "blocks", self.files, "block")
            prints = blocks.mapInArrow(_windows(self.shift), _ROW)
            merged = prints.groupBy("bucket").cogroup(self.read().groupBy("bucket")).applyInPandas(_merge, _ROW)
            merged.withColumn("kind", F.when(F.col("block") < 0, "run").otherwise("told")).write.partitionBy("kind").parquet(merged_at)
            parts = {kind: spark.read.schema(_ROW).parquet(f"{merged_at}/kind={kind}") if f"kind={kind}" in self._names(merged_at) else spark.createDataFrame([], _ROW) for kind in ("run", "told")}
            told = parts["told"].groupBy("block").agg(F.collect_list(F.struct("h", "c", "d")).alias("told"))
            schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
            blocks.join(told.hint("merge"), "block", "left").select("ids", "body", "told").mapInArrow(_cut(keep_text), schema).write.parquet(out)
            self._append(parts["run"])
        with tidy_shuffles(spark):
            self.settle()
        return out


def buckets_for(chars: int) -> int:
    """Buckets for a corpus of so many characters: a power of two, 64 at least."""
    return 1 << max(6, (chars // 6 // BUCKET_WINDOWS).bit_length())


def remove_repeats(docs: DataFrame, index: FingerprintIndex | None = None, batches: int = 3, keep_text: bool = False) -> DataFrame:
    """Remove each word covered by a 13-word window that also starts in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every document.
    Batches are ranges of doc_id, ascending; each is merged with the runs before it.
    A window is known by a 96-bit fingerprint: runs are sorted and merged by 64 bits and
    each match is verified by 32 bits of a second hash.  Among n different windows
    n * n / 2 ** 97 false matches are to be expected: 0.0006 at 10 ** 13 windows.  Runs
    are compacted on the way, two of a level into one.  Without an ``index`` the one that
    is made is deleted in the end.

    Null texts and texts under 13 words have no windows.  Null doc_ids are after all
    others and in the last batch; rows with equal doc_ids do not remove from each
    other.  Repeats within one document stay.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shares = [k / batches for k in range(1, batches)] or [0.5]
    size, cuts = rows.agg(F.sum(F.octet_length("text")), F.percentile_approx("doc_id", shares, 1000)).first()
    cuts = sorted({int(c) for c in cuts or []}) if batches > 1 else []
    own = index is None
    if own:
        index = FingerprintIndex(spark, scratch(spark, "fingerprints"), buckets_for(size or 0), int(spark.conf.get("spark.sql.shuffle.partitions")))
    paths = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        batch = rows
        if low is not None:
            batch = batch.where(F.col("doc_id") > low if high is not None else (F.col("doc_id") > low) | F.col("doc_id").isNull())
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        paths.append(index.deduplicate(batch, keep_text))
    if own:
        index.drop()
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return spark.read.schema(schema).parquet(*paths)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (
  SELECT r, doc_id, i, array_to_string(ws[i : i + 12], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
f AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY s) AS m FROM w) WHERE m < doc_id),
g AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS k FROM f),
t AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM d),
k AS (
  SELECT t.r, count(g.k) AS n_removed, string_agg(t.word, ' ' ORDER BY t.k) FILTER (WHERE g.k IS NULL) AS s
  FROM t LEFT JOIN g ON t.r = g.r AND t.k = g.k GROUP BY t.r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
