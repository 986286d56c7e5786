"""Exact deduplication against a persistent digest index (DataFrame operations only)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Work, remove, scratch, staged, table


#: Batches in which the query feeds the index.
BATCHES = 2


def best_of():
    """The order of equal texts: most code points, then smallest doc_id, null ids last."""
    return F.struct((-F.col("n_cp")).alias("neg"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))


class DigestIndex:
    """A table of digests, bucketed and sorted by digest, that outlives sessions.

    ``entries`` holds each digest once: a batch adds those that an anti-join finds the
    index to lack.  What a batch has of known digests goes to ``updates``, with its own
    best row and number of rows; nothing is rewritten.  Both lie under ``path``; a
    session that did not create them registers them again over the same files.
    ``buckets`` belongs to the layout and must stay the same.  A batch whose addition was
    cut short must not be added again to the same index.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        key = uuid.uuid5(uuid.NAMESPACE_URL, path).hex
        self.entries, self.updates = f"digest_entries_{key}", f"digest_updates_{key}"
        for name in (self.entries, self.updates):
            if not spark.catalog.tableExists(name):
                spark.sql(
                    f"CREATE TABLE {name} (digest BINARY, doc_id BIGINT, n_cp BIGINT, n BIGINT) USING parquet "
                    f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.place(name)}'"
                )

    def place(self, name: str) -> str:
        return f"{self.path}/{name.split('_')[1]}"

    def frame(self, name: str | None = None) -> DataFrame:
        """The entries, or another of the index's tables."""
        self.spark.catalog.refreshTable(name or self.entries)
        return self.spark.table(name or self.entries)

    def known(self) -> DataFrame:
        """A row for each digest: keep_id, n_cp and rows so far; read bucket by bucket, without a shuffle.

        Only updates are grouped; entries are unique as the anti-join made them.
        """
        later = self.frame(self.updates).groupBy("digest").agg(F.min(best_of()).alias("later"), F.sum("n").alias("more"))
        both = self.frame().select("digest", best_of().alias("own"), "n").join(later.hint("merge"), "digest", "left")
        both = both.select("digest", F.least("own", "later").alias("best"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        return both.select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.neg")).alias("n_cp"), "n")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet").option("path", self.place(name)).saveAsTable(name)

    def add(self, rows: DataFrame) -> None:
        """Append a batch (digest, doc_id, n_cp): one sorted file for each bucket and table.

        The batch is summed first and joined with the index bucket by bucket.
        """
        groups = rows.groupBy("digest").agg(F.min(best_of()).alias("best"), F.count(F.lit(1)).alias("n"))
        groups = groups.select("digest", F.col("best.id").alias("doc_id"), (-F.col("best.neg")).alias("n_cp"), "n").repartition(self.buckets, "digest")
        with Work(self.spark, "digest-batch") as work:
            groups = work.bucketed(groups, "digest_groups", self.buckets, "digest")
            there = self.frame().select("digest").hint("merge")
            self.append(self.updates, groups.join(there, "digest", "left_semi"))
            self.append(self.entries, groups.join(there, "digest", "left_anti"))

    def drop(self) -> None:
        """Forget the index and delete its files."""
        for name in (self.entries, self.updates):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.path)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, code points of the text, SHA-256 of the text without ASCII white space. Null counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, ASCII_SPACE, "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_cp"), F.unhex(F.sha2(bare, 256)).alias("digest"))


def judged(rows: DataFrame, verdict: DataFrame) -> DataFrame:
    """Rows with their digest's verdict (keep_id, group_size, known)."""
    return rows.join(verdict.hint("merge"), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("known")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Judge a batch against the index and itself, then add it to the index.

    Of equal texts the one with the most code points stays, then the smallest
    doc_id (null ids last); a text that the index already holds is not kept again, and
    its keep_id is the one that the index had.  group_size counts the batch's rows.
    Rows that repeat wholly, doc_id included, tie: each of the tied rows counts as
    kept, as they cannot be told apart.  Null and empty texts are one group.  An
    empty batch gives no rows.  Texts may have any length.  Columns other than doc_id
    and text are ignored.

    Scale: texts never move, only 32-byte digests do.  Groups are summed before the
    shuffle; the lookup back is a sort-merge join between two plain exchanges, so
    that a digest held by a third of all rows is split at run time.
    """
    rows = staged(digests(docs), "digests")
    groups = rows.groupBy("digest").agg(F.min(best_of()).alias("best"), F.count(F.lit(1)).alias("group_size"))
    known = index.known().select("digest", F.col("keep_id").alias("known_id"), F.lit(True).alias("known"))
    groups = groups.join(known.hint("merge"), "digest", "left")
    verdict = groups.select("digest", "group_size", F.when(F.col("known"), F.col("known_id")).otherwise(F.col("best.id")).alias("keep_id"), F.coalesce("known", F.lit(False)).alias("known"))
    verdict = staged(verdict, "digest-groups")
    index.add(rows)
    return judged(rows, verdict)


def deduplicate_all(docs: DataFrame, index: DigestIndex, batches: int = BATCHES) -> DataFrame:
    """Feed a table to the index in batches, then judge every row by what the index holds.

    The row that stays is the best of all batches, so a later batch may take over from
    an earlier one.  Cases are settled as in :func:`deduplicate`, which judges one batch
    at a time.  Batches are parted by a hash of doc_id and code points; which row is in
    which does not change the result.  The verdicts are written out of their buckets, so
    that here too both sides of the lookup are exchanged and a hot digest is split.
    """
    rows = staged(digests(docs), "digests")
    for k in range(batches):
        index.add(rows.where(F.pmod(F.xxhash64("doc_id", "n_cp"), F.lit(batches)) == k))
    verdict = index.known().select("digest", "keep_id", F.col("n").alias("group_size"), F.lit(False).alias("known"))
    return judged(rows, staged(verdict, "digest-groups"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, scratch(spark, "digest-index"), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        return staged(deduplicate_all(table(spark, sf_dir, "documents"), index), "exact-dedup")
    finally:
        index.drop()


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id) AS kept,
       text_sha256
FROM d
"""
