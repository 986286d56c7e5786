"""Closures and automaton constructions over tables of arcs, for machines too large for the driver.

Each is semi-naive: only the rows found last are joined with the arcs.  Lineage is cut
with ``checkpoint`` where the cluster names a checkpoint folder, else by a written table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds of a fixpoint whose rows stay apart.
PARTS = 16


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; on one machine without one, a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="fsweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, in storage that survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/fsweave/{name}-{uuid.uuid4().hex}"


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = 10_000) -> DataFrame:
    """All rows that ``step`` leads to from ``seed``, each once; an error if ``rounds`` do not suffice."""
    new = cut(seed.distinct())
    parts = [new]
    for _ in range(rounds):
        seen = parts[0]
        for part in parts[1:]:
            seen = seen.unionByName(part)
        new = cut(step(new).select(*seen.columns).distinct().join(seen, seen.columns, "left_anti"))
        if new.isEmpty():
            return seen
        # a round writes what it found; the parts are written together now and then
        parts = [cut(seen.unionByName(new))] if len(parts) >= PARTS else [*parts, new]
    raise RuntimeError(f"no fixpoint after {rounds} rounds")


def reach(arcs: DataFrame, states: DataFrame, backward: bool = False) -> DataFrame:
    """States reachable from the starts, or that reach a final state."""
    i, j, seed = ("dst", "src", "is_final") if backward else ("src", "dst", "is_start")
    hop = arcs.select(F.col(i).alias("state"), F.col(j).alias("next")).distinct()
    return fixpoint(states.where(seed).select("state"), lambda new: new.join(hop, "state").select(F.col("next").alias("state")))


def trim_arcs(arcs: DataFrame, states: DataFrame) -> DataFrame:
    """Arcs between states that lie on a path from a start to a final state."""
    live = reach(arcs, states).join(reach(arcs, states, backward=True), "state")
    out = arcs.join(live.withColumnRenamed("state", "src"), "src", "left_semi")
    return out.join(live.withColumnRenamed("state", "dst"), "dst", "left_semi").select(*arcs.columns)


def eps_pairs(arcs: DataFrame, states: DataFrame) -> DataFrame:
    """(src, dst): dst is reached from src without reading."""
    hop = arcs.where(F.col("ilabel") == "").select(F.col("src").alias("dst"), F.col("dst").alias("next")).distinct()
    seed = states.select(F.col("state").alias("src"), F.col("state").alias("dst"))
    return fixpoint(seed, lambda new: new.join(hop, "dst").select("src", F.col("next").alias("dst")))


def compose_arcs(f: DataFrame, g: DataFrame) -> DataFrame:
    """Arcs of the composition of two machines that neither write nor read nothing: an equi-join on the middle label."""
    left = f.select(F.col("src").alias("p"), "ilabel", F.col("olabel").alias("mid"), F.col("dst").alias("p2"))
    right = g.select(F.col("src").alias("q"), F.col("ilabel").alias("mid"), "olabel", F.col("dst").alias("q2"))
    return left.join(right, "mid").select("p", "q", "ilabel", "olabel", "p2", "q2")


def project_arcs(arcs: DataFrame, side: int) -> DataFrame:
    return arcs.select("src", F.col(("ilabel", "olabel")[side]).alias("label"), "dst").distinct()


def transpose_arcs(arcs: DataFrame) -> DataFrame:
    return arcs.select("src", F.col("olabel").alias("ilabel"), F.col("ilabel").alias("olabel"), "dst")


def reverse_arcs(arcs: DataFrame) -> DataFrame:
    return arcs.select(F.col("dst").alias("src"), "ilabel", "olabel", F.col("src").alias("dst"))


def subsets(arcs: DataFrame, states: DataFrame) -> DataFrame:
    """Arcs of the subset construction: (members, label, next), members as sorted arrays.

    Without silent arcs; remove them first.
    """
    hop = arcs.select(F.col("src").alias("q"), F.col("ilabel").alias("label"), "dst")
    seed = states.where("is_start").agg(F.array_sort(F.collect_set("state")).alias("members"))

    def moves(new: DataFrame) -> DataFrame:
        one = new.withColumn("q", F.explode("members"))
        return one.join(hop, "q").groupBy("members", "label").agg(F.array_sort(F.collect_set("dst")).alias("next"))

    known = fixpoint(seed, lambda new: moves(new).select(F.col("next").alias("members")))
    return moves(known)


def classes(arcs: DataFrame, states: DataFrame) -> DataFrame:
    """(state, class): equivalent states of a deterministic, complete acceptor, by refinement until stable.

    A class is named by its smallest state.
    """
    ends = states.groupBy("is_final").agg(F.min("state").alias("class"))
    now = cut(states.join(ends, "is_final").select("state", "class"))
    count = ends.count()
    while True:
        to = now.select(F.col("state").alias("dst"), F.col("class").alias("to"))
        sign = arcs.select("src", F.col("ilabel").alias("label"), "dst").join(to, "dst").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("label", "to"))).alias("sign"))
        both = now.join(sign.withColumnRenamed("src", "state"), "state", "left")
        signed = cut(both.select("state", F.col("class").alias("old"), F.coalesce(F.to_json("sign"), F.lit("")).alias("sign")))
        # a class is named by its smallest state, so that no order over all states is needed
        named = signed.groupBy("old", "sign").agg(F.min("state").alias("class"))
        now = cut(signed.join(named, ["old", "sign"]).select("state", "class"))
        n = now.select("class").distinct().count()
        if n == count:
            return now
        count = n


def universal_arcs(arcs: DataFrame, states: DataFrame, alphabet: int) -> DataFrame:
    """States from which every input is accepted, without silent arcs: drop states until each has all symbols within the rest."""
    live = cut(states.where("is_final").select("state"))
    count = live.count()
    while True:
        inside = arcs.join(live.withColumnRenamed("state", "dst"), "dst", "left_semi").groupBy(F.col("src").alias("state")).agg(F.countDistinct("ilabel").alias("n"))
        live = cut(live.join(inside.where(F.col("n") >= alphabet), "state", "left_semi"))
        n = live.count()
        if n == count:
            return live
        count = n


def string_arcs(df: DataFrame, column: str, key: str) -> DataFrame:
    """Linear acceptors of strings: (key, src, label, dst)."""
    chars = df.where(F.length(column) > 0).select(key, F.posexplode(F.split(F.col(column), "")).alias("src", "label"))
    return chars.select(key, "src", "label", (F.col("src") + 1).alias("dst"))


def trie_arcs(df: DataFrame, column: str) -> DataFrame:
    """The trie of a column's strings: (prefix, label, next), each arc once."""
    at = F.explode(F.sequence(F.lit(1), F.length(column)))
    rows = df.where(F.length(column) > 0).select(column).distinct().select(F.col(column).alias("x"), at.alias("k"))
    return rows.select(F.expr("substring(x, 1, k - 1)").alias("prefix"), F.expr("substring(x, k, 1)").alias("label"), F.expr("substring(x, 1, k)").alias("next")).distinct()


def vocabulary_arcs(vocabulary: DataFrame) -> DataFrame:
    """Arcs of the token machine of a vocabulary (token string, spelling string): symbols are written on the way down, the token is read on the way back."""
    down = trie_arcs(vocabulary, "spelling").select(F.col("prefix").alias("src"), F.lit("").alias("ilabel"), F.col("label").alias("olabel"), F.col("next").alias("dst"))
    back = vocabulary.select(F.col("spelling").alias("src"), F.col("token").alias("ilabel"), F.lit("").alias("olabel"), F.lit("").alias("dst"))
    return down.unionByName(back).distinct()
