"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Work, staged, table

#: Documents in a leaf of the reduction tree, children of an inner node, and sources up to which their table is broadcast.
LEAF, FAN, BROADCAST = 1024, 64, 100_000
EPS = 1e-9


def word_count(text="text"):
    """Number of runs of bytes other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Targets in proportion to ``weights`` that sum to ``total``; none is above ``cap`` times its size.

    What a capped source cannot take is dealt to the others by weight, again and
    again until none is above its cap.  If all are capped, less than ``total`` is taken.
    """
    targets, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while free:
        share = left / sum(weights[i] for i in free)
        over = [i for i in free if share * weights[i] > cap * sizes[i]]
        if not over:
            for i in free:
                targets[i] = share * weights[i]
            break
        for i in over:
            targets[i] = cap * sizes[i]
            left -= targets[i]
        full = set(over)
        free = [i for i in free if i not in full]
    return targets


def pivot(p: np.ndarray, s: np.ndarray, rng: np.random.Generator) -> int:
    """Round probabilities ``p`` of units of ``s`` words in place; return the residual's index or -1.

    Units meet in pairs.  Words move from one to the other, in a random direction
    that keeps each unit's expectation, until one of the two is 0 or 1; the other
    meets the next unit.  The expected words of all, sum(p * s), never change.
    """
    carry = -1
    draws = rng.random(len(p))
    for j in range(len(p)):
        if p[j] <= EPS or p[j] >= 1 - EPS:
            p[j] = round(p[j])
            continue
        if carry < 0:
            carry = j
            continue
        i = carry
        to_i = min((1 - p[i]) * s[i], p[j] * s[j])
        to_j = min(p[i] * s[i], (1 - p[j]) * s[j])
        move = to_i if draws[j] * (to_i + to_j) < to_j else -to_j
        p[i] += move / s[i]
        p[j] -= move / s[j]
        carry = -1
        for k in (i, j):
            if EPS < p[k] < 1 - EPS:
                carry = k
            else:
                p[k] = round(p[k])
    return carry


def _rounder(seed: int, level: int, schema: list[str]):
    def round_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "k", "none", "th", "size"], kind="stable", ignore_index=True)
        p, s = pdf["p"].to_numpy(float).copy(), pdf["size"].to_numpy(float)
        rest = pivot(p, s, np.random.default_rng([seed, level, int(key[0]), int(key[1])]))
        pdf["p"] = p
        pdf["open"] = np.arange(len(p)) == rest
        return pdf[schema]

    return round_group


def _keys():
    """A row's doc_id (0 if null, and a flag) and its text's hash."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("th")]


def _plan(docs: DataFrame, work: Work, weights: Iterable[float], cap: float, seed: int) -> DataFrame:
    """The plan by units: rows of one source with one doc_id and text, of which there are ``m``.

    Each row is taken ``whole`` times; ``certain`` of the m rows, and one more with
    probability p, once more.  p is 0 or 1 but for one unit of each source, which is ``open``.
    """
    weights, spark = list(weights), docs.sparkSession
    rows = docs.select(*_keys(), F.col("source").cast("string").alias("source"), word_count().alias("size"))
    units = work.staged(rows.groupBy("k", "none", "th", "source", "size").agg(F.count(F.lit(1)).alias("m")), "mix-units")
    stats = [(r[0], int(r[1]), int(r[2])) for r in units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")), F.count(F.lit(1))).collect()]
    stats.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    sizes = [r[1] for r in stats]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(stats))], sum(sizes), cap)
    leaves = [max(1, -(-r[2] // LEAF)) for r in stats]
    rates = [min(cap, t / s) if s else 0.0 for t, s in zip(targets, sizes)]
    spec = spark.createDataFrame(
        [(r[0], i, r[1], t, rate, n) for i, (r, t, rate, n) in enumerate(zip(stats, targets, rates, leaves))],
        "name string, s int, source_size long, target double, rate double, leaves int",
    )
    if len(stats) <= BROADCAST:
        spec = F.broadcast(spec)
    whole, hashed = F.floor(F.col("rate") + EPS), F.xxhash64(F.lit(seed), "k", "none", "th", "size")
    share = F.col("m") * F.greatest(F.lit(0.0), F.col("rate") - F.col("whole"))
    units = units.join(spec, units["source"].eqNullSafe(spec["name"])).drop("name").withColumn("whole", whole).withColumn("certain", F.when(F.col("size") > 0, F.floor(share + EPS)).otherwise(F.lit(0).cast("long")))
    units = units.withColumn("p", F.greatest(F.lit(0.0), share - F.col("certain"))).withColumn("h", hashed).withColumn("b", F.pmod("h", "leaves").cast("int")).drop("rate", "leaves")
    settled = (F.col("size") == 0) | (F.col("p") <= EPS)
    done = [units.where(settled).withColumn("p", F.lit(0.0)).withColumn("open", F.lit(False)).drop("h", "b")]
    todo = units.where(~settled)
    names, blocks, level = [*todo.columns, "open"], max(leaves, default=1), 0
    while True:
        schema = todo.withColumn("open", F.lit(False)).schema
        rounded = work.staged(todo.groupBy("s", "b").applyInPandas(_rounder(seed, level, names), schema), f"mix-level{level}")
        if blocks == 1:
            done.append(rounded.drop("h", "b"))
            break
        done.append(rounded.where(~F.col("open")).drop("h", "b"))
        todo = rounded.where("open").drop("open").withColumn("b", F.floor(F.col("b") / FAN).cast("int"))
        blocks, level = -(-blocks // FAN), level + 1
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def plan_mix(docs: DataFrame, weights: Iterable[float] = (1, 2, 3), cap: float = 3.0, seed: int = 7, residual: str = "partial") -> DataFrame:
    """How often each document is taken: doc_id, size, source_size, target, copies, taken.

    Sources, ordered by code point with null last, get ``weights`` in turn and share
    the words of all documents.  A document of a source with target ``t`` and size
    ``S`` is wanted ``t / S`` times: the whole part for certain, the rest by pivotal
    rounding in a tree: leaves of about 1,024 documents, whose residuals meet in
    nodes of 64 children up to one residual for each source.  ``residual`` says what
    that last document gives: ``partial`` takes the matching part of its words, so
    that a source meets its target to within a word; ``nearest`` rounds to whole copies.

    Empty and null texts have size 0 and are taken 0 words.  A null doc_id is a value
    like any other.  Rows of one source with one doc_id and text are alike: they are
    rounded against each other first, in any number, and only their last fraction enters
    the tree, so that they do not crowd a leaf.  No rows give no rows; other columns
    are ignored; texts may have any length.  The same input gives the same result
    however it is partitioned.  The table of sources, one row for each, is the only
    thing that comes to the driver, and is broadcast up to 100,000 of them; a hot source
    is many leaves.
    """
    with Work(docs.sparkSession, "mix-plan") as work:
        plan = _plan(docs, work, weights, cap, seed)
        # many alike rows are dealt out before they are listed
        many = plan.where("m > 1").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / LEAF))))
        many = many.repartition("k", "none", "th", "s", "chunk").withColumn("i", F.explode(F.sequence(F.col("chunk") * LEAF, F.least(F.col("m"), (F.col("chunk") + 1) * LEAF) - 1)))
        rows = plan.where("m = 1").withColumn("i", F.lit(0).cast("long")).unionByName(many.drop("chunk"))
        last = F.col("i") == F.col("certain")
        share = F.when(F.col("i") < F.col("certain"), 1.0).when(last, F.col("p")).otherwise(0.0)
        part = share if residual == "partial" else F.round(share)
        out = rows.select(
            F.when(~F.col("none"), F.col("k")).alias("doc_id"),
            "size",
            "source_size",
            "target",
            (F.col("whole") + F.round(share)).cast("int").alias("copies"),
            F.round((F.col("whole") + F.when(F.col("open") & last, part).otherwise(share)) * F.col("size")).cast("long").alias("taken"),
        )
        return staged(out, "mix")


def mix(docs: DataFrame, weights: Iterable[float] = (1, 2, 3), cap: float = 3.0, seed: int = 7) -> DataFrame:
    """The mixed corpus itself: each document as many times as the plan takes it whole.

    Of rows alike in source, doc_id and text, which may differ in other columns, any
    may be the ones taken once more.  Nulls, empty texts (which are taken 0 times or
    whole times, having no words), ties and empty tables are as in :func:`plan_mix`.
    All columns of ``docs`` stay, in their order, whatever their names.
    """
    source = [F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("source").isNull().alias("nowhere")]
    keys = ["k", "none", "th", "source", "nowhere"]
    with Work(docs.sparkSession, "mix-plan") as work:
        plan = _plan(docs, work, weights, cap, seed)
        plan = plan.withColumn("extra", F.col("certain") + F.round("p").cast("long"))
        plan = plan.select("k", "none", "th", *source, "whole", "m", "extra").where("whole > 0 OR extra > 0")
        plan = staged(plan, "mix-plan")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_keys(), *source)
    some = (F.col("extra") > 0) & (F.col("extra") < F.col("m"))
    rows = packed.join(plan.where(~some).hint("merge"), keys).select("row", (F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0)).alias("times"))
    if plan.where(some).limit(1).count():
        # alike rows are numbered in two steps: within a written part, after those of the parts before
        held = staged(packed.join(plan.where(some).hint("merge"), keys).withColumn("at", F.monotonically_increasing_id()), "mix-alike")
        held = held.withColumn("part", F.shiftright("at", 33))
        number = F.row_number().over(Window.partitionBy(*keys, "part").orderBy("at"))
        counts = held.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = held.withColumn("number", number).join(counts.withColumn("before", before).drop("n").hint("merge"), [*keys, "part"])
        rows = rows.unionByName(held.select("row", (F.col("whole") + F.when(F.col("number") + F.col("before") <= F.col("extra"), 1).otherwise(0)).alias("times")))
    return rows.where("times > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents"))
