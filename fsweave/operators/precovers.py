"""Decompositions of many targets at once, as tables of (target, source) pairs.

For a machine f and a target y, a source x is in Q(y) if every string that starts with x
is given an output that starts with y, and no shorter start of x has that property; it is
in R(y) if f(x) starts with y but no start of x is in Q(y).

A pair carries its *members*: the states that x leads to with what was written on the
way, as far as that agrees with y.  Longer targets take over their parents' pairs, with
the members that still agree; longer sources extend pairs that are not in Q by one
arc.  A pair is met after exactly ``len(y) + len(x)`` steps, so a round never meets a
pair of an earlier one, and only new pairs are worked out.  Targets share the work of the
prefixes they share.

Whether a pair is in Q depends on its *signature* alone: states with what each still has to
write.  A machine has few of them; each is decided once, for all pairs that have it.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fsweave.operators.algebra import closure, trim
from fsweave.operators.fixpoint import cut, fixpoint, new_path
from fsweave.plans.machine import EPS, Machine
from fsweave.plans.precover import Universality, universal_states

MEMBERS = "array<struct<q:int,out:string>>"
#: Parts of a signature.
_STATE, _MEMBER = "\x1f", "\x1e"


def decide_needs(m: Machine, alone: frozenset):
    """A test of sets of (state, what is still to be written): does every input lead to an end with nothing left?"""

    def write(need: str, b) -> str | None:
        if b == EPS or not need:
            return need
        return need[1:] if need[0] == b else None

    def quiet(s):
        return [(j, t) for b, j in m.on(s[0], EPS) if (t := write(s[1], b)) is not None]

    def step(subset: frozenset) -> dict:
        to: dict = defaultdict(list)
        for q, need in subset:
            for a, b, j in m.out(q):
                if a != EPS and (t := write(need, b)) is not None:
                    to[a].append((j, t))
        return {a: frozenset(closure(pairs, quiet)) for a, pairs in to.items()}

    return Universality(step, lambda s: any(q in m.finals and not need for q, need in s), m.reads, lambda s: not s[1] and s[0] in alone)


class Precovers:
    """A machine's moves as tables, and what is known of signatures.

    The machine's labels are single characters.  An endless chain of arcs that read nothing
    but write is an error, since then an input has endlessly many outputs.
    """

    def __init__(self, spark: SparkSession, m: Machine):
        self.spark, self.m = spark, trim(m).renumber()
        arcs, states = self.m.to_df(spark)
        hop = arcs.where(F.col("ilabel") == "").select(F.col("src").alias("q"), "olabel", "dst")
        seed = states.select(F.col("state").alias("src"), F.lit("").alias("out"), F.col("state").alias("q"))
        quiet = fixpoint(seed, lambda new: new.join(hop, "q").select("src", F.concat("out", "olabel").alias("out"), F.col("dst").alias("q")), 1000)
        #: (q, out, to): what is reached without reading.
        self.quiet = quiet.select(F.col("src").alias("q"), "out", F.col("q").alias("to"))
        read = arcs.where(F.col("ilabel") != "").select(F.col("src").alias("from"), F.col("ilabel").alias("label"), F.col("olabel").alias("first"), F.col("dst").alias("q"))
        #: (q, label, out, to): a symbol read, and then anything without reading.
        self.moves = cut(read.join(self.quiet, "q").select(F.col("from").alias("q"), "label", F.concat("first", "out").alias("out"), "to").distinct())
        self.begin = cut(states.where("is_start").select(F.col("state").alias("q")).join(self.quiet, "q").select(F.col("to").alias("q"), "out").distinct())
        self.finals = sorted(self.m.finals)
        self.alone = universal_states(self.m)
        self.shared = spark.sparkContext.broadcast(self.m)
        self.known = spark.createDataFrame([], "signature string, universal boolean")

    # Classification

    def paired(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """A row for each pair of members (``keys``, q, out), with ``aim``, the target they are judged by, in ``keys``."""
        past = F.startswith("out", "aim")
        need = F.when(past, F.lit("")).otherwise(F.expr("substring(aim, length(out) + 1)"))
        name = F.concat(F.col("q").cast("string"), F.lit(_STATE), need)
        return rows.groupBy(*keys).agg(
            F.array_sort(F.collect_set(F.struct("q", "out"))).alias("members"),
            F.max(past & F.col("q").isin(self.finals)).alias("member"),
            F.max(past & F.col("q").isin(sorted(self.alone))).alias("sure"),
            F.array_join(F.array_sort(F.collect_set(name)), _MEMBER).alias("signature"),
        )

    def judged(self, pairs: DataFrame, path: str) -> DataFrame:
        """``pairs`` with ``part``: Q, R or neither; written to ``path``.  Signatures met for the first time are decided in tasks."""
        once = pairs.join(self.known, "signature", "left")
        part = F.when(~F.col("member"), "").when(F.col("sure") | F.col("universal"), "Q").when(F.col("universal").isNotNull(), "R")
        once.withColumn("part", part).drop("sure", "universal", "member").write.parquet(path)
        out = self.spark.read.parquet(path)
        new = out.where(F.col("part").isNull()).select("signature").distinct()
        if new.isEmpty():
            return out
        fresh = cut(self.decided(new))
        self.known = cut(self.known.unionByName(fresh))
        late = F.coalesce("part", F.when(F.col("universal"), "Q").otherwise("R"))
        out.join(fresh, "signature", "left").withColumn("part", late).drop("universal").write.parquet(path + "-all")
        return self.spark.read.parquet(path + "-all")

    def decided(self, signatures: DataFrame) -> DataFrame:
        """(signature, universal) of distinct signatures, by a search over sets of the machine's states."""
        shared, alone = self.shared, self.alone

        def run(batches):
            decide = decide_needs(shared.value, alone)
            for batch in batches:
                texts = batch.column(0).to_pylist()
                sets = [frozenset((int(q), need) for q, _, need in (m.partition(_STATE) for m in t.split(_MEMBER))) for t in texts]
                yield pa.RecordBatch.from_pydict({"signature": pa.array(texts, pa.string()), "universal": pa.array([decide(s) for s in sets], pa.bool_())})

        return signatures.mapInArrow(run, "signature string, universal boolean")

    @staticmethod
    def agreeing(rows: DataFrame, aim: str = "target") -> DataFrame:
        """Rows whose output goes with the target: one starts with the other."""
        return rows.where(F.startswith("out", aim) | F.startswith(aim, "out"))

    def extended(self, rows: DataFrame, *keep: str) -> DataFrame:
        """Members (target, source, q, out) after one more symbol of the source."""
        moved = rows.join(F.broadcast(self.moves.withColumnRenamed("out", "more")), "q")  # a machine's arcs, whose number does not grow with the data
        return moved.select("target", F.concat("source", "label").alias("source"), F.col("to").alias("q"), F.concat("out", "more").alias("out"), *keep)

    # Incremental decomposition

    def decompose(self, targets: DataFrame, column: str, longest: int | None = None) -> Decompositions:
        """Q and R of all prefixes of all targets.

        Rounds are as many as the longest target and its sources have symbols.  ``longest``
        bounds the sources' length, where Q or R is infinite; without it the search goes on
        until no pair is left.  Null targets are ignored; the empty target is always there.
        Rounds are written and read by the next.
        """
        path = new_path(self.spark, "precovers")
        texts = targets.where(F.length(column) > 0).select(F.col(column).alias("x")).distinct()
        at = F.explode(F.sequence(F.lit(1), F.length("x")))
        steps = texts.select("x", at.alias("k")).select(F.expr("left(x, k - 1)").alias("target"), F.expr("left(x, k)").alias("longer")).distinct()
        steps = cut(steps.repartition("target"))
        rows = self.begin.select(F.lit("").alias("target"), F.lit("").alias("source"), "q", "out")
        k = 0
        while True:
            pairs = self.paired(rows.withColumn("aim", F.col("target")), ["target", "source", "aim"]).drop("aim")
            done = self.judged(pairs, f"{path}/round={k}")
            if done.isEmpty():
                return Decompositions(self, path, k)
            open_ = done.select("target", "source", "part", F.explode("members").alias("m")).select("target", "source", "part", "m.q", "m.out")
            on = open_.where(F.col("part") != "Q")
            if longest is not None:
                on = on.where(F.length("source") < longest)
            taken = open_.where(F.col("part") != "").join(steps, "target").select(F.col("longer").alias("target"), "source", "q", "out")
            rows = self.agreeing(self.extended(on).unionByName(taken))
            k += 1


class Decompositions:
    """All pairs of a run, in the shared folder until :meth:`drop`: a part for each round."""

    def __init__(self, precovers: Precovers, path: str, rounds: int):
        self.precovers, self.path, self.rounds = precovers, path, rounds

    def pairs(self) -> DataFrame:
        """(target, source, part, members); part is empty for pairs that were only passed through."""
        precovers = self.precovers
        fs = precovers.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        names = [str(f.getPath()) for f in fs.getFileSystem(precovers.spark._jsc.hadoopConfiguration()).listStatus(fs)]
        late = {n[: -len("-all")] for n in names if n.endswith("-all")}
        return precovers.spark.read.schema(f"target string, source string, members {MEMBERS}, part string").parquet(*[n for n in names if n not in late])

    def parts(self) -> DataFrame:
        """(target, source, part) with part Q or R."""
        return self.pairs().where(F.col("part") != "").select("target", "source", "part")

    def exact(self, longest: int | None = None) -> DataFrame:
        """(target, source): sources whose output is the target, for all targets at once.

        Pairs go on as long as nothing beyond the target is written; where that never ends, ``longest`` bounds the sources' length.
        """
        p = self.precovers
        seed = self.pairs().where(F.col("part") != "").select("target", "source", F.explode("members").alias("m")).select("target", "source", "m.q", "m.out")
        inside = lambda rows: rows.where(F.startswith("target", "out") & (F.length("source") <= longest if longest is not None else F.lit(True)))
        rows = fixpoint(inside(seed), lambda new: inside(p.extended(new)))
        return rows.where((F.col("out") == F.col("target")) & F.col("q").isin(p.finals)).select("target", "source").distinct()

    def next_symbols(self, targets: DataFrame, column: str, longest: int | None = None) -> DataFrame:
        """(target, sym, source, part): Q and R of each target with any one symbol after it, by one search for all symbols.

        A member has what was written up to one symbol beyond the target.  Members that
        have not come so far count for every symbol, the others for theirs: a pair is split
        by the symbol beyond when it is judged, not when it is searched.  A pair that is in
        Q of one symbol goes no further.  ``targets`` are prefixes that were decomposed.
        """
        p = self.precovers
        wanted = targets.where(F.col(column).isNotNull()).select(F.col(column).alias("target")).distinct()
        seed = self.pairs().where(F.col("part") != "").join(wanted, "target", "left_semi")
        rows = seed.select("target", "source", F.explode("members").alias("m")).select("target", "source", "m.q", "m.out")
        found, k, path = None, 0, new_path(p.spark, "next-symbols")
        window = F.expr("left(out, length(target) + 1)")
        while True:
            rows = cut(rows.withColumn("out", window).distinct())
            if rows.isEmpty():
                break
            ahead = rows.where(F.length("out") > F.length("target")).select("target", "source", F.right("out", F.lit(1)).alias("sym")).distinct()
            split = rows.join(ahead, ["target", "source"]).where((F.length("out") <= F.length("target")) | (F.right("out", F.lit(1)) == F.col("sym")))
            pairs = p.paired(split.withColumn("aim", F.concat("target", "sym")), ["target", "source", "sym", "aim"]).drop("aim")
            done = p.judged(pairs, f"{path}/round={k}")
            some = done.where(F.col("part") != "").select("target", "sym", "source", "part")
            found = some if found is None else found.unionByName(some)
            on = rows.join(done.where(F.col("part") == "Q").select("target", "source"), ["target", "source"], "left_anti")
            if longest is not None:
                on = on.where(F.length("source") < longest)
            rows, k = p.agreeing(p.extended(on)), k + 1
        empty = p.spark.createDataFrame([], "target string, sym string, source string, part string")
        return empty if found is None else found.distinct()

    def drop(self) -> None:
        """Delete the stored pairs."""
        spark = self.precovers.spark
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
