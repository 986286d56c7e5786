"""Beam decoding of many targets at once: a beam is a table, and a step is a few joins.

A machine is given by its *moves* (state, token, spelling, next): in a state it reads a
token, writes its spelling and goes on.  A source model over tokens is a table (ctx,
token, p, to): the probability of a token after a context, and the context after it; the
end is the token ``EOS``, and what has no row has probability 0.

A hypothesis of a target's prefix is (state, ctx, node): the state and context before the
current token, and what of its spelling has been written.  Its weight ``w`` is the
probability of the tokens before it, relative to that of the prefix (whose logarithm is
``logz``), so that weights of any depth are summed without loss.  Prefixes that targets
share are decoded once.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fsweave.operators.fixpoint import cut, new_path
from fsweave.operators.ngram import EOS

#: Share of a weight below which a chain of silent tokens is not followed.
SILENT = 1e-15


def context_model(counts: DataFrame, n: int, sep: str = " ") -> DataFrame:
    """(ctx, token, p, to) of n-gram counts (:func:`ngram.ngram_counts` with the same ``sep``), by relative frequency.

    A sequence begins in the empty context.  After a token the context is the last
    ``n - 1`` symbols; every one that can come up was counted.  Symbols must not hold
    ``sep``.
    """
    totals = counts.groupBy("ord", "ctx").agg(F.sum("cnt").alias("total"))
    longer = F.when(F.col("ord") == 0, F.col("sym")).otherwise(F.concat("ctx", F.lit(sep), "sym"))
    after = F.lit("") if n == 1 else F.when(F.col("ord") < n - 1, longer).otherwise(F.substring_index(longer, sep, -(n - 1)))
    rows = counts.join(totals, ["ord", "ctx"])
    return rows.select("ctx", F.col("sym").alias("token"), (F.col("cnt") / F.col("total")).alias("p"), F.when(F.col("sym") != EOS, after).alias("to"))


class HubTables:
    """What a step looks up, made once from moves and model.

    ``masses`` (state, ctx, node, mass): probability of the tokens whose spellings start
    with a node.  ``ends`` (state, ctx, node, next, to, p): tokens whose spelling is the
    node, with all silent tokens that can follow.  Both are kept parted and sorted by their keys,
    so that steps need not shuffle or sort them again.
    """

    def __init__(self, moves: DataFrame, model: DataFrame, starts: list, finals: list):
        self.starts, self.finals, self.model = starts, finals, model
        both = cut(moves.join(model.where(F.col("to").isNotNull()), "token").select("state", "ctx", "spelling", "next", "to", "p"))
        at = F.explode(F.sequence(F.lit(1), F.length("spelling")))
        spread = both.where("spelling <> ''").select("state", "ctx", F.col("spelling").alias("s"), "p", at.alias("k"))
        keys = ["state", "ctx", "node"]
        self.masses = cut(spread.groupBy("state", "ctx", F.expr("left(s, k)").alias("node")).agg(F.sum("p").alias("mass")).repartition(*keys).sortWithinPartitions(*keys))
        self.silent = both.where("spelling = ''").select("state", "ctx", "next", "to", "p")
        plain = both.where("spelling <> ''").select("state", "ctx", F.col("spelling").alias("node"), "next", "to", "p")
        self.ends = cut(self.quietly(plain, keys).repartition(*keys).sortWithinPartitions(*keys))

    @cached_property
    def has_silent(self) -> bool:
        return not self.silent.isEmpty()

    def quietly(self, rows: DataFrame, keys: list[str], rounds: int = 1000) -> DataFrame:
        """Rows (``keys``, next, to, p), equal ones summed, and those after any silent tokens."""
        add = lambda df: df.groupBy(*keys, "next", "to").agg(F.sum("p").alias("p"))
        new = found = cut(add(rows))
        hop = self.silent.select(F.col("state").alias("next"), F.col("ctx").alias("to"), F.col("next").alias("n2"), F.col("to").alias("t2"), F.col("p").alias("q"))
        for _ in range(rounds if self.has_silent else 0):
            moved = new.join(hop, ["next", "to"]).select(*keys, F.col("n2").alias("next"), F.col("t2").alias("to"), (F.col("p") * F.col("q")).alias("p"))
            new = cut(add(moved).where(F.col("p") > SILENT))
            if new.isEmpty():
                return add(found)
            found = found.unionByName(new)
        if self.has_silent:
            raise RuntimeError(f"silent tokens go on after {rounds} rounds")
        return found

    @cached_property
    def children(self) -> DataFrame:
        """(state, ctx, node, sym, mass): the masses one symbol further."""
        return self.masses.select("state", "ctx", F.expr("left(node, length(node) - 1)").alias("node"), F.expr("right(node, 1)").alias("sym"), "mass")


class Beams:
    """The decoded prefixes of a column of targets.

    ``rows`` has (depth, prefix, state, ctx, node, w, logz), with the hypotheses carried on
    from each prefix; it lies in the shared folder until :meth:`drop`.  Executors add a
    prefix's shares in any order, so ``logz`` is the same in all its rows but for the last
    digits: nothing may be grouped or joined by it.
    """

    def __init__(self, rows: DataFrame, path: str, tables: HubTables):
        self.rows, self.path, self.tables = rows, path, tables

    def logprefix(self) -> DataFrame:
        """(prefix, logp): log probability that an output starts with the prefix; prefixes that none does have no row."""
        return self.rows.groupBy("prefix").agg(F.max("logz").alias("logp"))

    def _ended(self) -> DataFrame:
        """(prefix, logz, mass): weight of the sources whose output is the prefix."""
        end = self.tables.model.where(F.col("token") == EOS).select("ctx", "p")
        rows = self.rows.where((F.col("node") == "") & F.col("state").isin(self.tables.finals)).join(end, "ctx")
        return rows.groupBy("prefix").agg(F.max("logz").alias("logz"), F.sum(F.col("w") * F.col("p")).alias("mass"))

    def logprob(self) -> DataFrame:
        """(prefix, logp): log probability that an output is the prefix."""
        return self._ended().select("prefix", (F.col("logz") + F.ln("mass")).alias("logp"))

    def next_symbols(self) -> DataFrame:
        """(prefix, sym, p): what follows a prefix in the outputs that start with it, the end (``EOS``) included."""
        on = self.rows.join(self.tables.children, ["state", "ctx", "node"]).groupBy("prefix", "sym").agg(F.sum(F.col("w") * F.col("mass")).alias("mass"))
        all_ = on.unionByName(self._ended().select("prefix", F.lit(EOS).alias("sym"), "mass"))
        total = all_.groupBy("prefix").agg(F.sum("mass").alias("total"))
        return all_.join(total, "prefix").select("prefix", "sym", (F.col("mass") / F.col("total")).alias("p"))

    def drop(self) -> None:
        """Delete the stored beams."""
        spark = self.rows.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def decode(targets: DataFrame, column: str, tables: HubTables, k: int | None = None, ratio: float | None = None, extend: float = 0.0, most: int | None = None) -> Beams:
    """Move beams along all targets, a symbol in each round, for all prefixes of that length together.

    A step joins the beams with the next symbols of their prefixes and with the masses of
    the nodes reached; then each prefix's beam is scored and pruned to the ``k`` best
    hypotheses, none under the best by more than the factor ``ratio``.  Hypotheses at a token's
    end also start the next token, if they have ``extend`` of the prefix's mass at least and
    are among the ``most`` best of these.  Without bounds that bite, results are exact.

    Rounds are as many as the longest target has symbols.  A round's rows are written and
    read by the next, so a lost executor costs one round.  The rank of a hypothesis is
    taken within tasks first, then for each prefix, so a prefix with many hypotheses
    sends ``k`` of a task at most.  Null targets are ignored, the empty one has the start.
    """
    spark = targets.sparkSession
    path = new_path(spark, "beams")
    at = F.explode(F.sequence(F.lit(1), F.length("x")))
    texts = targets.where(F.col(column).isNotNull() & (F.length(column) > 0)).select(F.col(column).alias("x")).distinct()
    edges = texts.select("x", at.alias("k")).select((F.col("k") - 1).alias("depth"), F.expr("left(x, k - 1)").alias("prefix"), F.expr("substring(x, k, 1)").alias("sym")).distinct()
    edges = cut(edges)
    longest = (edges.agg(F.max("depth")).first()[0] + 1) if not edges.isEmpty() else 0
    begin = spark.createDataFrame([(s,) for s in tables.starts], "next string")  # the machine's start states
    begin = begin.select(F.lit("").alias("prefix"), "next", F.lit("").alias("to"), F.lit(1.0).alias("p"))
    first = tables.quietly(begin, ["prefix"]).select("prefix", F.col("next").alias("state"), F.col("to").alias("ctx"), F.lit("").alias("node"), F.col("p").alias("w"), F.lit(0.0).alias("logz"))
    schema = "prefix string, state string, ctx string, node string, w double, logz double"
    first.write.parquet(f"{path}/depth=0")
    per = Window.partitionBy("prefix")
    best = per.orderBy(F.desc("share"), "state", "ctx", "node")
    for depth in range(longest):
        beam = spark.read.schema(schema).parquet(f"{path}/depth={depth}")
        moved = beam.join(edges.where(F.col("depth") == depth).select("prefix", "sym"), "prefix")
        moved = moved.select(F.concat("prefix", "sym").alias("prefix"), "state", "ctx", F.concat("node", "sym").alias("node"), "w", "logz").join(tables.masses, ["state", "ctx", "node"])
        moved = cut(moved.withColumn("share", F.col("w") * F.col("mass")))
        totals = moved.groupBy("prefix").agg(F.sum("share").alias("total"), F.max("share").alias("top"), F.max("logz").alias("before"))
        if k is not None:
            moved = moved.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if ratio is not None:
            moved = moved.join(totals.select("prefix", "top"), "prefix").where(F.col("share") * ratio >= F.col("top"))
        kept = moved.join(totals.select("prefix", "total", "before"), "prefix").where("total > 0")
        kept = kept.select("prefix", "state", "ctx", "node", (F.col("w") / F.col("total")).alias("w"), (F.col("before") + F.ln("total")).alias("logz"), (F.col("share") / F.col("total")).alias("share"))
        able = kept.where(F.col("share") >= extend) if extend else kept
        if most is not None:
            ending = able.join(tables.ends.select("state", "ctx", "node").distinct(), ["state", "ctx", "node"], "left_semi")
            able = ending.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
        begun = able.join(tables.ends, ["state", "ctx", "node"]).groupBy("prefix", "next", "to").agg(F.sum(F.col("w") * F.col("p")).alias("w"), F.max("logz").alias("logz"))
        begun = begun.select("prefix", F.col("next").alias("state"), F.col("to").alias("ctx"), F.lit("").alias("node"), "w", "logz")
        kept.drop("share").unionByName(begun).write.parquet(f"{path}/depth={depth + 1}")
    rows = spark.read.schema(schema + ", depth int").option("basePath", path).parquet(path)
    return Beams(rows, path, tables)
