"""N-gram sequence models trained and scored with joins and aggregations."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names the end of a sequence in tables.
EOS = "<EOS>"


def symbols(df: DataFrame, key: str, column: Column, *others: str) -> DataFrame:
    """(key, symbols) and ``others``: a text's characters as an array; an empty text has none."""
    return df.select(key, *others, F.when(column == "", F.array().cast("array<string>")).otherwise(F.split(column, "")).alias("symbols"))


def ngram_counts(sequences: DataFrame, n: int, sep: str = "", weight: str | None = None) -> DataFrame:
    """(ord, ctx, sym, cnt) for contexts of 0 to n-1 symbols, the end of each sequence included.

    ``sequences`` has an array column ``symbols``.  A context is its symbols joined by
    ``sep``; contexts never cross sequences.  Counts are partial before the shuffle.
    ``weight`` names a column with how often a sequence occurs; without it each row is one.
    """
    times = F.lit(1) if weight is None else F.col(weight)
    ended = F.array_append(F.col("symbols"), F.lit(EOS))
    at = sequences.select(ended.alias("s"), times.alias("times")).select("s", "times", F.posexplode("s").alias("k", "sym"))
    orders = F.explode(F.sequence(F.lit(0), F.least(F.lit(n - 1), F.col("k"))))
    rows = at.select("s", "times", "k", "sym", orders.alias("ord"))
    ctx = F.array_join(F.slice("s", F.col("k") - F.col("ord") + 1, F.col("ord")), sep)
    return rows.select("ord", ctx.alias("ctx"), "sym", "times").groupBy("ord", "ctx", "sym").agg((F.count(F.lit(1)) if weight is None else F.sum("times")).alias("cnt"))


def smoothed(counts: DataFrame, alpha: float, alphabet: DataFrame | None = None) -> DataFrame:
    """(ord, ctx, sym, logp): (cnt + alpha) / (total + V alpha) for every symbol in every seen context.

    V counts the alphabet with the end.  The alphabet is a few hundred symbols at most
    (bytes or characters); its size is checked before it is sent to every task.
    """
    alphabet = alphabet if alphabet is not None else counts.select("sym").distinct()
    v = alphabet.count()
    if v > 100_000:
        raise ValueError("smoothing lists every symbol in every context; this alphabet is too large for that")
    totals = counts.groupBy("ord", "ctx").agg(F.sum("cnt").alias("total"))
    filled = totals.join(F.broadcast(alphabet.select("sym"))).join(counts, ["ord", "ctx", "sym"], "left")
    p = (F.coalesce("cnt", F.lit(0)) + alpha) / (F.col("total") + v * alpha)
    return filled.select("ord", "ctx", "sym", F.ln(p).alias("logp"))


def score(sequences: DataFrame, key: str, counts: DataFrame, n: int, alpha: float, vocabulary: int, sep: str = "", end: bool = True) -> DataFrame:
    """(key, logp): log probability of each sequence, backing off to the longest seen context, without interpolation.

    Every position asks for its contexts of all orders; an equi-join finds those that
    were seen, and the longest one counts.  A position with no seen context is uniform.
    Contexts are spelled out before the rows part, so that no row carries its sequence.
    """
    size = F.size("symbols") + int(end)
    s = F.array_append(F.col("symbols"), F.lit(EOS)) if end else F.col("symbols")
    rows = sequences.select(F.col(key).alias("id"), s.alias("s"), size.alias("size"))

    def asks(k):
        """What position ``k`` (from 0) asks for: the symbol after each of its contexts."""
        context = lambda o: F.array_join(F.slice("s", k - o + 1, o), sep)
        return F.transform(F.sequence(F.lit(0), F.least(F.lit(n - 1), k)), lambda o: F.struct(k.alias("k"), F.get("s", k).alias("sym"), o.alias("ord"), context(o).alias("ctx")))

    all_asks = F.flatten(F.transform(F.sequence(F.lit(0), F.col("size") - 1), asks))
    asked = rows.where("size > 0").select("id", F.explode(all_asks).alias("q")).select("id", "q.k", "q.sym", "q.ord", "q.ctx")
    totals = counts.groupBy("ord", "ctx").agg(F.sum("cnt").alias("total"))
    hit = asked.join(totals, ["ord", "ctx"]).join(counts.select("ord", "ctx", "sym", "cnt"), ["ord", "ctx", "sym"], "left")
    best = hit.groupBy("id", "k").agg(F.max_by(F.struct(F.coalesce("cnt", F.lit(0)).alias("cnt"), "total"), "ord").alias("b"))
    p = F.ln((F.col("b.cnt") + alpha) / (F.col("b.total") + vocabulary * alpha))
    found = best.groupBy("id").agg(F.sum(p).alias("seen"), F.count(F.lit(1)).alias("hits"))
    missing = (F.col("size") - F.coalesce("hits", F.lit(0))) * math.log(1 / vocabulary)
    return rows.select("id", "size").join(found, "id", "left").select(F.col("id").alias(key), (F.coalesce("seen", F.lit(0.0)) + missing).alias("logp"))


class NgramModel:
    """The same model on one machine, as a state machine over contexts; for searches inside tasks.

    ``vocabulary`` fixes V where it is not the alphabet's size with the end (256 for bytes).
    """

    def __init__(self, n: int, alpha: float, alphabet: Iterable, counts: dict, vocabulary: int | None = None, eos=EOS):
        self.n, self.alpha, self.eos = n, alpha, eos
        self.alphabet = sorted(set(alphabet) - {eos}, key=repr)
        self.counts = counts
        self.v = vocabulary or len(self.alphabet) + 1

    @staticmethod
    def train(sequences: Iterable[Iterable], n: int, alpha: float = 1.0, alphabet: Iterable = (), vocabulary: int | None = None, eos=EOS) -> NgramModel:
        counts: dict = defaultdict(Counter)
        letters = set(alphabet)
        for xs in sequences:
            xs = [*xs, eos]
            letters.update(xs)
            for k, x in enumerate(xs):
                for order in range(min(n - 1, k) + 1):
                    counts[tuple(xs[k - order : k])][x] += 1
        return NgramModel(n, alpha, letters, dict(counts), vocabulary, eos)

    @staticmethod
    def bytes(data: bytes | Iterable[bytes], n: int, alpha: float = 1.0) -> NgramModel:
        """Over bytes: 256 symbols, of which byte 0 is the end."""
        data = [data] if isinstance(data, bytes) else data
        return NgramModel.train(data, n, alpha, range(1, 256), 256, eos=0)

    def context(self, xs: tuple) -> tuple:
        """The longest seen suffix of the last n-1 symbols."""
        ctx = tuple(xs[max(0, len(xs) - self.n + 1) :]) if self.n > 1 else ()
        while ctx and ctx not in self.counts:
            ctx = ctx[1:]
        return ctx

    def logp(self, ctx: tuple, x) -> float:
        seen = self.counts.get(self.context(ctx))
        if seen is None:
            return math.log(1 / self.v)
        return math.log((seen[x] + self.alpha) / (sum(seen.values()) + self.v * self.alpha)) if seen[x] + self.alpha else float("-inf")

    def logp_next(self, ctx: tuple) -> dict:
        return {x: self.logp(ctx, x) for x in [*self.alphabet, self.eos]}

    def logprefix(self, xs: Iterable) -> float:
        xs = tuple(xs)
        return sum(self.logp(xs[:k], x) for k, x in enumerate(xs))

    def logprob(self, xs: Iterable) -> float:
        xs = tuple(xs)
        return self.logprefix(xs) + self.logp(xs, self.eos)


class FiniteModel:
    """A distribution over finitely many strings, with the same interface."""

    def __init__(self, probability: dict, eos=EOS):
        self.p, self.eos = {tuple(x): p for x, p in probability.items()}, eos
        self.alphabet = sorted({a for x in self.p for a in x}, key=repr)

    def mass(self, xs: tuple) -> float:
        return sum(p for x, p in self.p.items() if x[: len(xs)] == xs)

    def logp_next(self, xs: tuple) -> dict:
        xs, total = tuple(xs), self.mass(tuple(xs))
        log = lambda p: math.log(p / total) if p and total else float("-inf")
        return {a: log(self.mass((*xs, a))) for a in self.alphabet} | {self.eos: log(self.p.get(xs, 0.0))}

    def logp(self, xs: tuple, a) -> float:
        return self.logp_next(xs).get(a, float("-inf"))

    def logprefix(self, xs: Iterable) -> float:
        m = self.mass(tuple(xs))
        return math.log(m) if m else float("-inf")

    def logprob(self, xs: Iterable) -> float:
        p = self.p.get(tuple(xs), 0.0)
        return math.log(p) if p else float("-inf")


def greedy(model, longest: int) -> tuple:
    """Take the likeliest symbol until the end; ties go to the first by name."""
    xs: tuple = ()
    while len(xs) < longest:
        nexts = model.logp_next(xs)
        best = max(sorted(nexts, key=repr), key=nexts.get)
        if best == model.eos:
            break
        xs = (*xs, best)
    return xs


def sample(model, longest: int, rng) -> tuple:
    """Draw symbols until the end, with the given generator."""
    xs: tuple = ()
    while len(xs) < longest:
        nexts = sorted(model.logp_next(xs).items(), key=repr)
        u, total = rng.random(), 0.0
        for a, lp in nexts:
            total += math.exp(lp)
            if u < total:
                break
        if a == model.eos:
            break
        xs = (*xs, a)
    return xs


def sampled(df: DataFrame, keys: list[str], weight: str, u: Column) -> DataFrame:
    """One row for each key, by inverse cumulative weight: the first whose running share exceeds ``u``."""
    order = [c for c in df.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__run", F.sum(weight).over(w)).withColumn("__all", F.sum(weight).over(Window.partitionBy(*keys))).withColumn("__u", u)
    first = Window.partitionBy(*keys).orderBy("__run", *order)
    return rows.where(F.col("__run") > F.col("__u") * F.col("__all")).withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r", "__run", "__all", "__u")
