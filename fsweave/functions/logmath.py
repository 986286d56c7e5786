"""Log-space arithmetic as column expressions and aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUS_INF = float("-inf")


def safe_log(p: Column) -> Column:
    """ln with -inf at 0, where Spark's gives null."""
    return F.when(p == 0, F.lit(MINUS_INF)).otherwise(F.ln(p))


def log1mexp(x: Column) -> Column:
    """log(1 - exp(x)) for x <= 0, by whichever form loses no digits; -inf at 0."""
    near = safe_log(-F.expm1(x))
    return F.when(x >= 0, F.lit(MINUS_INF)).when(x > -math.log(2), near).otherwise(F.log1p(-F.exp(x)))


def logsumexp(df: DataFrame, keys: list[str], value: str, to: str) -> DataFrame:
    """ln(sum(exp(value))) for each key; -inf where all are -inf.

    The maximum comes from a first aggregation, so that nothing overflows; both sums
    are partial before they are shuffled.
    """
    top = df.groupBy(*keys).agg(F.max(value).alias("__m")) if keys else df.agg(F.max(value).alias("__m"))
    both = df.join(top, keys) if keys else df.crossJoin(F.broadcast(top))  # one row
    shifted = F.when(F.col("__m") == MINUS_INF, F.lit(0.0)).otherwise(F.exp(F.col(value) - F.col("__m")))
    out = both.groupBy(*keys, "__m").agg(F.sum(shifted).alias("__s"))
    return out.select(*keys, (F.col("__m") + safe_log(F.col("__s"))).alias(to))


def logsumexp_over(value: Column, window) -> Column:
    """The same over a window, for keys with few rows each."""
    m = F.max(value).over(window)
    return F.when(m == MINUS_INF, F.lit(MINUS_INF)).otherwise(m + F.ln(F.sum(F.exp(value - m)).over(window)))


def normalized(df: DataFrame, keys: list[str], value: str, to: str) -> DataFrame:
    """Log weights minus their log sum within each key."""
    return df.withColumn(to, F.col(value) - logsumexp_over(F.col(value), Window.partitionBy(*keys)))


def log_softmax(values: Column) -> Column:
    """Log-softmax of an array column."""
    m = F.array_max(values)
    total = F.ln(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - m)))
    return F.transform(values, lambda x: x.cast("double") - m - total)


def top_k(df: DataFrame, keys: list[str], value: str, k: int, tie: list[str]) -> DataFrame:
    """The k largest values of each key; equal values in order of ``tie``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), *tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def logsumexp_list(values: list[float]) -> float:
    m = max(values, default=MINUS_INF)
    return m if m == MINUS_INF else m + math.log(sum(math.exp(v - m) for v in values))
