"""Paired tests and decision rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _log_factorial(m: Column) -> Column:
    """ln m! of a count: summed up to 16, from there Stirling's series, exact to 1e-12."""
    few = F.aggregate(F.when((m >= 1) & (m <= 16), F.sequence(F.lit(1), m.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, x: s + F.log(x.cast("double")))
    x = F.greatest(m, F.lit(1)).cast("double")
    many = x * F.log(x) - x + F.log(x * 2 * math.pi) / 2 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(m <= 16, few).otherwise(many)


def sign_test(df: DataFrame, group: str, diff: str) -> DataFrame:
    """(group, better, worse, p): chance of at least as many positive differences under a fair coin; zeros dropped."""
    c = df.groupBy(group).agg(F.count(F.when(F.col(diff) > 0, 1)).alias("better"), F.count(F.when(F.col(diff) < 0, 1)).alias("worse"))
    n = F.col("better") + F.col("worse")
    # The tail that begins above the middle is summed and the other one is 1 minus it: there each term is the one
    # before times (n - k) / (k + 1) <= 1, and after 20 roots of n they have shrunk by more than exp(-800) to 0.
    upper = F.col("better") * 2 > n
    least = F.when(upper, F.col("better")).otherwise(F.col("worse") + 1)
    first = F.exp(_log_factorial(n) - _log_factorial(least) - _log_factorial(n - least) - n * F.log(F.lit(2.0)))
    last = F.least(n - 1, least + F.ceil(F.sqrt(n) * 20))
    step = lambda s, k: F.struct((s.t * (n - k) / (k + 1)).alias("t"), (s.p + s.t * (n - k) / (k + 1)).alias("p"))
    ks = F.when(last >= least, F.sequence(least, last)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(ks, F.struct(first.alias("t"), first.alias("p")), step, lambda s: s.p)
    p = F.when(least > n, F.lit(1.0)).when(upper, tail).otherwise(1 - tail)
    return c.where(n > 0).select(group, "better", "worse", p.alias("p"))


def signed_rank(df: DataFrame, group: str, diff: str) -> DataFrame:
    """(group, n, w_plus, z): rank sum of the positive differences with average ranks, zeros dropped."""
    d = df.where(F.col(diff).isNotNull() & (F.col(diff) != 0)).select(group, F.col(diff).alias("d"), F.abs(diff).alias("a"))
    cell = d.groupBy(group, "a").agg(F.count(F.lit(1)).alias("k"), F.count(F.when(F.col("d") > 0, 1)).alias("p"))
    before = F.sum("k").over(Window.partitionBy(group).orderBy("a")) - F.col("k")
    s = cell.withColumn("rank", before + (F.col("k") + 1) / 2).groupBy(group).agg(F.sum("k").alias("n"), F.sum(F.col("rank") * F.col("p")).alias("w_plus"), F.sum(F.pow("k", F.lit(3)) - F.col("k")).alias("ties"))
    n = F.col("n").cast("double")  # its cube exceeds 64 bits from 1.7 million differences on
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    return s.select(group, "n", "w_plus", ((F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(F.nullif(var, F.lit(0.0)))).alias("z"))


def normal_tail(z: Column, steps: int = 400) -> Column:
    """Chance that a standard normal value exceeds ``z``, by Simpson's rule from 0 to |z| (8 at most)."""
    a = F.least(F.abs(z), F.lit(8.0))
    h = a / steps
    weight = lambda i: F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    total = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda s, i: s + weight(i) * F.exp(-(i * h) * (i * h) / 2))
    half = total * h / 3 / math.sqrt(2 * math.pi)
    return F.when(z.isNull(), None).when(z >= 0, 0.5 - half).otherwise(0.5 + half)


def decision(gain: Column, top: float = 1.0, go: float = 1.5) -> Column:
    return F.when(gain >= go, "go").when(gain >= top, "borderline").otherwise("no")
