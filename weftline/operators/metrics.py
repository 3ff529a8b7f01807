"""Scores of one partition against another, by contingency tables that are aggregated before they are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def partition_scores(df: DataFrame, group: str, truth: str, found: str) -> DataFrame:
    """(group, n, ari, nmi, combined) of each group; rows with a null label take no part, -1 is a label like others.

    Undefined ratios (both partitions trivial) are 1.  ``combined`` is the mean of NMI and ARI floored at 0.
    """
    cell = df.where(F.col(truth).isNotNull() & F.col(found).isNotNull()).groupBy(group, truth, found).agg(F.count(F.lit(1)).cast("double").alias("n"))
    plogp = lambda n: n * F.log(n)
    a = cell.groupBy(group, truth).agg(F.sum("n").alias("n")).groupBy(group).agg(F.sum("n").alias("n"), F.sum(_pairs(F.col("n"))).alias("pa"), F.sum(plogp(F.col("n"))).alias("la"))
    b = cell.groupBy(group, found).agg(F.sum("n").alias("n")).groupBy(group).agg(F.sum(_pairs(F.col("n"))).alias("pb"), F.sum(plogp(F.col("n"))).alias("lb"))
    c = cell.groupBy(group).agg(F.sum(_pairs(F.col("n"))).alias("pc"), F.sum(plogp(F.col("n"))).alias("lc"))
    t = a.join(b, group).join(c, group)
    n = F.col("n")
    expected = F.col("pa") * F.col("pb") / F.nullif(_pairs(n), F.lit(0.0))
    below = (F.col("pa") + F.col("pb")) / 2 - expected
    ari = F.when(F.coalesce(F.abs(below), F.lit(0.0)) < 1e-12, 1.0).otherwise((F.col("pc") - expected) / below)
    # entropies from the sums of n log n
    ha, hb = F.log(n) - F.col("la") / n, F.log(n) - F.col("lb") / n
    mutual = ha + hb - (F.log(n) - F.col("lc") / n)
    nmi = F.when(ha + hb < 1e-12, 1.0).otherwise(F.greatest(mutual, F.lit(0.0)) / ((ha + hb) / 2))
    t = t.select(group, n.cast("long").alias("n"), ari.alias("ari"), nmi.alias("nmi"))
    return t.withColumn("combined", (F.greatest("ari", F.lit(0.0)) + F.col("nmi")) / 2)


def rank_auc(df: DataFrame, group: str, score: str, positive: str) -> DataFrame:
    """(group, auc): the rank-sum statistic with average ranks, from counts per distinct score."""
    from pyspark.sql import Window

    cell = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(group, score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(positive).cast("long")).alias("p"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy(score)) - F.col("n")
    ranks = cell.withColumn("rank", before + (F.col("n") + 1) / 2)
    s = ranks.groupBy(group).agg(F.sum(F.col("rank") * F.col("p")).alias("s"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return s.where("p > 0 and q > 0").select(group, ((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def precision_at(df: DataFrame, group: str, score: str, positive: str, id_col: str, share: float) -> DataFrame:
    """(group, precision): share of positives among the ``share`` of each group's rows with the highest score."""
    from pyspark.sql import Window

    each = Window.partitionBy(group)
    top = df.select(group, F.col(positive).cast("double").alias("p"), F.row_number().over(each.orderBy(F.desc(score), id_col)).alias("r"), F.count(F.lit(1)).over(each).alias("n"))
    return top.where(F.col("r") <= F.floor(share * F.col("n"))).groupBy(group).agg(F.avg("p").alias("precision"))
