"""Repair of cluster labels, as joins and windows over (id, cluster) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import knn as K
from weftline.session import cut

FIRST_SINGLETON = 1_000_000
# Least cosine, largest size and rounds of the two stages of merging tiny clusters.
TINY_STAGES = ((0.8, 1, 1), (0.86, 5, 4))


def singletons(df: DataFrame, group: str, id_col: str, dist: Column, fraction: float) -> DataFrame:
    """The ``fraction`` most isolated rows of each group get labels of their own; larger distance first, then id."""
    far = Window.partitionBy(group).orderBy(dist.desc(), id_col)
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    r = F.row_number().over(far)
    return df.select("*", F.when(r <= F.floor(n * fraction), FIRST_SINGLETON + r - 1).otherwise(F.col("cluster")).cast("int").alias("relabelled"))


def dense(df: DataFrame, group: str, col: str = "cluster") -> Column:
    """Labels 0.. in ascending order of the old ones."""
    return (F.dense_rank().over(Window.partitionBy(group).orderBy(col)) - 1).cast("int")


def protected(df: DataFrame, group: str, id_col: str, vec_col: str, least: int = 40, lo: float = 0.012, hi: float = 0.12, most: int = 3) -> DataFrame:
    """(group, cluster, size, cohesion): up to ``most`` clusters of medium size with the largest size x mean cosine to
    their centre."""
    unit = df.select(group, "cluster", id_col, K.normalise(F.col(vec_col)).alias("v"))
    part = unit.select(group, "cluster", id_col, F.posexplode("v").alias("pos", "x")).groupBy(group, "cluster", "pos").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("size"))
    # the mean cosine of unit vectors to their normalised mean is the length of the mean
    c = part.groupBy(group, "cluster").agg(F.max("size").alias("size"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("cohesion"))
    n = unit.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    c = c.join(n, group).where((F.col("size") >= F.greatest(F.lit(least), lo * F.col("n"))) & (F.col("size") <= hi * F.col("n")))
    w = Window.partitionBy(group).orderBy(F.desc(F.round(F.col("size") * F.col("cohesion"), 4)), "cluster")
    return c.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select(group, "cluster", "size", "cohesion")


def merge_scripts(df: DataFrame, group: str, lo: float = 0.05, hi: float = 0.4, pure: float = 0.55, least: int = 3) -> DataFrame:
    """Adds ``merged``: for each script that 5-40 % of a group's rows have, the clusters of at least three rows that are
    mostly in it become the smallest of them."""
    size = Window.partitionBy(group, "cluster")
    each = Window.partitionBy(group)
    d = df.withColumn("n", F.count(F.lit(1)).over(each)).withColumn("size", F.count(F.lit(1)).over(size))
    share = d.groupBy(group, "script").agg((F.count(F.lit(1)) / F.max("n")).alias("share")).where((F.col("script") > 0) & F.col("share").between(lo, hi))
    mostly = d.groupBy(group, "cluster", "script", "size").agg(F.count(F.lit(1)).alias("k")).where((F.col("size") >= least) & (F.col("k") / F.col("size") >= pure))
    to = mostly.join(share, [group, "script"]).withColumn("merged", F.min("cluster").over(Window.partitionBy(group, "script"))).select(group, "cluster", "merged")
    return df.join(to, [group, "cluster"], "left").withColumn("merged", F.coalesce("merged", "cluster"))


def noise_rules(size: Column, rank: Column, n: Column, small: int = 5, isolated: float = 0.25) -> dict[str, Column]:
    """Label expressions of the three rules: singletons, clusters below ``small``, the most isolated rows."""
    c = F.col("cluster")
    return {"single": F.when(size <= 1, -1).otherwise(c), "small": F.when(size < small, -1).otherwise(c), "isolated": F.when(rank <= F.floor(n * isolated), -1).otherwise(c)}


def rescue(df: DataFrame, id_col: str, cluster: str, vec_col: str, least: int, cos: float, group: str | None = None) -> DataFrame:
    """([group,] id, cluster): rows of clusters below ``least`` move to the nearest large cluster's centre of their group
    if close enough; rows without a vector stay."""
    by = [group] if group else []
    size = df.groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("size"))
    large = size.where(F.col("size") >= least).select(*by, cluster)
    small = df.join(size.where(F.col("size") < least).select(*by, cluster), [*by, cluster], "left_semi")
    cents = K.centroids(df.join(large, [*by, cluster], "left_semi"), [*by, cluster], vec_col)
    best = K.nearest_centroid(small, id_col, vec_col, cents.withColumnRenamed(cluster, "to"), "to", group=group)
    near = best.where(F.col("sim") >= cos).select(*by, F.col("id").alias(id_col), "to")
    return df.join(near, [*by, id_col], "left").select(*by, id_col, F.coalesce("to", cluster).alias(cluster))


def mutual_merges(df: DataFrame, cluster: str, vec_col: str, most: int, cos: float, group: str | None = None) -> DataFrame:
    """(group, a, b, sim), a < b: clusters of at most ``most`` rows whose centres are each other's nearest among such
    clusters of their group and close enough.  Negative labels are noise and no cluster; without ``group`` all rows are one."""
    g = F.col(group).cast("long") if group else F.lit(0).cast("long")
    keyed = df.where(F.col(cluster) >= 0).withColumn("__k", F.struct(g.alias("g"), F.col(cluster).cast("long").alias("c")))
    cents = K.centroids(keyed, "__k", vec_col).where(F.col("size") <= most).select(F.col("__k.g").alias("__of"), F.col("__k.c").alias("c"), "v")
    nn = cut(K.exact_knn(cents, "c", "v", 1, group="__of").select("__of", "src", "dst", (1 - F.col("dist")).alias("sim")))
    back = nn.select("__of", F.col("dst").alias("src"), F.col("src").alias("dst"))
    pair = nn.join(back, ["__of", "src", "dst"]).where((F.col("src") < F.col("dst")) & (F.col("sim") >= cos))
    return pair.select(*([F.col("__of").alias(group)] if group else []), F.col("src").alias("a"), F.col("dst").alias("b"), F.round("sim", 6).alias("sim"))


def merge_tiny(df: DataFrame, id_col: str, cluster: str, vec_col: str, group: str, stages: tuple[tuple[float, int, int], ...] = TINY_STAGES) -> DataFrame:
    """(group, id, cluster): mutual-nearest merges in stages of (cosine, largest size, rounds), relabelled after each.

    The larger label of a pair becomes the smaller one; a stage ends early when a round merges nothing.  Labels are
    dense from 0 in each group in the end.
    """
    now = cut(df.select(F.col(group).cast("long").alias(group), id_col, F.col(cluster).cast("long").alias(cluster), vec_col))
    for cos, most, rounds in stages:
        for _ in range(rounds):
            pairs = cut(mutual_merges(now, cluster, vec_col, most, cos, group=group))
            if pairs.isEmpty():
                break
            to = pairs.select(group, F.col("b").alias(cluster), F.col("a").alias("__to"))
            now = cut(now.join(to, [group, cluster], "left").withColumn(cluster, F.coalesce("__to", cluster)).select(group, id_col, cluster, vec_col))
    ids = now.select(group, cluster).distinct()
    ids = ids.select(group, cluster, dense(ids, group, cluster).alias("__d"))
    return now.join(ids, [group, cluster]).select(group, id_col, F.col("__d").alias(cluster))


def tiny_inputs(n: Column, filled: Column, number: Column, label: Column, least: int = 20) -> Column:
    """Labels of small inputs: below three texts each its own, below three filled or ``least`` in all one, else ``label``."""
    return F.when(n < 3, number).when((filled < 3) | (n < least), F.lit(0)).otherwise(label)


def adaptive_cut(density: Column) -> dict[str, Column]:
    """Number of clusters and share of singletons, rising with the relative density from 0.1 to 0.32."""
    beta = F.least(F.greatest((density - 0.1) / 0.22, F.lit(0.0)), F.lit(1.0))
    return {"k": F.bround(40 + 180 * beta, 0).cast("int"), "fraction": F.round(0.25 + 0.15 * beta, 5)}
