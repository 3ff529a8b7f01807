"""Exact cosine neighbours and graphs on them.

Vectors are ``ARRAY<FLOAT>`` columns.  Exact search is done in blocks: each task holds one block of queries and one of
candidates and sends on the best ``k`` of every query, so no group is gathered and no pair is materialised.
"""

from __future__ import annotations

from collections.abc import Iterator  # noqa: F401

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut

BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(v: Column) -> Column:
    """Unit length in double precision; zero vectors stay.  The norm is bound once, not computed for every element."""
    one = F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))
    return F.get(one, F.lit(0))


def _rows(col: pa.ChunkedArray) -> np.ndarray:
    a = col.combine_chunks()
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1).astype(np.float64) if len(a) else np.zeros((0, 1))


def exact_knn(df: DataFrame, id_col: str, vec_col: str, k: int, group: str | None = None, block: int = BLOCK) -> DataFrame:
    """([group,] src, dst, rank, dist): the ``k`` other vectors of least cosine distance, ties to the smaller id.

    Distances are rounded to six decimals.  Null vectors take no part; a zero vector is at distance 1 from all.
    """
    g = F.col(group).cast("long") if group else F.lit(0).cast("long")
    rows = df.select(g.alias("__g"), F.col(id_col).cast("long").alias("id"), normalise(F.col(vec_col)).alias("v")).where(F.col("v").isNotNull() & F.col("id").isNotNull())
    # blocks of about ``block`` rows whatever the ids look like
    cells = rows.groupBy("__g").agg(F.ceil(F.count(F.lit(1)) / block).alias("__n"))
    rows = rows.join(cells, "__g").withColumn("b", F.pmod(F.xxhash64("id"), "__n")).drop("__n")
    blocks = rows.select("__g", "b").distinct()
    pairs = blocks.select("__g", F.col("b").alias("a")).join(blocks, "__g")
    left = rows.withColumnRenamed("b", "a").join(pairs, ["__g", "a"]).select("__g", "a", "b", "id", "v")
    right = rows.join(pairs, ["__g", "b"]).select("__g", "a", "b", "id", "v")

    def search(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        xi, yi = x.column("id").to_numpy(), y.column("id").to_numpy()
        order = np.argsort(yi, kind="stable")
        yv, yi = _rows(y.column("v"))[order], yi[order]
        xv = _rows(x.column("v"))
        out = []
        for lo in range(0, len(xi), 512):
            d = np.maximum(np.rint((1 - xv[lo : lo + 512] @ yv.T) * 1e6), 0)
            d[xi[lo : lo + 512, None] == yi[None]] = np.inf
            m = min(k, d.shape[1])
            edge = np.partition(d, m - 1, axis=1)[:, m - 1]
            r, c = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
            by = np.lexsort((c, d[r, c], r))
            r, c = r[by], c[by]
            best = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append((xi[lo + r[best]], yi[c[best]], d[r[best], c[best]] / 1e6))
        src, dst, dist = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (xi, xi, xi.astype(float))
        return pa.table({"__g": np.full(len(src), key[0].as_py(), np.int64), "src": src, "dst": dst, "dist": dist.astype(float)})

    keys = ["__g", "a", "b"]
    found = left.toDF(*left.columns).groupBy(*keys).cogroup(right.toDF(*right.columns).groupBy(*keys)).applyInArrow(search, "__g long, src long, dst long, dist double")
    w = Window.partitionBy("__g", "src").orderBy("dist", "dst")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select(*([F.col("__g").alias(group)] if group else []), "src", "dst", "rank", "dist")


def smooth(df: DataFrame, id_col: str, vec_col: str, nn: DataFrame, alpha: float) -> DataFrame:
    """One round of mixing each vector with the mean of its neighbours; unit length again."""
    unit = df.select(F.col(id_col).alias("id"), normalise(F.col(vec_col)).alias("v"))
    spread_ = nn.join(unit.select(F.col("id").alias("dst"), F.posexplode("v").alias("pos", "x")), "dst")
    mean = spread_.groupBy(F.col("src").alias("id"), "pos").agg(F.avg("x").alias("m"))
    own = unit.select("id", F.posexplode("v").alias("pos", "x"))
    mixed = own.join(mean, ["id", "pos"], "left").select("id", "pos", ((1 - alpha) * F.col("x") + alpha * F.coalesce("m", F.lit(0.0))).alias("x"))
    return mixed.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("v")).select(F.col("id").alias(id_col), normalise(F.col("v")).alias(vec_col))


def symmetric(nn: DataFrame, loops: bool = False) -> DataFrame:
    """(src, dst): edges in both directions, once each; with ``loops`` every node is its own neighbour too."""
    e = nn.select("src", "dst").union(nn.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    if loops:
        e = e.union(nn.select("src", F.col("src").alias("dst")))
    return e.distinct()


def bandwidths(nn: DataFrame, k: int) -> DataFrame:
    """(src, rho, sigma): distance to the nearest other point and the bandwidth at which the memberships of the
    neighbours sum to log2 k, by 64 bisections as one expression."""
    d = nn.groupBy("src").agg(F.array_sort(F.collect_list("dist")).alias("d"))
    positive = F.filter("d", lambda x: x > 0)
    d = d.withColumn("rho", F.when(F.size(positive) > 0, F.array_min(positive)).otherwise(0.0))
    target = float(np.log2(k))

    def total(mid: Column) -> Column:
        return F.aggregate("d", F.lit(0.0), lambda s, x: s + F.when(x - F.col("rho") > 0, F.exp(-(x - F.col("rho")) / mid)).otherwise(1.0))

    def halve(s: Column, _: Column) -> Column:
        over = total(s.mid) > target
        lo, hi = F.when(over, s.lo).otherwise(s.mid), F.when(over, s.mid).otherwise(s.hi)
        return F.struct(lo.alias("lo"), hi.alias("hi"), F.when(hi < 1e300, (lo + hi) / 2).otherwise(s.mid * 2).alias("mid"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1e308).alias("hi"), F.lit(1.0).alias("mid"))
    mean = F.aggregate("d", F.lit(0.0), lambda s, x: s + x) / F.size("d")
    d = d.withColumn("mid", F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, halve, lambda s: s.mid))
    return d.select("src", "rho", F.greatest("mid", 1e-3 * mean).alias("sigma"))


def fuzzy_graph(nn: DataFrame, k: int) -> DataFrame:
    """(src, dst, w): memberships of both directions joined by a + b - ab."""
    w = nn.join(bandwidths(nn, k), "src").select("src", "dst", F.exp(-F.greatest(F.col("dist") - F.col("rho"), F.lit(0.0)) / F.col("sigma")).alias("w"))
    back = w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("u"))
    both = w.join(back, ["src", "dst"], "full_outer")
    a, b = F.coalesce("w", F.lit(0.0)), F.coalesce("u", F.lit(0.0))
    return both.select("src", "dst", (a + b - a * b).alias("w")).where("w > 0")


def normalised_adjacency(edges: DataFrame) -> DataFrame:
    """Weights divided by the square roots of both ends' degrees; a zero degree counts as one."""
    deg = edges.groupBy("src").agg(F.sum("w").alias("d")).select("src", F.when(F.col("d") > 0, F.col("d")).otherwise(1.0).alias("d"))
    e = edges.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    return e.select("src", "dst", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("w"))


def centroids(df: DataFrame, cluster: str | list[str], vec_col: str) -> DataFrame:
    """(cluster..., v, size): mean vector of every cluster, unit length."""
    by = [cluster] if isinstance(cluster, str) else cluster
    one = df.select(*by, F.posexplode(vec_col).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    arr = one.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s.m).alias("v"), F.max("n").alias("size"))
    return arr.select(*by, normalise(F.col("v")).alias("v"), "size")


def nearest_centroid(df: DataFrame, id_col: str, vec_col: str, cents: DataFrame, cluster: str, limit: int = 10_000, group: str | None = None) -> DataFrame:
    """([group,] id, cluster, sim) of the most similar centroid, ties to the smaller cluster.  The centroids, whose
    number (in each group, if one is named) is checked to be at most ``limit``, are a stated query set that meets all
    rows."""
    one = F.array_sort(F.collect_list(F.struct(F.col(cluster).alias("c"), F.col("v"))))
    by = [group] if group else []
    packed = cut(cents.groupBy(*by).agg(one.alias("cs")))
    n = packed.agg(F.max(F.size("cs"))).first()[0] or 0
    if n > limit:
        raise ValueError(f"{n} centroids; at most {limit} are compared with every row")
    rows = df.select(*by, F.col(id_col).alias("id"), normalise(F.col(vec_col)).alias("v")).where("v is not null")
    rows = rows.join(packed, by) if group else rows.join(F.broadcast(packed))
    scored = F.transform("cs", lambda s: F.struct((-F.round(dot(F.col("v"), s.v), 6)).alias("d"), s.c.alias("c")))
    return rows.select(*by, "id", F.array_min(scored).alias("b")).select(*by, "id", F.col("b.c").alias(cluster), (-F.col("b.d")).alias("sim"))


def relative_density(df: DataFrame, id_col: str, vec_col: str, group: str, k: int = 12, sample: int = 300, seed: int = 6) -> DataFrame:
    """(group, density): mean distance to the ``k``-th neighbour over the mean distance of pairs of a bounded sample."""
    near = exact_knn(df, id_col, vec_col, k, group=group).where(F.col("rank") == k).groupBy(group).agg(F.avg("dist").alias("near"))
    pick = Window.partitionBy(group).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col)
    rows = df.where(F.col(vec_col).isNotNull()).select(F.col(group).cast("long").alias(group), F.col(id_col), normalise(F.col(vec_col)).alias("v"))
    s = rows.withColumn("r", F.row_number().over(pick)).where(F.col("r") <= sample)
    a, b = (s.select(group, F.col("r").alias(i), F.col("v").alias(f"v{i}")) for i in ("i", "j"))  # ``sample`` rows a group
    far = a.join(b, group).where("i < j").groupBy(group).agg(F.avg(F.greatest(1 - dot(F.col("vi"), F.col("vj")), F.lit(0.0))).alias("far"))
    return near.join(far, group).select(group, (F.col("near") / F.col("far")).alias("density"))


def recall(a: DataFrame, b: DataFrame, k: int, group: str | None = None) -> DataFrame:
    """([group,] src, recall): share of the neighbours of ``a`` that ``b`` has too."""
    by = [group, "src"] if group else ["src"]
    hit = a.select(*by, "dst").join(b.select(*by, "dst"), [*by, "dst"]).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return a.select(*by).distinct().join(hit, by, "left").select(*by, (F.coalesce("n", F.lit(0)) / k).alias("recall"))
