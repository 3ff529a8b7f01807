"""Queries on vectors, neighbours, graphs, layouts and clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators import knn as K
from weftline.plans.registry import query
from weftline.session import cut, table

_DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def _dot(a: str, b: str) -> str:
    return _DOT.format(a=a, b=b)


def emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def neighbours(spark: SparkSession, d: str, k: int) -> DataFrame:
    return K.exact_knn(emb(spark, d), "vec_id", "embedding", k)


UNIT = f"u AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt({_dot('embedding', 'embedding')})) AS v FROM embeddings)"
_D = "CAST(greatest(round((1 - list_dot_product(a.v, b.v)) * 1e6), 0) AS DOUBLE) / 1e6"


def NN(k: int) -> str:  # noqa: N802
    return f"{UNIT}, p AS (SELECT a.vec_id AS src, b.vec_id AS dst, {_D} AS dist FROM u a JOIN u b ON a.vec_id <> b.vec_id), nn AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank, dist FROM p QUALIFY rank <= {k})"


@query(f"SELECT vec_id, subset_id, list_transform(CAST(g AS DOUBLE[]), lambda x: round(CASE WHEN {_dot('g', 'g')} > 0 THEN x / sqrt({_dot('g', 'g')}) ELSE x END, 6)) AS v FROM feature_rows")
def v01_normalised(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feature_rows").select("vec_id", "subset_id", F.transform(K.normalise(F.col("g")), lambda x: F.round(x, 6)).alias("v"))


@query(f"WITH s AS (SELECT vec_id, list_concat(list_transform(CAST(g AS DOUBLE[]), lambda x: x * 0.84), list_transform(CAST(proj_bd AS DOUBLE[]), lambda x: x * 1.4)) AS v FROM feature_rows WHERE g IS NOT NULL AND proj_bd IS NOT NULL) SELECT vec_id, list_transform(v, lambda x: round(CASE WHEN {_dot('v', 'v')} > 0 THEN x / sqrt({_dot('v', 'v')}) ELSE x END, 6)) AS v FROM s")
def v02_weighted_stack(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "feature_rows").where("g is not null and proj_bd is not null")
    scale = lambda c, w: F.transform(c, lambda x: x.cast("double") * w)
    return t.select("vec_id", F.transform(K.normalise(F.concat(scale("g", 0.84), scale("proj_bd", 1.4))), lambda x: F.round(x, 6)).alias("v"))


@query()
def v03_v05_spectrum(spark: SparkSession, d: str) -> DataFrame:
    from weftline.operators.matrix import spectrum

    return spectrum(emb(spark, d), "embedding", 8)


@query("WITH e AS (SELECT label, unnest(range(64)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) SELECT label, CAST(pos AS INT) AS pos, round(avg(x), 6) AS mean FROM e GROUP BY ALL")
def v07_group_mean(spark: SparkSession, d: str) -> DataFrame:
    return emb(spark, d).select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query(f"WITH c AS (SELECT subset_id, row_no, g, lead(g) OVER (PARTITION BY subset_id ORDER BY row_no) AS h FROM feature_rows WHERE g IS NOT NULL) SELECT subset_id, row_no, round({_dot('g', 'h')}, 6) AS dot FROM c WHERE h IS NOT NULL")
def v08_dot_product(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("subset_id").orderBy("row_no")
    t = table(spark, d, "feature_rows").where("g is not null").select("subset_id", "row_no", "g", F.lead("g").over(w).alias("h")).where("h is not null")
    return t.select("subset_id", "row_no", F.round(K.dot(F.col("g"), F.col("h")), 6).alias("dot"))


@query()
def v10_ridge(spark: SparkSession, d: str) -> DataFrame:
    from weftline.operators.matrix import ridge

    t = table(spark, d, "feature_rows").where("g is not null and proj_bd is not null")
    return ridge(t, "proj_bd", "g", 1.0)


@query(f"WITH {NN(15)} SELECT src, dst, CAST(rank AS INT) AS rank, dist FROM nn")
def j01_exact_knn(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(spark, d, 15)


@query(f"""WITH {NN(16)}, m AS (SELECT src, pos, avg(x) AS m FROM (SELECT nn.src, unnest(range(64)) AS pos, unnest(v) AS x FROM nn JOIN u ON nn.dst = u.vec_id) GROUP BY ALL),
z AS (SELECT vec_id, q.pos, 0.8 * q.x + 0.2 * m.m AS x FROM (SELECT vec_id, unnest(range(64)) AS pos, unnest(v) AS x FROM u) q JOIN m ON m.src = q.vec_id AND m.pos = q.pos)
SELECT vec_id, CAST(pos AS INT) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 5) AS x FROM z""")
def j02_smoothed(spark: SparkSession, d: str) -> DataFrame:
    s = K.smooth(emb(spark, d), "vec_id", "embedding", neighbours(spark, d, 16), 0.2)
    return s.select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 5))


@query(f"WITH {NN(15)} SELECT src, dst FROM nn UNION SELECT dst AS src, src AS dst FROM nn UNION SELECT vec_id, vec_id FROM u")
def j03_connectivity(spark: SparkSession, d: str) -> DataFrame:
    return K.symmetric(neighbours(spark, d, 15), loops=True)


@query(f"""WITH RECURSIVE {NN(15)}, d AS (SELECT src, list(dist ORDER BY dist) AS d, coalesce(min(dist) FILTER (dist > 0), 0) AS rho, avg(dist) AS m FROM nn GROUP BY src),
b AS (SELECT src, d, rho, m, 0 AS i, 0.0::DOUBLE AS lo, 1e308::DOUBLE AS hi, 1.0::DOUBLE AS mid FROM d UNION ALL
SELECT src, d, rho, m, i + 1, CASE WHEN s > ln(15) / ln(2) THEN lo ELSE mid END, CASE WHEN s > ln(15) / ln(2) THEN mid ELSE hi END, CASE WHEN s > ln(15) / ln(2) THEN (lo + mid) / 2 WHEN hi < 1e300 THEN (mid + hi) / 2 ELSE mid * 2 END
FROM (SELECT *, list_sum(list_transform(d, lambda x: CASE WHEN x - rho > 0 THEN exp(-(x - rho) / mid) ELSE 1.0 END)) AS s FROM b WHERE i < 64)),
w AS (SELECT nn.src, nn.dst, exp(-greatest(nn.dist - rho, 0) / greatest(mid, 0.001 * m)) AS w FROM nn JOIN b ON b.src = nn.src AND b.i = 64),
f AS (SELECT coalesce(x.src, y.dst) AS src, coalesce(x.dst, y.src) AS dst, coalesce(x.w, 0) AS a, coalesce(y.w, 0) AS b FROM w x FULL JOIN w y ON x.src = y.dst AND x.dst = y.src) SELECT src, dst, round(a + b - a * b, 5) AS w FROM f WHERE a + b - a * b > 0""")
def j04_fuzzy_graph(spark: SparkSession, d: str) -> DataFrame:
    return K.fuzzy_graph(cut(neighbours(spark, d, 15)), 15).withColumn("w", F.round("w", 5))


@query(f"WITH {NN(15)}, w AS (SELECT src, dst, 1 - dist AS w FROM nn), m AS (SELECT max(w) AS m FROM w) SELECT src, dst, round(m / w, 6) AS every FROM w, m WHERE w >= m / 200")
def j20_due_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges strong enough to be visited in 200 rounds, and after how many rounds each is due."""
    nn = cut(neighbours(spark, d, 15).withColumn("w", 1 - F.col("dist")))
    top = nn.agg(F.max("w").alias("m"))
    return nn.join(F.broadcast(top)).where("w >= m / 200").select("src", "dst", F.round(F.col("m") / F.col("w"), 6).alias("every"))


@query(f"WITH {NN(15)}, e AS (SELECT src, dst FROM nn UNION SELECT dst, src FROM nn), g AS (SELECT src, count(*) AS d FROM e GROUP BY src) SELECT e.src, e.dst, round(1.0 / sqrt(a.d * b.d), 6) AS w FROM e JOIN g a ON a.src = e.src JOIN g b ON b.src = e.dst")
def j19_normalised_adjacency(spark: SparkSession, d: str) -> DataFrame:
    e = K.symmetric(neighbours(spark, d, 15)).withColumn("w", F.lit(1.0))
    return K.normalised_adjacency(e).withColumn("w", F.round("w", 6))


@query(f"WITH {NN(5)}, v AS (SELECT src, label, count(*) AS n FROM nn JOIN u ON nn.dst = u.vec_id GROUP BY ALL) SELECT src AS vec_id, label FROM v QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, label) = 1")
def j06_majority_vote(spark: SparkSession, d: str) -> DataFrame:
    v = neighbours(spark, d, 5).join(emb(spark, d).select(F.col("vec_id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("src").orderBy(F.desc("n"), "label")
    return v.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("src").alias("vec_id"), "label")


CENT = f"{UNIT}, c0 AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(range(64)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY ALL), c1 AS (SELECT label AS c, list(m ORDER BY pos) AS m FROM c0 GROUP BY label), c AS (SELECT c, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS v FROM c1)"


_NEAR = "SELECT vec_id, c.c AS label, u.v AS v, round(list_dot_product(u.v, c.v), 6) AS sim FROM u, c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(u.v, c.v), 6) DESC, c.c) = 1"


@query(f"WITH {CENT}, r1 AS ({_NEAR}), c2 AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(range(64)) AS pos, unnest(v) AS x FROM r1) GROUP BY ALL), c3 AS (SELECT label AS c, list(m ORDER BY pos) AS m FROM c2 GROUP BY label), d AS (SELECT c, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS v FROM c3) SELECT vec_id, label, sim FROM ({_NEAR.replace('FROM u, c ', 'FROM u, d c ')})")
def j07_nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds: rows move to the nearest centre, whose centres are those of the next round."""
    t = emb(spark, d).select("vec_id", K.normalise(F.col("embedding")).alias("v"), "label")
    for _ in range(2):
        near = K.nearest_centroid(t, "vec_id", "v", K.centroids(t, "label", "v"), "label")
        t = cut(t.select("vec_id", "v").join(near.select(F.col("id").alias("vec_id"), "label", "sim"), "vec_id"))
    return t.select("vec_id", "label", "sim")


_PREDU = "u AS (SELECT vec_id, subset_id, row_no, pred, list_transform(CAST(g AS DOUBLE[]), lambda x: CASE WHEN list_dot_product(CAST(g AS DOUBLE[]), CAST(g AS DOUBLE[])) > 0 THEN x / sqrt(list_dot_product(CAST(g AS DOUBLE[]), CAST(g AS DOUBLE[]))) ELSE x END) AS v, CAST(g AS DOUBLE[]) AS g FROM feature_rows WHERE g IS NOT NULL AND pred IS NOT NULL)"


@query(f"""WITH {_PREDU}, z AS (SELECT subset_id, pred, count(*) AS size FROM u GROUP BY ALL), m0 AS (SELECT subset_id, pred, pos, avg(x) AS m FROM (SELECT subset_id, pred, unnest(range(32)) AS pos, unnest(g) AS x FROM u) GROUP BY ALL), m1 AS (SELECT subset_id, pred, list(m ORDER BY pos) AS m FROM m0 GROUP BY ALL),
c AS (SELECT subset_id, pred AS c, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS v FROM m1 JOIN z USING (subset_id, pred) WHERE size >= 100),
n AS (SELECT vec_id, c.c, round(list_dot_product(u.v, c.v), 6) AS sim FROM u JOIN z USING (subset_id, pred) JOIN c USING (subset_id) WHERE size < 100 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, c.c) = 1)
SELECT u.vec_id, CASE WHEN n.sim >= 0.3 THEN n.c ELSE u.pred END AS cluster FROM u LEFT JOIN n USING (vec_id)""")
def j08_rescued(spark: SparkSession, d: str) -> DataFrame:
    from weftline.operators.labels import rescue

    t = table(spark, d, "feature_rows").where("g is not null and pred is not null")
    return rescue(t.select("vec_id", "subset_id", F.col("pred").alias("cluster"), "g"), "vec_id", "cluster", "g", 100, 0.3, group="subset_id").select("vec_id", "cluster")


def _single(spark: SparkSession, d: str) -> DataFrame:
    """Predictions in which the quarter of the rows farthest from its fifth neighbour are clusters of their own."""
    from weftline.operators.labels import singletons
    from weftline.plans.label_queries import rows

    s = singletons(rows(spark, d), "subset_id", "row_no", F.col("dist"), 0.25).where("relabelled >= 0").select("subset_id", "row_no", F.col("relabelled").alias("cluster"))
    return cut(s.join(table(spark, d, "feature_rows").select("subset_id", "row_no", "g"), ["subset_id", "row_no"]))


@query(f"""WITH {_PREDU}, p AS (SELECT a.subset_id, a.row_no, a.pred, row_number() OVER (PARTITION BY a.subset_id, a.row_no ORDER BY greatest(round((1 - list_dot_product(a.v, b.v)) * 1e6), 0), b.row_no) AS r, greatest(round((1 - list_dot_product(a.v, b.v)) * 1e6), 0) AS dist FROM (SELECT * FROM u) a JOIN (SELECT subset_id, row_no, list_transform(CAST(g AS DOUBLE[]), lambda x: CASE WHEN list_dot_product(CAST(g AS DOUBLE[]), CAST(g AS DOUBLE[])) > 0 THEN x / sqrt(list_dot_product(CAST(g AS DOUBLE[]), CAST(g AS DOUBLE[]))) ELSE x END) AS v FROM feature_rows WHERE g IS NOT NULL) b ON a.subset_id = b.subset_id AND a.row_no <> b.row_no),
f AS (SELECT subset_id, row_no, row_number() OVER (PARTITION BY subset_id ORDER BY dist DESC, row_no) AS k, count(*) OVER (PARTITION BY subset_id) AS n FROM p WHERE r = 5),
s AS (SELECT f.subset_id, 1000000 + k - 1 AS c, u.v FROM f JOIN u USING (subset_id, row_no) WHERE k <= floor(n * 0.25)),
q AS (SELECT a.subset_id, a.c AS a, b.c AS b, greatest(round((1 - list_dot_product(a.v, b.v)) * 1e6), 0) / 1e6 AS dist FROM s a JOIN s b ON a.subset_id = b.subset_id AND a.c <> b.c), n1 AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY subset_id, a ORDER BY dist, b) = 1)
SELECT x.subset_id, x.a, x.b, round(1 - x.dist, 6) AS sim FROM n1 x JOIN n1 y ON x.subset_id = y.subset_id AND x.a = y.b AND x.b = y.a WHERE x.a < x.b AND 1 - x.dist >= 0.8""")
def j09_singleton_merges(spark: SparkSession, d: str) -> DataFrame:
    """One round: the pairs of singletons that are each other's nearest and close enough."""
    from weftline.operators.labels import mutual_merges

    t = _single(spark, d).where("cluster >= 1000000")
    return mutual_merges(t, "cluster", "g", 1, 0.8, group="subset_id")


@query()
def j09_mutual_merges(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the given clusters of at most five rows that are each other's nearest."""
    from weftline.operators.labels import mutual_merges

    t = table(spark, d, "feature_rows").where("g is not null and pred is not null")
    return mutual_merges(t.select("subset_id", F.col("pred").alias("cluster"), "g"), "cluster", "g", 5, 0.5, group="subset_id")


@query()
def j09_merged_tiny(spark: SparkSession, d: str) -> DataFrame:
    """Both stages with all their rounds, relabelled."""
    from weftline.operators.labels import merge_tiny

    return merge_tiny(_single(spark, d), "row_no", "cluster", "g", "subset_id")


@query()
def e01_spectral(spark: SparkSession, d: str) -> DataFrame:
    from weftline.operators.layout import spectral

    e = K.symmetric(neighbours(spark, d, 15)).select(F.lit(0).cast("long").alias("subset_id"), "src", "dst", F.lit(1.0).alias("w"))
    return spectral(e, "subset_id", 8)


@query()
def e05_umap(spark: SparkSession, d: str) -> DataFrame:
    from weftline.operators.layout import umap

    nn = cut(neighbours(spark, d, 15))
    g = K.fuzzy_graph(nn, 15).select(F.lit(0).cast("long").alias("subset_id"), "src", "dst", "w")
    return umap(g, "subset_id", dim=5, epochs=200)


@query()
def c01_kmeans(spark: SparkSession, d: str) -> DataFrame:
    from weftline.operators.clustering import kmeans

    return kmeans(emb(spark, d), "vec_id", "embedding")


@query()
def c04_average_linkage(spark: SparkSession, d: str) -> DataFrame:
    from weftline.operators.clustering import average_linkage

    t = table(spark, d, "feature_rows").where("g is not null")
    return average_linkage(t, "subset_id", "row_no", "g", 28)


@query()
def c06_density_clusters(spark: SparkSession, d: str) -> DataFrame:
    from weftline.operators.clustering import density_clusters

    t = table(spark, d, "feature_rows").where("g is not null")
    return density_clusters(t, "subset_id", "row_no", "g", 25, 10)


@query(f"WITH {NN(10)} SELECT src AS vec_id, dist AS core FROM nn WHERE rank = 10")
def c06_core_distance(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(spark, d, 10).where("rank = 10").select(F.col("src").alias("vec_id"), F.col("dist").alias("core"))


@query(f"WITH {NN(10)}, k AS (SELECT src, dist AS core FROM nn WHERE rank = 10) SELECT nn.src, nn.dst, greatest(nn.dist, a.core, b.core) AS reach FROM nn JOIN k a ON a.src = nn.src JOIN k b ON b.src = nn.dst")
def c06_mutual_reachability(spark: SparkSession, d: str) -> DataFrame:
    nn = cut(neighbours(spark, d, 10))
    core = nn.where("rank = 10").select("src", F.col("dist").alias("ca"))
    e = nn.join(core, "src").join(core.select(F.col("src").alias("dst"), F.col("ca").alias("cb")), "dst")
    return e.select("src", "dst", F.greatest("dist", "ca", "cb").alias("reach"))


@query()
def c13_baseline_pipeline(spark: SparkSession, d: str) -> DataFrame:
    from weftline.plans.pipelines import baseline

    return baseline(table(spark, d, "bench_rows"), "subset_id", "row_no", "text")


@query()
def c02_fallback(spark: SparkSession, d: str) -> DataFrame:
    from weftline.plans.pipelines import fallback

    return fallback(table(spark, d, "bench_rows"), "subset_id", "row_no", "text")


@query()
def c03_large_batch(spark: SparkSession, d: str) -> DataFrame:
    from weftline.plans.pipelines import large_batch

    return large_batch(table(spark, d, "bench_rows"), "subset_id", "row_no", "text")


@query()
def l06_resplit(spark: SparkSession, d: str) -> DataFrame:
    """Five clusters of each subset, those above 15 % of it replaced by their parts in the cut into forty."""
    from weftline.operators.clustering import average_linkage

    return average_linkage(table(spark, d, "feature_rows").where("g is not null"), "subset_id", "row_no", "g", 5, resplit=40)


@query()
def c13_encoder_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Texts through the encoder, neighbour graph, layout and density clusters; the weights are seeded."""
    from weftline.plans.pipelines import layout_and_density

    v = cut(n02_encoder(spark, d))
    return layout_and_density(v, "subset_id", "row_no", "v")


@query()
def e02_fuzzy_spectral(spark: SparkSession, d: str) -> DataFrame:
    """Spectral embedding of the fuzzy graph with self-loops, in eight dimensions."""
    from weftline.operators.layout import spectral

    g = K.fuzzy_graph(cut(neighbours(spark, d, 15)), 15).select(F.lit(0).cast("long").alias("subset_id"), "src", "dst", "w")
    return spectral(g, "subset_id", 8, loops=True)


@query()
def n01_relative_encoder(spark: SparkSession, d: str) -> DataFrame:
    """The encoder with relative positions, the error-function form of its activation and a head; seeded weights."""
    from weftline.functions.wordpiece import encode
    from weftline.operators.encoder import Weights, encode_ids

    rows = table(spark, d, "bench_rows").select("subset_id", "row_no", "text")
    pieces = table(spark, d, "vocab_pieces")
    ids = encode(rows, ["subset_id", "row_no"], "text", pieces, 64)
    return encode_ids(ids, ["subset_id", "row_no"], Weights.random(pieces.count(), 32, 2, 4, out=16, buckets=32))


@query()
def c13_small_pipeline(spark: SparkSession, d: str) -> DataFrame:
    from weftline.plans.pipelines import layout_and_density

    return layout_and_density(table(spark, d, "feature_rows"), "subset_id", "row_no", "g")


@query()
def n02_encoder(spark: SparkSession, d: str) -> DataFrame:
    from weftline.functions.wordpiece import encode
    from weftline.operators.encoder import Weights, encode_ids

    rows = table(spark, d, "bench_rows").select("subset_id", "row_no", "text")
    pieces = table(spark, d, "vocab_pieces")
    ids = encode(rows, ["subset_id", "row_no"], "text", pieces, 64)
    return encode_ids(ids, ["subset_id", "row_no"], Weights.random(pieces.count(), 32, 2, 4))
