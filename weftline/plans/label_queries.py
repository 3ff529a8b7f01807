"""Queries on cluster labels: routing, repair rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import knn as K
from weftline.operators import labels as L
from weftline.plans import sqltext as Q
from weftline.plans.registry import query
from weftline.plans.text_queries import SCRIPT_SQL, SCRIPT_COUNTS_SQL
from weftline.session import cut, table

_UNIT = "u AS (SELECT subset_id, row_no, pred, list_transform(CAST(g AS DOUBLE[]), lambda x: CASE WHEN list_dot_product(CAST(g AS DOUBLE[]), CAST(g AS DOUBLE[])) > 0 THEN x / sqrt(list_dot_product(CAST(g AS DOUBLE[]), CAST(g AS DOUBLE[]))) ELSE x END) AS v FROM feature_rows WHERE g IS NOT NULL)"
_F = f"{_UNIT}, p AS (SELECT a.subset_id, a.row_no, a.pred, greatest(round((1 - list_dot_product(a.v, b.v)) * 1e6), 0) / 1e6 AS dist, row_number() OVER (PARTITION BY a.subset_id, a.row_no ORDER BY greatest(round((1 - list_dot_product(a.v, b.v)) * 1e6), 0), b.row_no) AS r FROM u a JOIN u b ON a.subset_id = b.subset_id AND a.row_no <> b.row_no), f AS (SELECT subset_id, row_no, pred AS cluster, dist FROM p WHERE r = 5 AND pred IS NOT NULL)"


def rows(spark: SparkSession, d: str) -> DataFrame:
    """Predicted labels with the distance to the fifth neighbour in the subset."""
    t = table(spark, d, "feature_rows").where("g is not null").select(F.col("subset_id").cast("long").alias("subset_id"), F.col("row_no").cast("long").alias("row_no"), "g", F.col("pred").alias("cluster"))
    far = K.exact_knn(t, "row_no", "g", 5, group="subset_id").where("rank = 5").select("subset_id", F.col("src").alias("row_no"), "dist")
    return cut(t.where("cluster is not null").drop("g").join(far, ["subset_id", "row_no"]))


@query(f"""WITH c AS (SELECT subset_id, text, length({Q.clean('text', ' ')}) AS n FROM bench_rows), m AS (SELECT subset_id, count(*) FILTER (n >= 40) AS long, median(n) FILTER (n > 0) AS m0, median(n) FILTER (n >= 40) AS m40, avg(CASE WHEN contains(text, chr(10)) THEN 1.0 ELSE 0 END) AS nl, avg(CASE WHEN regexp_matches(lower(text), 'http|www\\.') THEN 1.0 ELSE 0 END) AS url FROM c GROUP BY subset_id)
SELECT subset_id, CASE WHEN long >= 50 THEN m40 ELSE m0 END AS median, round(nl, 6) AS newline, round(url, 6) AS url, CASE WHEN (CASE WHEN long >= 50 THEN m40 ELSE m0 END) < 130 AND nl < 0.08 AND url < 0.03 THEN 'short' ELSE 'long' END AS route FROM m""")
def c09_route(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "bench_rows").select("subset_id", "text", F.length(X.clean_long(F.col("text"))).alias("n"))
    flag = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    m = t.groupBy("subset_id").agg(
        F.count(F.when(F.col("n") >= 40, 1)).alias("long"), F.median(F.when(F.col("n") > 0, F.col("n"))).alias("m0"), F.median(F.when(F.col("n") >= 40, F.col("n"))).alias("m40"),
        flag(X.has_newline(F.col("text"))).alias("newline"), flag(X.has_url(F.col("text"))).alias("url"),
    ).withColumn("median", F.when(F.col("long") >= 50, F.col("m40")).otherwise(F.col("m0")))
    route = F.when((F.col("median") < 130) & (F.col("newline") < 0.08) & (F.col("url") < 0.03), "short").otherwise("long")
    return m.select("subset_id", "median", F.round("newline", 6).alias("newline"), F.round("url", 6).alias("url"), route.alias("route"))


@query(f"WITH {_F}, r AS (SELECT *, row_number() OVER (PARTITION BY subset_id ORDER BY dist DESC, row_no) AS r, count(*) OVER (PARTITION BY subset_id) AS n FROM f) SELECT subset_id, row_no, CASE WHEN r <= floor(n * 0.25) THEN 1000000 + r - 1 ELSE cluster END AS relabelled FROM r")
def l01_singletons(spark: SparkSession, d: str) -> DataFrame:
    return L.singletons(rows(spark, d), "subset_id", "row_no", F.col("dist"), 0.25).select("subset_id", "row_no", "relabelled")


@query(f"""WITH {_UNIT}, e AS (SELECT subset_id, pred AS cluster, unnest(range(len(v))) AS pos, unnest(v) AS x FROM u WHERE pred >= 0), m AS (SELECT subset_id, cluster, pos, avg(x) AS m, count(*) AS size FROM e GROUP BY ALL),
c AS (SELECT subset_id, cluster, max(size) AS size, sqrt(sum(m * m)) AS cohesion FROM m GROUP BY ALL), n AS (SELECT subset_id, count(*) AS n FROM u WHERE pred >= 0 GROUP BY ALL)
SELECT subset_id, cluster, size, round(cohesion, 6) AS cohesion FROM c JOIN n USING (subset_id) WHERE size >= greatest(20, 0.006 * n) AND size <= 0.12 * n QUALIFY row_number() OVER (PARTITION BY subset_id ORDER BY round(size * cohesion, 4) DESC, cluster) <= 3""")
def l02_protected(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "feature_rows").where("g is not null and pred >= 0").select("subset_id", "row_no", F.col("pred").alias("cluster"), "g")
    return L.protected(t, "subset_id", "row_no", "g", least=20, lo=0.006).withColumn("cohesion", F.round("cohesion", 6))


@query(f"""WITH q AS (SELECT subset_id, row_no, text, {SCRIPT_COUNTS_SQL} FROM bench_rows WHERE text IS NOT NULL), b AS (SELECT subset_id, row_no, {SCRIPT_SQL} AS script FROM (SELECT *, greatest(c1, c2, c3, c4, c5, c6) AS top FROM q)),
s AS (SELECT f.subset_id, f.row_no, f.pred AS cluster, script FROM feature_rows f JOIN b USING (subset_id, row_no) WHERE f.pred IS NOT NULL),
d AS (SELECT *, count(*) OVER (PARTITION BY subset_id) AS n, count(*) OVER (PARTITION BY subset_id, cluster) AS size FROM s),
sh AS (SELECT subset_id, script FROM d WHERE script > 0 GROUP BY subset_id, script HAVING count(*) / max(n) BETWEEN 0.05 AND 0.4),
m AS (SELECT subset_id, cluster, script FROM d WHERE size >= 3 GROUP BY subset_id, cluster, script, size HAVING count(*) / size >= 0.55),
t AS (SELECT subset_id, cluster, min(cluster) OVER (PARTITION BY subset_id, script) AS merged FROM m JOIN sh USING (subset_id, script))
SELECT s.subset_id, s.row_no, s.script, coalesce(t.merged, s.cluster) AS merged FROM s LEFT JOIN t ON t.subset_id = s.subset_id AND t.cluster = s.cluster""")
def l03_script_merge(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "feature_rows").where("pred is not null").select("subset_id", "row_no", F.col("pred").alias("cluster"))
    b = table(spark, d, "bench_rows").where("text is not null").select("subset_id", "row_no", X.script_id(F.col("text")).alias("script"))
    return L.merge_scripts(t.join(b, ["subset_id", "row_no"]), "subset_id").select("subset_id", "row_no", "script", "merged")


@query("SELECT subset_id, row_no, dense_rank() OVER (PARTITION BY subset_id ORDER BY pred) - 1 AS label FROM feature_rows WHERE pred IS NOT NULL")
def l05_dense(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "feature_rows").where("pred is not null")
    return t.select("subset_id", "row_no", L.dense(t, "subset_id", "pred").alias("label"))


@query(f"WITH {_F}, r AS (SELECT *, count(*) OVER (PARTITION BY subset_id, cluster) AS size, row_number() OVER (PARTITION BY subset_id ORDER BY dist DESC, row_no) AS r, count(*) OVER (PARTITION BY subset_id) AS n FROM f) SELECT subset_id, row_no, CASE WHEN size <= 1 THEN -1 ELSE cluster END AS single, CASE WHEN size < 30 THEN -1 ELSE cluster END AS small, CASE WHEN r <= floor(n * 0.25) THEN -1 ELSE cluster END AS isolated FROM r")
def l07_noise_rules(spark: SparkSession, d: str) -> DataFrame:
    each = Window.partitionBy("subset_id")
    t = rows(spark, d).withColumns({"size": F.count(F.lit(1)).over(Window.partitionBy("subset_id", "cluster")), "r": F.row_number().over(each.orderBy(F.desc("dist"), "row_no")), "n": F.count(F.lit(1)).over(each)})
    rules = L.noise_rules(F.col("size"), F.col("r"), F.col("n"), small=30)
    return t.select("subset_id", "row_no", *[c.alias(n) for n, c in rules.items()])


@query(f"SELECT b.subset_id, b.row_no, CASE WHEN length({Q.clean('b.text', ' ')}) > 0 THEN f.pred ELSE -1 END AS label FROM bench_rows b JOIN feature_rows f USING (subset_id, row_no)")
def l09_blank_to_noise(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "bench_rows").join(table(spark, d, "feature_rows").select("subset_id", "row_no", "pred"), ["subset_id", "row_no"])
    return t.select("subset_id", "row_no", F.when(F.length(X.clean_long(F.col("text"))) > 0, F.col("pred")).otherwise(-1).alias("label"))


@query("WITH g AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (trim(coalesce(text, '')) <> '') OVER w AS filled, row_number() OVER (PARTITION BY keyword, source ORDER BY fetch_id) - 1 AS number FROM fresh_posts WINDOW w AS (PARTITION BY keyword, source)) SELECT fetch_id, CASE WHEN n < 3 THEN number WHEN filled < 3 OR n < 20 THEN 0 ELSE number END AS label FROM g")
def l11_tiny_inputs(spark: SparkSession, d: str) -> DataFrame:
    """The posts fetched for one keyword from one source are an input; in larger ones every post keeps its number."""
    each = Window.partitionBy("keyword", "source")
    t = table(spark, d, "fresh_posts").withColumns({"n": F.count(F.lit(1)).over(each), "filled": F.count(F.when(F.trim(F.coalesce("text", F.lit(""))) != "", 1)).over(each), "number": F.row_number().over(each.orderBy("fetch_id")) - 1})
    return t.select("fetch_id", L.tiny_inputs(F.col("n"), F.col("filled"), F.col("number"), F.col("number")).alias("label"))


@query(f"""WITH {_F}, q AS (SELECT subset_id, row_no, text, {SCRIPT_COUNTS_SQL} FROM bench_rows WHERE text IS NOT NULL), b AS (SELECT subset_id, row_no, {SCRIPT_SQL} AS script FROM (SELECT *, greatest(c1, c2, c3, c4, c5, c6) AS top FROM q)),
o AS (SELECT f.*, CASE WHEN script > 0 THEN -1.0 ELSE dist END AS isolation FROM f JOIN b USING (subset_id, row_no)), r AS (SELECT *, row_number() OVER (PARTITION BY subset_id ORDER BY isolation DESC, row_no) AS r, count(*) OVER (PARTITION BY subset_id) AS n FROM o)
SELECT subset_id, row_no, round(isolation, 6) AS isolation, CASE WHEN r <= floor(n * 0.25) AND isolation >= 0 THEN 1000000 + r - 1 ELSE cluster END AS relabelled FROM r""")
def l08_other_scripts_kept(spark: SparkSession, d: str) -> DataFrame:
    """Rows in a script other than Latin are never isolated, whatever their distance."""
    b = table(spark, d, "bench_rows").where("text is not null").select("subset_id", "row_no", X.script_id(F.col("text")).alias("script"))
    t = rows(spark, d).join(b, ["subset_id", "row_no"]).withColumn("isolation", F.when(F.col("script") > 0, -1.0).otherwise(F.col("dist")))
    s = L.singletons(t, "subset_id", "row_no", F.col("isolation"), 0.25)
    return s.select("subset_id", "row_no", F.round("isolation", 6).alias("isolation"), F.when(F.col("isolation") >= 0, F.col("relabelled")).otherwise(F.col("cluster")).alias("relabelled"))
