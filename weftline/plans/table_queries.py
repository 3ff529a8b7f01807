"""Queries on tables: aggregates, windows, joins, sets, samples, statistics and codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import codecs, metrics, sampling, statistics
from weftline.plans import sqltext as Q
from weftline.plans.registry import query
from weftline.session import table

T = table


@query("SELECT coalesce(label, 'NULL') AS label, count(*) AS n FROM post_pool GROUP BY ALL HAVING count(*) >= 150")
def a01_large_groups(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "post_pool").groupBy(F.coalesce("label", F.lit("NULL")).alias("label")).agg(F.count(F.lit(1)).alias("n")).where("n >= 150")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def a02_group_totals(spark: SparkSession, d: str) -> DataFrame:
    t = T(spark, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_orderpriority, round(avg(o_totalprice), 2) AS mean, median(o_totalprice) AS median, min(o_totalprice) AS least, max(o_totalprice) AS most, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY ALL")
def a03_summaries(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_totalprice")
    return T(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg(p), 2).alias("mean"), F.median(p).alias("median"), F.min(p).alias("least"), F.max(p).alias("most"), F.round(F.percentile(p, F.lit(0.9)), 4).alias("p90"))


@query("SELECT subset_id, round(avg(CASE WHEN pred = -1 THEN 1.0 ELSE 0.0 END), 6) AS noise, count(DISTINCT pred) FILTER (pred >= 0) AS clusters, (SELECT max(n) FROM (SELECT count(*) AS n FROM feature_rows g WHERE g.subset_id = f.subset_id AND pred >= 0 GROUP BY pred)) AS largest FROM feature_rows f WHERE pred IS NOT NULL GROUP BY subset_id")
def a04_cluster_profile(spark: SparkSession, d: str) -> DataFrame:
    c = T(spark, d, "feature_rows").where("pred is not null").groupBy("subset_id", "pred").agg(F.count(F.lit(1)).alias("n"))
    real = F.when(F.col("pred") >= 0, F.col("n"))
    return c.groupBy("subset_id").agg(F.round(F.coalesce(F.sum(F.when(F.col("pred") == -1, F.col("n"))), F.lit(0)) / F.sum("n"), 6).alias("noise"), F.count(real).alias("clusters"), F.max(real).alias("largest"))


_PAIR = "p AS (SELECT f.subset_id, b.label AS t, f.pred AS p FROM feature_rows f JOIN bench_rows b USING (subset_id, row_no) WHERE b.label IS NOT NULL AND f.pred IS NOT NULL), c AS (SELECT subset_id, t, p, count(*) AS n FROM p GROUP BY ALL), a AS (SELECT subset_id, t, sum(n) AS n FROM c GROUP BY ALL), b AS (SELECT subset_id, p, sum(n) AS n FROM c GROUP BY ALL), n AS (SELECT subset_id, sum(n) AS n FROM c GROUP BY ALL)"
_SCORE = f"""WITH {_PAIR}, pc AS (SELECT subset_id, sum(n * (n - 1) / 2) AS x FROM c GROUP BY ALL), pa AS (SELECT subset_id, sum(n * (n - 1) / 2) AS x FROM a GROUP BY ALL), pb AS (SELECT subset_id, sum(n * (n - 1) / 2) AS x FROM b GROUP BY ALL),
ha AS (SELECT subset_id, -sum(a.n / n.n * ln(a.n / n.n)) AS h FROM a JOIN n USING (subset_id) GROUP BY subset_id), hb AS (SELECT subset_id, -sum(b.n / n.n * ln(b.n / n.n)) AS h FROM b JOIN n USING (subset_id) GROUP BY subset_id),
mi AS (SELECT c.subset_id, sum(c.n / n.n * ln(c.n * n.n / (a.n * b.n))) AS m FROM c JOIN a ON a.subset_id = c.subset_id AND a.t = c.t JOIN b ON b.subset_id = c.subset_id AND b.p = c.p JOIN n ON n.subset_id = c.subset_id GROUP BY c.subset_id),
s AS (SELECT n.subset_id, n.n, (pc.x - pa.x * pb.x / (n.n * (n.n - 1) / 2)) / ((pa.x + pb.x) / 2 - pa.x * pb.x / (n.n * (n.n - 1) / 2)) AS ari, mi.m / ((ha.h + hb.h) / 2) AS nmi FROM n JOIN pc USING (subset_id) JOIN pa USING (subset_id) JOIN pb USING (subset_id) JOIN ha USING (subset_id) JOIN hb USING (subset_id) JOIN mi USING (subset_id))"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "feature_rows").select("subset_id", "row_no", "pred", "regime").join(T(spark, d, "bench_rows").select("subset_id", "row_no", "label"), ["subset_id", "row_no"])


@query(f"{_SCORE} SELECT subset_id, CAST(n AS BIGINT) AS n, round(ari, 6) AS ari, round(nmi, 6) AS nmi, round((greatest(ari, 0) + nmi) / 2, 6) AS combined FROM s")
def a05_a07_partition_scores(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.partition_scores(_labelled(spark, d), "subset_id", "label", "pred")
    return s.select("subset_id", "n", *[F.round(c, 6).alias(c) for c in ("ari", "nmi", "combined")])


@query(f"{_SCORE}, dom AS (SELECT subset_id, min(src) AS src FROM bench_rows GROUP BY subset_id), d AS (SELECT CASE WHEN src = 'reddit' THEN 0.75 ELSE 0.25 END AS w, avg((greatest(ari, 0) + nmi) / 2) AS c FROM s JOIN dom USING (subset_id) GROUP BY ALL) SELECT round(sum(w * c) / sum(w), 6) AS weighted FROM d")
def a08_domain_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Three quarters for the subsets of posts, one for the others; a missing domain leaves its weight to the other."""
    s = metrics.partition_scores(_labelled(spark, d), "subset_id", "label", "pred")
    dom = T(spark, d, "bench_rows").groupBy("subset_id").agg(F.min("src").alias("src"))
    c = s.join(dom, "subset_id").groupBy(F.when(F.col("src") == "reddit", 0.75).otherwise(0.25).alias("w")).agg(F.avg("combined").alias("c"))
    return c.agg(F.round(F.sum(F.col("w") * F.col("c")) / F.sum("w"), 6).alias("weighted"))


@query("SELECT b.subset_id, f.pred, count(*) AS n, round(max(c.n) / count(*), 6) AS purity FROM feature_rows f JOIN bench_rows b USING (subset_id, row_no) JOIN (SELECT g.subset_id, g.pred, h.label, count(*) AS n FROM feature_rows g JOIN bench_rows h USING (subset_id, row_no) WHERE h.label IS NOT NULL GROUP BY ALL) c ON c.subset_id = b.subset_id AND c.pred = f.pred AND c.label = b.label GROUP BY ALL")
def a10_purity(spark: SparkSession, d: str) -> DataFrame:
    c = _labelled(spark, d).where("label is not null and pred is not null").groupBy("subset_id", "pred", "label").agg(F.count(F.lit(1)).alias("k"))
    return c.groupBy("subset_id", "pred").agg(F.sum("k").alias("n"), F.round(F.max("k") / F.sum("k"), 6).alias("purity"))


@query("""WITH s AS (SELECT subset_id, row_no, length(b.text) AS score, (b.label = -1) AS pos FROM bench_rows b WHERE text IS NOT NULL AND label IS NOT NULL),
r AS (SELECT subset_id, pos, rank() OVER w + (count(*) OVER (PARTITION BY subset_id, score) - 1) / 2.0 AS rk, row_number() OVER (PARTITION BY subset_id ORDER BY score DESC, row_no) AS top, count(*) OVER (PARTITION BY subset_id) AS n FROM s WINDOW w AS (PARTITION BY subset_id ORDER BY score))
SELECT subset_id, round((sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 6) AS auc, round(avg(CASE WHEN pos THEN 1.0 ELSE 0.0 END) FILTER (top <= floor(0.15 * n)), 6) AS precision FROM r GROUP BY subset_id""")
def a11_rank_auc(spark: SparkSession, d: str) -> DataFrame:
    t = T(spark, d, "bench_rows").where("text is not null and label is not null").select("subset_id", "row_no", F.length("text").alias("score"), (F.col("label") == -1).alias("pos"))
    top = metrics.precision_at(t, "subset_id", "score", "pos", "row_no", 0.15)
    return metrics.rank_auc(t, "subset_id", "score", "pos").join(top, "subset_id").select("subset_id", F.round("auc", 6).alias("auc"), F.round("precision", 6).alias("precision"))


@query("SELECT l_orderkey, l_linenumber, sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS running FROM lineitem")
def a12_running_sum(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, 0)
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.sum("l_linenumber").over(w).alias("running"))


@query("SELECT regime, pred, count(*) AS n FROM feature_rows GROUP BY ALL")
def a13_histogram(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "feature_rows").groupBy("regime", "pred").agg(F.count(F.lit(1)).alias("n"))


@query("WITH u AS (SELECT event_type, user_id, avg(value) AS m, CASE WHEN max(value) >= 2 * avg(value) THEN 'peak' WHEN count(*) = 1 THEN 'single' ELSE 'even' END AS reason FROM events GROUP BY ALL), a AS (SELECT event_type, round(avg(m), 6) AS mean, round(min(m), 6) AS worst, round(median(m) FILTER (reason = 'even'), 6) AS median_even FROM u GROUP BY event_type) SELECT event_type, mean, worst, median_even, reason, n FROM a JOIN (SELECT event_type, reason, count(*) AS n FROM u GROUP BY ALL) USING (event_type)")
def a14_two_level(spark: SparkSession, d: str) -> DataFrame:
    """Mean, worst and a conditional median of users' means, beside how many users there are for each reason."""
    v = F.col("value")
    reason = F.when(F.max(v) >= 2 * F.avg(v), "peak").when(F.count(F.lit(1)) == 1, "single").otherwise("even")
    u = T(spark, d, "events").groupBy("event_type", "user_id").agg(F.avg(v).alias("m"), reason.alias("reason"))
    a = u.groupBy("event_type").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.min("m"), 6).alias("worst"), F.round(F.median(F.when(F.col("reason") == "even", F.col("m"))), 6).alias("median_even"))
    return a.join(u.groupBy("event_type", "reason").agg(F.count(F.lit(1)).alias("n")), "event_type").select("event_type", "mean", "worst", "median_even", "reason", "n")


@query("SELECT solution, max(took_s) AS slowest, count(DISTINCT request_id) AS requests FROM cluster_responses GROUP BY ALL")
def a15_a16_worst_and_distinct(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "cluster_responses").groupBy("solution").agg(F.max("took_s").alias("slowest"), F.count_distinct("request_id").alias("requests"))


# ---- windows -------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def w01_top_k_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return T(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def w02_global_top(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, round((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1) / greatest(count(*) OVER (PARTITION BY o_orderpriority) - 1, 1), 9) AS pct FROM orders")
def w03_percent_rank(spark: SparkSession, d: str) -> DataFrame:
    g = Window.partitionBy("o_orderpriority")
    pct = (F.row_number().over(g.orderBy("o_totalprice", "o_orderkey")) - 1) / F.greatest(F.count(F.lit(1)).over(g) - 1, F.lit(1))
    return T(spark, d, "orders").select("o_orderkey", F.round(pct, 9).alias("pct"))


@query("SELECT o_custkey, o_orderkey AS best FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def w05_arg_max(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"))


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents), t AS (SELECT doc_id, n, row_number() OVER (ORDER BY n, {Q.stable_hash('CAST(doc_id AS VARCHAR)')} % 64, doc_id) AS r FROM d WHERE n > 0),
g AS (SELECT r, doc_id, n, 0 AS batch, 1 AS c FROM t WHERE r = 1 UNION ALL SELECT t.r, t.doc_id, t.n, CASE WHEN (g.c + 1) * t.n <= 8192 THEN g.batch ELSE g.batch + 1 END, CASE WHEN (g.c + 1) * t.n <= 8192 THEN g.c + 1 ELSE 1 END FROM g JOIN t ON t.r = g.r + 1) SELECT doc_id, n, batch FROM g""")
def w06_length_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of documents in order of length whose padded size stays within 8,192 words."""
    t = T(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1)).alias("n")).where("n > 0")
    return sampling.length_batches(t, "doc_id", "n", 8192)


@query("SELECT subset_id, row_no, label FROM bench_rows ORDER BY label DESC NULLS LAST, subset_id, row_no LIMIT 50")
def w07_best_first(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "bench_rows").orderBy(F.desc_nulls_last("label"), "subset_id", "row_no").limit(50).select("subset_id", "row_no", "label")


@query("SELECT l_orderkey, l_linenumber, coalesce(list(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), []) AS ahead FROM lineitem")
def w08_next_rows(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(1, 3)
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.collect_list("l_partkey").over(w).alias("ahead"))


@query("SELECT o_custkey, list_sort(list(o_totalprice))[3] AS third FROM orders GROUP BY o_custkey HAVING count(*) >= 3")
def w09_order_statistic(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return T(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r = 3").select("o_custkey", F.col("o_totalprice").alias("third"))


# ---- joins and sets ------------------------------------------------------------------------------------------------


@query(f"WITH e AS (SELECT DISTINCT {Q.clean('text')} AS c FROM post_pool WHERE text IS NOT NULL) SELECT doc_id FROM (SELECT doc_id, {Q.clean('text')} AS c FROM documents WHERE text IS NOT NULL) WHERE c NOT IN (SELECT c FROM e)")
def j11_without_evaluation_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents to train on, without those whose cleaned text is in the pool that is evaluated on."""
    held = T(spark, d, "post_pool").select(X.clean(F.col("text")).alias("c")).where("c is not null").distinct()
    return T(spark, d, "documents").where("text is not null").select("doc_id", X.clean(F.col("text")).alias("c")).join(held, "c", "left_anti").select("doc_id")


@query("SELECT b.subset_id, b.row_no, b.label, f.pred, f.keep FROM bench_rows b JOIN feature_rows f USING (subset_id, row_no)")
def j12_aligned(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "bench_rows").join(T(spark, d, "feature_rows"), ["subset_id", "row_no"]).select("subset_id", "row_no", "label", "pred", "keep")


@query("SELECT b.subset_id, b.row_no, coalesce(f.pred, -1) AS label FROM bench_rows b LEFT JOIN (SELECT * FROM feature_rows WHERE keep) f USING (subset_id, row_no)")
def j13_expanded(spark: SparkSession, d: str) -> DataFrame:
    kept = T(spark, d, "feature_rows").where("keep").select("subset_id", "row_no", "pred")
    return T(spark, d, "bench_rows").select("subset_id", "row_no").join(kept, ["subset_id", "row_no"], "left").select("subset_id", "row_no", F.coalesce("pred", F.lit(-1)).alias("label"))


@query(f"WITH c AS (SELECT subset_id, row_no, {Q.clean('text')} AS c FROM bench_rows), u AS (SELECT c, min(subset_id * 1000000 + row_no) AS label FROM c WHERE c <> '' GROUP BY c) SELECT subset_id, row_no, coalesce(label, -1) AS label FROM c LEFT JOIN u USING (c)")
def j14_labels_back_to_copies(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct cleaned text is labelled once, by its first row, and the label goes back to all copies.  Labels are
    64-bit: above subset 2,147 they exceed 32."""
    rows = T(spark, d, "bench_rows").select("subset_id", "row_no", X.clean(F.col("text")).alias("c"))
    u = rows.where("c <> ''").groupBy("c").agg(F.min(F.col("subset_id").cast("long") * 1000000 + F.col("row_no")).alias("label"))
    return rows.join(u, "c", "left").select("subset_id", "row_no", F.coalesce("label", F.lit(-1)).alias("label"))


_SHIFT = _SCORE.replace("f.pred AS p", "CASE WHEN count(*) OVER (PARTITION BY f.subset_id, f.pred) < 110 THEN -1 ELSE f.pred END AS p")
_UNITS = f"one AS ({_SCORE} SELECT subset_id, (greatest(ari, 0) + nmi) / 2 AS c FROM s), two AS ({_SHIFT} SELECT subset_id, (greatest(ari, 0) + nmi) / 2 AS c FROM s)"


def paired_units(spark: SparkSession, d: str) -> DataFrame:
    """(subset_id, one, other): scores of two solutions, the predictions and those with clusters below 110 rows as noise."""
    t = T(spark, d, "feature_rows").select("subset_id", "row_no", "pred").join(T(spark, d, "bench_rows").select("subset_id", "row_no", "label"), ["subset_id", "row_no"])
    t = t.where("label is not null and pred is not null")
    t = t.withColumn("strict", F.when(F.count(F.lit(1)).over(Window.partitionBy("subset_id", "pred")) < 110, -1).otherwise(F.col("pred")))
    one, two = (metrics.partition_scores(t, "subset_id", "label", c).select("subset_id", F.col("combined").alias(n)) for c, n in (("pred", "one"), ("strict", "other")))
    return one.join(two, "subset_id")


@query(f"WITH {_UNITS} SELECT one.subset_id, round(one.c, 6) AS one, round(two.c, 6) AS other, round(100 * (two.c / one.c - 1), 4) + 0.0 AS gain FROM one JOIN two USING (subset_id)")
def j15_paired(spark: SparkSession, d: str) -> DataFrame:
    gain = F.round(100 * (F.col("other") / F.col("one") - 1), 4) + F.lit(0.0)
    return paired_units(spark, d).select("subset_id", gain.alias("gain"), F.round("one", 6).alias("one"), F.round("other", 6).alias("other"))


@query("SELECT s.solution, r.request_id FROM (SELECT DISTINCT solution FROM cluster_responses) s CROSS JOIN cluster_requests r")
def j16_jobs(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "cluster_requests").select("request_id").crossJoin(F.broadcast(T(spark, d, "cluster_responses").select("solution").distinct())).select("solution", "request_id")


@query("WITH f AS (SELECT q.request_id, count(DISTINCT r.solution) AS answers FROM cluster_requests q LEFT JOIN cluster_responses r ON r.request_id = q.request_id AND len(r.cluster_ids) = len(q.texts) GROUP BY ALL) SELECT request_id, answers, answers = (SELECT count(DISTINCT solution) FROM cluster_responses) AS by_all, answers = 0 AS skipped FROM f")
def j17_answered(spark: SparkSession, d: str) -> DataFrame:
    """Every request with the number of solutions that answered it in full, whether all did, and whether it is skipped."""
    q = T(spark, d, "cluster_requests").select("request_id", F.size("texts").alias("n"))
    r = T(spark, d, "cluster_responses")
    full = r.select("request_id", F.size("cluster_ids").alias("n"), "solution").distinct()
    solutions = r.agg(F.count_distinct("solution").alias("all"))
    f = q.join(full, ["request_id", "n"], "left").groupBy("request_id").agg(F.count("solution").alias("answers")).join(F.broadcast(solutions))
    return f.select("request_id", "answers", (F.col("answers") == F.col("all")).alias("by_all"), (F.col("answers") == 0).alias("skipped"))


@query("SELECT subset_id, round(max(n) / sum(n), 6) AS share FROM (SELECT subset_id, label, count(*) AS n FROM bench_rows WHERE label IS NOT NULL GROUP BY ALL) GROUP BY subset_id HAVING max(n) / sum(n) <= 0.5 AND count(*) > 1")
def j18_usable_references(spark: SparkSession, d: str) -> DataFrame:
    c = T(spark, d, "bench_rows").where("label is not null").groupBy("subset_id", "label").agg(F.count(F.lit(1)).alias("n"))
    s = c.groupBy("subset_id").agg((F.max("n") / F.sum("n")).alias("share"), F.count(F.lit(1)).alias("k"))
    return s.where("share <= 0.5 and k > 1").select("subset_id", F.round("share", 6).alias("share"))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j15_dimension_joins(spark: SparkSession, d: str) -> DataFrame:
    n = T(spark, d, "nation").join(T(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return T(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT text FROM eval_items UNION ALL SELECT text FROM fresh_posts")
def u01_union(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "eval_items").select("text").unionByName(T(spark, d, "fresh_posts").select("text"))


@query("SELECT post_id FROM post_pool WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY post_id) = 1")
def u02_first_of_copies(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "post_pool").where("text is not null").groupBy("text").agg(F.min("post_id").alias("post_id")).select("post_id")


@query("""WITH a AS (SELECT *, row_number() OVER (ORDER BY paper_id, title, cat) AS k FROM paper_pool), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY lower(paper_id) ORDER BY title, cat) = 1)
SELECT paper_id, title FROM b QUALIFY row_number() OVER (PARTITION BY lower(title) ORDER BY paper_id, cat) = 1""")
def u03_first_by_title_or_id(spark: SparkSession, d: str) -> DataFrame:
    t = T(spark, d, "paper_pool")
    by_id, by_title = Window.partitionBy(F.lower("paper_id")).orderBy(F.asc_nulls_last("title"), F.asc_nulls_last("cat")), Window.partitionBy(F.lower("title")).orderBy("paper_id", F.asc_nulls_last("cat"))
    t = t.withColumn("r", F.row_number().over(by_id)).where("r = 1")
    return t.withColumn("r", F.row_number().over(by_title)).where("r = 1").select("paper_id", "title")


@query("SELECT keyword, min(fetch_id) AS first FROM fresh_posts GROUP BY keyword")
def u04_ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "fresh_posts").groupBy("keyword").agg(F.min("fetch_id").alias("first"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM subject_labels")
def u05_difference(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "documents").select("doc_id").subtract(T(spark, d, "subject_labels").select("doc_id"))


@query("SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def u06_intersection(spark: SparkSession, d: str) -> DataFrame:
    t = T(spark, d, "lineitem")
    return t.where("l_returnflag = 'R'").select("l_suppkey").intersect(t.where("l_returnflag = 'A'").select("l_suppkey"))


# ---- samples and statistics ----------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 200")
def sampling_p01_uniform_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.uniform(T(spark, d, "documents").select("doc_id"), "doc_id", 200, 7)


@query("""WITH q AS (SELECT label, CAST(floor(count(*) * 0.2) AS BIGINT) AS quota FROM post_pool WHERE label IS NOT NULL GROUP BY label HAVING count(*) >= 150)
SELECT post_id, label FROM post_pool JOIN q USING (label) QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('3:' || post_id), post_id) <= quota""")
def sampling_p02_topic_quotas(spark: SparkSession, d: str) -> DataFrame:
    t = T(spark, d, "post_pool").select("post_id", "label")
    q = t.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n >= 150").select("label", F.floor(F.col("n") * 0.2).alias("quota"))
    return sampling.by_quota(t, "post_id", "label", q, 3).select("post_id", "label")


@query(f"SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY round(-ln({Q.stable_hash(chr(39) + '5:' + chr(39) + ' || c_custkey')} / 4294967296.0 + 1.0 / 8589934592) / c_acctbal, 9), c_custkey LIMIT 100")
def sampling_p03_weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.weighted(T(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal", 100, 5).select("c_custkey")


@query("""WITH q AS (SELECT data_type, CASE data_type WHEN 'post' THEN 400 ELSE 100 END AS quota FROM (SELECT DISTINCT data_type FROM post_pool WHERE data_type IS NOT NULL))
SELECT post_id, data_type FROM post_pool JOIN q USING (data_type) QUALIFY row_number() OVER (PARTITION BY data_type ORDER BY md5('4:' || post_id), post_id) <= quota""")
def sampling_p04_mixed_types(spark: SparkSession, d: str) -> DataFrame:
    t = T(spark, d, "post_pool").select("post_id", "data_type").where("data_type is not null")
    q = t.select("data_type").distinct().withColumn("quota", F.when(F.col("data_type") == "post", 400).otherwise(100))
    return sampling.by_quota(t, "post_id", "data_type", q, 4)


@query("SELECT subset_id, row_no, row_number() OVER (PARTITION BY subset_id ORDER BY md5('9:' || row_no), row_no) AS place FROM bench_rows")
def sampling_p05_permutation(spark: SparkSession, d: str) -> DataFrame:
    return sampling.permutation(T(spark, d, "bench_rows").select("subset_id", "row_no"), "row_no", "subset_id", 9)


@query(f"WITH s AS (SELECT list_sort(list(took_s)) AS v, count(*) AS n FROM cluster_responses WHERE took_s IS NOT NULL), d AS (SELECT r, v[{Q.stable_hash('(' + chr(39) + '1:' + chr(39) + ' || r || ' + chr(39) + ':' + chr(39) + ' || i)')} % n + 1] AS x FROM range(1000) r(r), s, unnest(range(1, n + 1)) AS t(i)) SELECT r AS replicate, round(avg(x), 6) AS mean FROM d GROUP BY r")
def sampling_p06_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return sampling.bootstrap(T(spark, d, "cluster_responses"), "took_s", 1000, 1).withColumn("mean", F.round("mean", 6))


@query(f"SELECT doc_id, {Q.stable_hash(chr(39) + '2:' + chr(39) + ' || doc_id')} / 4294967296.0 < 0.1 AS held_out FROM documents")
def sampling_p07_split(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "documents").select("doc_id", (X.stable_uniform(F.col("doc_id"), 2) < 0.1).alias("held_out"))


@query("SELECT subset_id, row_no, CAST([0.0, 0.25, 0.5, 0.75, 1.0][row_no % 5 + 1] AS DOUBLE) AS level FROM bench_rows")
def sampling_p08_round_robin(spark: SparkSession, d: str) -> DataFrame:
    levels = F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])
    return T(spark, d, "bench_rows").select("subset_id", "row_no", F.element_at(levels, F.col("row_no") % 5 + 1).alias("level"))


_DIFF = "d AS (SELECT o_orderpriority AS g, o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 2) AS x FROM orders)"


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    t = T(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), "o_orderkey", "o_totalprice")
    mean = t.groupBy("g").agg(F.avg("o_totalprice").alias("m"))
    return t.join(mean, "g").select("g", "o_orderkey", F.round(F.col("o_totalprice") - F.col("m"), 2).alias("x"))


@query(f"WITH {_DIFF}, c AS (SELECT g, count(*) FILTER (x > 0) AS better, count(*) FILTER (x < 0) AS worse FROM d GROUP BY g), t AS (SELECT *, unnest(range(better, better + worse + 1)) AS k FROM c) SELECT g, better, worse, round(sum(exp(lgamma(better + worse + 1.0) - lgamma(k + 1.0) - lgamma(better + worse - k + 1.0) - (better + worse) * ln(2.0))), 6) AS p FROM t GROUP BY ALL")
def r01_sign_test(spark: SparkSession, d: str) -> DataFrame:
    return statistics.sign_test(_diffs(spark, d), "g", "x").withColumn("p", F.round("p", 6))


@query(f"WITH {_DIFF}, r AS (SELECT g, x, abs(x) AS a, rank() OVER (PARTITION BY g ORDER BY abs(x)) + (count(*) OVER (PARTITION BY g, abs(x)) - 1) / 2.0 AS rk FROM d WHERE x <> 0), s AS (SELECT g, count(*) AS n, sum(rk) FILTER (x > 0) AS w FROM r GROUP BY g), t AS (SELECT g, sum(k * k * k - k) AS ties FROM (SELECT g, a, count(*) AS k FROM r GROUP BY ALL) GROUP BY g), z AS (SELECT g, n, w, (w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS z FROM s JOIN t USING (g)) SELECT g, n, round(w, 3) AS w_plus, round(z, 6) AS z FROM z")
def r02_signed_rank(spark: SparkSession, d: str) -> DataFrame:
    return statistics.signed_rank(_diffs(spark, d), "g", "x").select("g", "n", F.round("w_plus", 3).alias("w_plus"), F.round("z", 6).alias("z"))


@query()
def r01_sign_test_whole(spark: SparkSession, d: str) -> DataFrame:
    """The former name of the test over all orders, which ``r01_sign_test`` is now too."""
    return r01_sign_test(spark, d)


@query()
def r02_signed_rank_whole(spark: SparkSession, d: str) -> DataFrame:
    """The former name of the rank sum over all orders."""
    return r02_signed_rank(spark, d).select("g", "n", "w_plus")


@query()
def r02_one_sided(spark: SparkSession, d: str) -> DataFrame:
    """The one-sided p value of the rank sum by the normal approximation; SQL here has no error function."""
    s = statistics.signed_rank(_diffs(spark, d), "g", "x")
    return s.select("g", "n", statistics.normal_tail(F.col("z")).alias("p"))


VARIANTS, ORDERS = ("label", "src_label"), 3


def all_units(spark: SparkSession, d: str) -> DataFrame:
    """(subset_id, variant, order_no, main, one, other): the two solutions' scores against both kinds of labels, each on
    three seeded two-thirds of the subset."""
    b = T(spark, d, "bench_rows").select("subset_id", "row_no", F.col("label").cast("string").alias("label"), "src_label", (F.col("src") == "reddit").alias("main"))
    t = T(spark, d, "feature_rows").where("pred is not null").select("subset_id", "row_no", "pred")
    t = t.withColumn("strict", F.when(F.count(F.lit(1)).over(Window.partitionBy("subset_id", "pred")) < 110, -1).otherwise(F.col("pred")))
    t = t.join(b, ["subset_id", "row_no"]).withColumn("part", X.stable_hash(F.col("row_no").cast("string")) % ORDERS)
    t = t.withColumn("v", F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("truth")) for v in VARIANTS]))).withColumn("order_no", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))))
    t = t.where("part <> order_no and v.truth is not null").select(F.struct("subset_id", "v.variant", "order_no", "main").alias("unit"), F.col("v.truth").alias("truth"), "pred", "strict")
    one, two = (metrics.partition_scores(t, "unit", "truth", c).select("unit", F.col("combined").alias(n)) for c, n in (("pred", "one"), ("strict", "other")))
    return one.join(two, "unit").select("unit.*", "one", "other")


_PARTS = f"({Q.stable_hash('CAST(row_no AS VARCHAR)')} % 3)"


@query(f"""WITH c AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY subset_id, pred) < 110 THEN -1 ELSE pred END AS strict FROM feature_rows WHERE pred IS NOT NULL),
v AS (SELECT c.subset_id, c.row_no, c.pred, c.strict, unnest([{{'k': 'label', 't': CAST(b.label AS VARCHAR)}}, {{'k': 'src_label', 't': b.src_label}}]) AS v FROM c JOIN bench_rows b USING (subset_id, row_no)), o AS (SELECT *, unnest(range(3)) AS order_no FROM v),
u AS (SELECT subset_id, v.k AS variant, order_no, v.t AS truth, pred, strict FROM o WHERE v.t IS NOT NULL AND {_PARTS} <> order_no)
SELECT subset_id, variant, CAST(order_no AS INT) AS order_no, count(*) AS n, count(DISTINCT truth) AS groups, count(DISTINCT strict) AS found FROM u GROUP BY ALL""")
def r05_paired_units(spark: SparkSession, d: str) -> DataFrame:
    """Every unit of subset, kind of label and order that both solutions have, with its size."""
    b = T(spark, d, "bench_rows").select("subset_id", "row_no", F.col("label").cast("string").alias("label"), "src_label")
    t = T(spark, d, "feature_rows").where("pred is not null").select("subset_id", "row_no", "pred")
    t = t.withColumn("strict", F.when(F.count(F.lit(1)).over(Window.partitionBy("subset_id", "pred")) < 110, -1).otherwise(F.col("pred"))).join(b, ["subset_id", "row_no"])
    t = t.withColumn("v", F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("truth")) for v in VARIANTS]))).withColumn("order_no", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))))
    t = t.where((X.stable_hash(F.col("row_no").cast("string")) % ORDERS != F.col("order_no")) & F.col("v.truth").isNotNull())
    return t.groupBy("subset_id", "v.variant", "order_no").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v.truth").alias("groups"), F.count_distinct("strict").alias("found"))


@query()
def r04_simulated_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Chances of the gain of 20,000 rounds, each of three subsets of posts and one other, above thresholds."""
    g = sampling.simulated_rounds(all_units(spark, d).select("subset_id", "main", "one", "other"), 20_000, 4)
    return g.agg(F.round(F.median("gain"), 4).alias("median"), *[F.avg((F.col("gain") > t).cast("double")).alias(f"above_{str(t).replace('.', '_')}") for t in (0, 1, 1.5, 2, 3)])


@query()
def sampling_p02_topic_subset(spark: SparkSession, d: str) -> DataFrame:
    """A subset of 2,000 posts around focus topics."""
    return sampling.topic_subset(T(spark, d, "post_pool"), "post_id", "text", "label", 2000, 3, least=50)


@query()
def sampling_p03_group_mix(spark: SparkSession, d: str) -> DataFrame:
    """300 papers, fields mixed by fixed shares with jitter."""
    t = T(spark, d, "paper_pool").groupBy("paper_id").agg(F.min(F.substring_index("cat", ".", 1)).alias("field"))
    return sampling.group_mix(t, "paper_id", "field", 300, 5, {"geo": 0.4, "bio": 0.3, "cmp": 0.2, "ast": 0.1})


@query("WITH s AS (SELECT subset_id, count(*) AS rows FROM bench_rows GROUP BY ALL) SELECT h.subset_id AS held_out, s.subset_id, s.rows FROM s h JOIN s ON h.subset_id <> s.subset_id")
def sampling_p07_left_out(spark: SparkSession, d: str) -> DataFrame:
    return sampling.left_out_folds(T(spark, d, "bench_rows"), "subset_id")


@query()
def r03_bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    b = sampling.bootstrap(T(spark, d, "cluster_responses"), "took_s", 2000, 1)
    return b.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"), F.avg((F.col("mean") > 60).cast("int")).alias("p_above"))


@query(f"WITH {_UNITS} SELECT one.subset_id, CASE WHEN round(100 * (two.c / one.c - 1), 4) >= 1.5 THEN 'go' WHEN round(100 * (two.c / one.c - 1), 4) >= 1.0 THEN 'borderline' ELSE 'no' END AS decision FROM one JOIN two USING (subset_id)")
def r07_decision(spark: SparkSession, d: str) -> DataFrame:
    return j15_paired(spark, d).select("subset_id", statistics.decision(F.col("gain")).alias("decision"))


BOOK = [-0.3, -0.1, 0.0, 0.1, 0.3]


@query(f"WITH e AS (SELECT vec_id, unnest(range(32)) AS pos, CAST(unnest(g) AS DOUBLE) AS x FROM feature_rows WHERE g IS NOT NULL), q AS (SELECT vec_id, pos, list_min(list_transform(range(5), lambda i: {{'d': round(abs(x - CAST({BOOK}[i + 1] AS DOUBLE)), 9), 'i': i}})).i AS code FROM e) SELECT vec_id, CAST(pos AS INT) AS pos, CAST(code AS INT) AS code, CAST({BOOK}[code + 1] AS DOUBLE) AS value FROM q")
def d07_quantised(spark: SparkSession, d: str) -> DataFrame:
    t = T(spark, d, "feature_rows").where("g is not null").select("vec_id", F.posexplode("g").alias("pos", "x"))
    code = codecs.nearest_code(F.col("x").cast("double"), BOOK)
    return t.select("vec_id", "pos", code.alias("code"), F.element_at(codecs.dequantise(F.array(code), BOOK), 1).alias("value"))


@query("WITH e AS (SELECT vec_id, unnest(range(16)) AS pos, CAST(unnest(proj_bd) AS DOUBLE) AS x FROM feature_rows WHERE proj_bd IS NOT NULL), q AS (SELECT quantile_cont(abs(x), 0.75) AS e FROM e) SELECT vec_id, CAST(pos AS INT) AS pos FROM e, q WHERE abs(x) >= e")
def d08_pruned(spark: SparkSession, d: str) -> DataFrame:
    t = T(spark, d, "feature_rows").where("proj_bd is not null").select("vec_id", F.posexplode("proj_bd").alias("pos", "x"))
    return codecs.prune_small(t.withColumn("x", F.col("x").cast("double")), "x", 0.25).select("vec_id", "pos")


@query("SELECT l_orderkey, l_linenumber, [l_partkey % 256 & 15, (l_partkey % 256 >> 4) & 15] AS codes FROM lineitem")
def d09_nibbles(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", codecs.unpack_nibbles(F.col("l_partkey") % 256).alias("codes"))


@query("SELECT vec_id, CAST(pos AS INT) AS pos, round(x * (pred + 1), 6) + 0.0 AS value FROM (SELECT vec_id, pred, unnest(range(len(g))) AS pos, CAST(unnest(g) AS DOUBLE) AS x FROM feature_rows WHERE g IS NOT NULL AND pred IS NOT NULL)")
def d11_gated(spark: SparkSession, d: str) -> DataFrame:
    t = T(spark, d, "feature_rows").where("g is not null and pred is not null").select("vec_id", "pred", F.posexplode("g").alias("pos", "x"))
    return t.select("vec_id", "pos", (F.round(F.col("x").cast("double") * (F.col("pred") + 1), 6) + F.lit(0.0)).alias("value"))


@query("SELECT b.subset_id, b.row_no, dense_rank() OVER (ORDER BY b.subset_id) - 1 AS grp FROM bench_rows b WHERE b.text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM eval_items e WHERE e.text = b.text) QUALIFY row_number() OVER (PARTITION BY b.text ORDER BY b.subset_id, b.row_no) = 1")
def d04_training_set(spark: SparkSession, d: str) -> DataFrame:
    b = T(spark, d, "bench_rows").where("text is not null").join(T(spark, d, "eval_items").select("text").distinct(), "text", "left_anti")
    first = b.groupBy("text").agg(F.min(F.struct("subset_id", "row_no")).alias("k")).select("k.*")
    ids = b.select("subset_id").distinct().withColumn("grp", F.dense_rank().over(Window.orderBy("subset_id")) - 1)
    return first.join(ids, "subset_id").select("subset_id", "row_no", "grp")
