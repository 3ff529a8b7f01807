"""Further queries: blends, centring, component removal, density probe, merges, simulated rounds, learned noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import features as O
from weftline.operators import knn as K
from weftline.operators.labels import adaptive_cut
from weftline.operators.svd import truncated_svd
from weftline.plans import noise
from weftline.plans import sqltext as Q
from weftline.plans.registry import query
from weftline.plans.text_queries import BENCH, BENCH_TF_SQL, TOK_SQL, bench, bench_tf, bench_tfidf, bench_tokens
from weftline.plans.vector_queries import CENT, NN, neighbours
from weftline.session import cut, table

def _bm_sql(tf: str, out: str, limit: int, weight: float) -> str:
    """Clauses of the Okapi weights ``out`` of the counts ``tf``, of the ``limit`` most frequent terms."""
    return f"""{out}_df AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM {tf} GROUP BY term HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT {limit}), {out}_p AS (SELECT * FROM {tf} JOIN {out}_df USING (term)),
{out}_dl AS (SELECT subset_id, row_no, sum(tf) AS dl FROM {out}_p GROUP BY ALL), {out}_a AS (SELECT avg(dl) AS avgdl FROM {out}_dl),
{out} AS (SELECT subset_id, row_no, term, {weight}::DOUBLE * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 4 / (tf + 3 * (1 - 0.75 + 0.75 * dl / avgdl)) AS v FROM {out}_p JOIN {out}_dl USING (subset_id, row_no), {out}_a, n)"""


#: Features of the word block and of the character block, weight of the latter, rank of the decomposition.
WORDS, CHARS, CHAR_WEIGHT, BLEND_RANK = 20_000, 8_000, 0.35, 192


def blended(spark: SparkSession, d: str) -> DataFrame:
    """(subset_id, row_no, term, value): Okapi weights of words beside weaker ones of characters, rows of unit length."""
    n = table(spark, d, "bench_rows").count()
    w = O.bm25(cut(bench_tf(spark, d)), BENCH, n, min_df=2, max_features=WORDS)
    c = X.clean(F.col("text"))
    grams = F.transform(F.sequence(F.lit(1), F.length("c") - 2), lambda i: F.concat(F.lit("#"), F.substring(F.col("c"), i, 3)))
    chars = cut(O.counts(bench(spark, d).select(*BENCH, c.alias("c")).where("length(c) >= 3"), BENCH, grams))
    chars = O.bm25(chars, BENCH, n, min_df=2, max_features=CHARS).withColumn("value", CHAR_WEIGHT * F.col("value"))
    return O.unit(w.unionByName(chars), BENCH)


@query(f"""WITH {BENCH_TF_SQL}, n AS (SELECT count(*) AS n FROM bench_rows), c0 AS (SELECT subset_id, row_no, '#' || unnest(list_transform(range(1, length({Q.clean('text')}) - 1), lambda i: substr({Q.clean('text')}, i, 3))) AS term FROM bench_rows WHERE length({Q.clean('text')}) >= 3),
ctf AS (SELECT subset_id, row_no, term, count(*) AS tf FROM c0 GROUP BY ALL), {_bm_sql('tf', 'w', WORDS, 1.0)}, {_bm_sql('ctf', 'c', CHARS, CHAR_WEIGHT)}, b AS (SELECT * FROM w UNION ALL SELECT * FROM c)
SELECT subset_id, row_no, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY subset_id, row_no)), 6) AS value FROM b""")
def f07_blended_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blended(spark, d).withColumn("value", F.round("value", 6))


@query()
def f07_blended_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The blended blocks in 192 dimensions."""
    return truncated_svd(cut(blended(spark, d)), BENCH, BLEND_RANK).coordinates()


def _window_words(spark: SparkSession, d: str):  # noqa: ANN202
    """Decomposed co-occurrence in windows, of words of three records or more, the 20,000 most frequent ones."""
    tok = bench_tokens(spark, d)
    vocab = O.counts(tok, BENCH, F.col("tok")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).where("df >= 3").orderBy(F.desc("cf"), "term").limit(20_000).select("term")
    pairs = O.window_pairs(tok, BENCH, F.col("tok"), 10)
    pairs = pairs.join(vocab.select(F.col("term").alias("a")), "a", "left_semi").join(vocab.select(F.col("term").alias("b")), "b", "left_semi")
    return truncated_svd(cut(O.ppmi(cut(pairs)).select(F.col("a").alias("word"), F.col("b").alias("term"), "value")), ["word"], 128)


@query()
def f08_word_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(term, v): words in the 128 leading dimensions of their windowed co-occurrence."""
    return _window_words(spark, d).term_vectors()


@query()
def f09_document_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(subset_id, row_no, v): means, by rarity, of the words' vectors of 96 dimensions from document co-occurrence."""
    n = table(spark, d, "bench_rows").count()
    tf = cut(bench_tf(spark, d))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df >= 3")
    vocab = df.orderBy(F.desc("df"), "term").limit(6000)
    pairs = cut(O.document_pairs(bench_tokens(spark, d), BENCH, F.col("tok"), vocab))
    words = truncated_svd(cut(O.ppmi(pairs).select(F.col("a").alias("word"), F.col("b").alias("term"), "value")), ["word"], 96)
    weighted = tf.join(df, "term").select(*BENCH, "term", F.greatest(F.log(F.lit(float(n)) / (1 + F.col("df"))), F.lit(0.0)).alias("w")).where("w > 0")
    return words.weighted_means(weighted, BENCH, "w")


@query()
def f11_weighted_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(subset_id, row_no, v): means of the window vectors by smooth inverse frequency, without the common component."""
    from weftline.operators.matrix import components, project

    tf = cut(bench_tf(spark, d))
    weighted = tf.join(O.sif(tf), "term").select(*BENCH, "term", (F.col("tf") * F.col("weight")).alias("w"))
    v = cut(_window_words(spark, d).weighted_means(weighted, BENCH, "w"))
    return project(v, BENCH, "v", components(v, "v", 1, centre=False)[1], remove=True)


@query(f"WITH {BENCH_TF_SQL}, c AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY term), s AS (SELECT sum(cf) AS s FROM c), v AS (SELECT term, {Q.stable_hash('term')} / 4294967296.0 - 0.5 AS v FROM c) SELECT subset_id, row_no, round(sum(tf * 0.001 / (0.001 + cf / s) * v) / sum(tf * 0.001 / (0.001 + cf / s)), 6) AS mean FROM tf JOIN c USING (term) JOIN v USING (term), s GROUP BY subset_id, row_no")
def f11_weighted_average(spark: SparkSession, d: str) -> DataFrame:
    tf = bench_tf(spark, d)
    w = O.sif(tf).withColumn("v", X.stable_hash(F.col("term")) / 4294967296.0 - 0.5)
    j = tf.join(w, "term")
    mass = F.col("tf") * F.col("weight")
    return j.groupBy(*BENCH).agg(F.round(F.sum(mass * F.col("v")) / F.sum(mass), 6).alias("mean"))


@query(f"WITH e AS (SELECT vec_id, list_dot_product(CAST(g AS DOUBLE[]), CAST(g AS DOUBLE[])) AS nn, unnest(range(len(g))) AS pos, CAST(unnest(g) AS DOUBLE) AS x FROM feature_rows WHERE g IS NOT NULL) SELECT vec_id, CAST(pos AS INT) AS pos, round(CASE WHEN nn > 0 THEN x ELSE ({Q.stable_hash('vec_id || ' + chr(39) + ':' + chr(39) + ' || pos')} / 4294967296.0::DOUBLE - 0.5::DOUBLE) * 0.002::DOUBLE END, 9) AS x FROM e")
def f12_zero_vectors_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Zero vectors get tiny ones that depend on their id only, so that they have a direction."""
    t = table(spark, d, "feature_rows").where("g is not null").select("vec_id", "g", K.norm(F.col("g")).alias("nn")).select("vec_id", "nn", F.posexplode("g").alias("pos", "x"))
    tiny = (X.stable_hash(F.concat(F.col("vec_id").cast("string"), F.lit(":"), F.col("pos").cast("string"))) / 4294967296.0 - 0.5) * 0.002
    return t.select("vec_id", "pos", F.round(F.when(F.col("nn") > 0, F.col("x").cast("double")).otherwise(tiny), 9).alias("x"))


@query("WITH e AS (SELECT vec_id, subset_id, unnest(range(32)) AS pos, CAST(unnest(g) AS DOUBLE) AS x FROM feature_rows WHERE g IS NOT NULL), c AS (SELECT vec_id, pos, x - avg(x) OVER (PARTITION BY subset_id, pos) AS x FROM e) SELECT vec_id, CAST(pos AS INT) AS pos, round(x / nullif(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 0), 6) AS x FROM c")
def f16_centred(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "feature_rows").where("g is not null").select("vec_id", "subset_id", F.posexplode("g").alias("pos", "x"))
    mean = e.groupBy("subset_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = e.join(mean, ["subset_id", "pos"]).select("vec_id", "pos", (F.col("x").cast("double") - F.col("m")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("vec_id")))
    return c.select("vec_id", "pos", F.round(F.col("x") / F.nullif(norm, F.lit(0.0)), 6).alias("x"))


@query()
def f17_reference_features(spark: SparkSession, d: str) -> DataFrame:
    """(subset_id, row_no, v): TF-IDF in the 100 leading singular dimensions, unit length."""
    v = truncated_svd(cut(bench_tfidf(spark, d)), BENCH, 100).coordinates()
    return v.select(*BENCH, K.normalise(F.col("v")).alias("v"))


@query()
def v03_sparse_svd(spark: SparkSession, d: str) -> DataFrame:
    """(component, sigma): leading singular values of the term weights of the labelled texts."""
    s = truncated_svd(cut(bench_tfidf(spark, d)), BENCH, 128).sigma
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(s)], "component int, sigma double")


@query()
def v14_restricted_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosines of neighbours in the 16 leading principal coordinates beside those of the whole vectors."""
    from weftline.operators.matrix import components, project

    t = table(spark, d, "embeddings").select("vec_id", "embedding")
    part = cut(project(t, ["vec_id"], "embedding", components(t, "embedding", 16)[1]).select("vec_id", K.normalise(F.col("embedding")).alias("v")))
    nn = neighbours(spark, d, 10).select("src", "dst", (1 - F.col("dist")).alias("cosine"))
    x, y = (part.select(F.col("vec_id").alias(i), F.col("v").alias(f"v_{i}")) for i in ("src", "dst"))
    return nn.join(x, "src").join(y, "dst").select("src", "dst", "cosine", K.dot(F.col("v_src"), F.col("v_dst")).alias("restricted"))


@query()
def d01_distilled_projection(spark: SparkSession, d: str) -> DataFrame:
    """(subset_id, row_no, v): hashed words mapped by ridge regression to the leading principal coordinates of ``g``."""
    from weftline.operators.matrix import distil

    hashed_ = cut(O.hashed(bench_tf(spark, d), BENCH, 512))
    return distil(hashed_, table(spark, d, "feature_rows").where("g is not null").select(*BENCH, "g"), BENCH, "g", 512, 16, 1.0)


@query()
def v04_components_removed(spark: SparkSession, d: str) -> DataFrame:
    from weftline.operators.matrix import components, project

    t = table(spark, d, "embeddings")
    _, basis = components(t, "embedding", 4)
    return project(t, ["vec_id"], "embedding", basis, remove=True)


@query()
def v06_principal_coordinates(spark: SparkSession, d: str) -> DataFrame:
    from weftline.operators.matrix import components, project

    t = table(spark, d, "embeddings")
    _, basis = components(t, "embedding", 16)
    return project(t, ["vec_id"], "embedding", basis)


@query("SELECT vec_id, CASE WHEN isfinite(value) THEN round(value, 6) ELSE 0 END AS value FROM (SELECT vec_id, CASE WHEN g[2] = 0 THEN NULL ELSE CAST(g[1] AS DOUBLE) / CAST(g[2] AS DOUBLE) END AS value FROM feature_rows WHERE g IS NOT NULL) WHERE value IS NOT NULL UNION ALL SELECT vec_id, 0.0 FROM feature_rows WHERE g IS NOT NULL AND g[2] = 0")
def v11_guarded_division(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "feature_rows").where("g is not null")
    ratio = F.try_divide(F.get("g", F.lit(0)).cast("double"), F.get("g", F.lit(1)).cast("double"))
    return t.select("vec_id", F.round(F.coalesce(F.nanvl(ratio, F.lit(0.0)), F.lit(0.0)), 6).alias("value"))


@query(f"WITH {CENT} SELECT a.c AS a, b.c AS b, CASE WHEN a.c = b.c THEN 0 ELSE round(list_dot_product(a.v, b.v), 6) END AS sim FROM c a, c b")
def v12_similarity_matrix(spark: SparkSession, d: str) -> DataFrame:
    c = K.centroids(table(spark, d, "embeddings"), "label", "embedding")  # one row per label
    x, y = (c.select(F.col("label").alias(n), F.col("v").alias(f"v{n}")) for n in ("a", "b"))
    return x.join(F.broadcast(y)).select("a", "b", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.round(K.dot(F.col("va"), F.col("vb")), 6)).alias("sim"))


_KNN = "u AS (SELECT subset_id, row_no, list_transform(CAST({c} AS DOUBLE[]), lambda x: CASE WHEN list_dot_product(CAST({c} AS DOUBLE[]), CAST({c} AS DOUBLE[])) > 0 THEN x / sqrt(list_dot_product(CAST({c} AS DOUBLE[]), CAST({c} AS DOUBLE[]))) ELSE x END) AS v FROM feature_rows WHERE {c} IS NOT NULL), p AS (SELECT a.subset_id, a.row_no AS src, b.row_no AS dst, greatest(round((1 - list_dot_product(a.v, b.v)) * 1e6), 0) / 1e6 AS dist FROM u a JOIN u b ON a.subset_id = b.subset_id AND a.row_no <> b.row_no), nn AS (SELECT *, row_number() OVER (PARTITION BY subset_id, src ORDER BY dist, dst) AS rank FROM p QUALIFY rank <= {k})"


def knn_sql(c: str, k: int) -> str:
    return _KNN.format(c=c, k=k)


_DENSITY = f"{knn_sql('g', 12)}, s AS (SELECT subset_id, v, row_number() OVER (PARTITION BY subset_id ORDER BY md5('6:' || row_no), row_no) AS r FROM u QUALIFY r <= 300), k AS (SELECT subset_id, avg(dist) AS near FROM nn WHERE rank = 12 GROUP BY ALL), f AS (SELECT a.subset_id, avg(greatest(1 - list_dot_product(a.v, b.v), 0)) AS far FROM s a JOIN s b ON a.subset_id = b.subset_id AND a.r < b.r GROUP BY ALL), den AS (SELECT subset_id, near / far AS density FROM k JOIN f USING (subset_id))"


@query(f"WITH {_DENSITY} SELECT subset_id, round(density, 5) AS density FROM den")
def j05_relative_density(spark: SparkSession, d: str) -> DataFrame:
    t = K.relative_density(table(spark, d, "feature_rows"), "row_no", "g", "subset_id")
    return t.select("subset_id", F.round("density", 5).alias("density"))


@query(f"WITH {_DENSITY}, b AS (SELECT subset_id, least(greatest((round(density, 6) - 0.1) / 0.22, 0), 1) AS beta FROM den) SELECT subset_id, CAST(round_even(40 + 180 * beta, 0) AS INT) AS k, round(0.25 + 0.15 * beta, 5) AS fraction FROM b")
def c08_adaptive_cut(spark: SparkSession, d: str) -> DataFrame:
    """Clusters to cut into and share of singletons, by the density of each subset."""
    den = K.relative_density(table(spark, d, "feature_rows"), "row_no", "g", "subset_id")
    return den.select("subset_id", *[c.alias(n) for n, c in adaptive_cut(F.round("density", 6)).items()])


@query(f"WITH {knn_sql('g', 10)}, one AS (SELECT * FROM nn), two AS (SELECT * FROM ({'WITH ' + knn_sql('proj_bd', 10)} SELECT * FROM nn)) SELECT one.subset_id, one.src, round(count(two.dst) / 10.0, 6) AS recall FROM one LEFT JOIN two ON one.subset_id = two.subset_id AND one.src = two.src AND one.dst = two.dst GROUP BY ALL")
def j10_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many of the ten neighbours by one vector are neighbours by the other too."""
    t = table(spark, d, "feature_rows")
    one, two = (K.exact_knn(t, "row_no", c, 10, group="subset_id") for c in ("g", "proj_bd"))
    return K.recall(one, two, 10, group="subset_id").withColumn("recall", F.round("recall", 6))


@query(f"""WITH r AS (SELECT subset_id, label, {TOK_SQL} AS k, row_number() OVER (PARTITION BY subset_id, label ORDER BY row_no) AS rn FROM bench_rows WHERE label >= 0),
tf AS (SELECT subset_id, label, term, count(*) AS tf FROM (SELECT subset_id, label, unnest(k) AS term FROM r WHERE rn <= 80) GROUP BY ALL), n AS (SELECT count(DISTINCT subset_id * 100000 + label) AS n FROM tf), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT subset_id, label, term, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS v FROM tf JOIN df USING (term), n), u AS (SELECT subset_id, label, term, v / sqrt(sum(v * v) OVER (PARTITION BY subset_id, label)) AS x FROM w),
p AS (SELECT a.subset_id, a.label AS a, b.label AS b, round(sum(a.x * b.x), 6) AS sim FROM u a JOIN u b ON a.subset_id = b.subset_id AND a.term = b.term AND a.label < b.label GROUP BY ALL), best AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY subset_id ORDER BY sim DESC, a, b) = 1)
SELECT r.subset_id, r.row_no, best.sim, CASE WHEN best.sim >= 0.7 AND r.label = best.b THEN best.a ELSE r.label END AS merged FROM bench_rows r JOIN best USING (subset_id) WHERE r.label IS NOT NULL""")
def l04_most_similar_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Labels after the most similar pair of clusters of each subset is merged, if their pseudo-documents' cosine, of at
    most 80 texts each, is at least 0.7."""
    keys = ["subset_id", "label"]
    w = Window.partitionBy(*keys).orderBy("row_no")
    told = table(spark, d, "bench_rows").where("label is not null").select(*BENCH, "label")
    rows = told.where("label >= 0").withColumn("rn", F.row_number().over(w)).where("rn <= 80").select(*BENCH, "label")
    tf = cut(O.counts(bench_tokens(spark, d).join(rows, BENCH), keys, F.col("tok")))
    u = cut(O.tfidf(tf, keys, tf.select(*keys).distinct().count()))
    a, b = (u.select("subset_id", "term", F.col("label").alias(i), F.col("value").alias(f"v{i}")) for i in ("a", "b"))
    p = a.join(b, ["subset_id", "term"]).where("a < b").groupBy("subset_id", "a", "b").agg(F.round(F.sum(F.col("va") * F.col("vb")), 6).alias("sim"))
    best = Window.partitionBy("subset_id").orderBy(F.desc("sim"), "a", "b")
    top = p.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")
    return told.join(top, "subset_id").select(*BENCH, "sim", F.when((F.col("sim") >= 0.7) & (F.col("label") == F.col("b")), F.col("a")).otherwise(F.col("label")).alias("merged"))


@query("SELECT r.solution, count(*) FILTER (r.took_s < m.med) AS wins, round(avg(CASE WHEN isnan(r.took_s) THEN NULL ELSE r.took_s END), 6) AS mean, round(100 * (avg(r.took_s) / max(m.med) - 1), 4) AS gain FROM cluster_responses r, (SELECT median(took_s) AS med FROM cluster_responses) m GROUP BY r.solution")
def a09_wins_and_gains(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "cluster_responses")
    m = t.agg(F.median("took_s").alias("med"))
    clean = F.when(~F.isnan("took_s"), F.col("took_s"))
    return t.join(F.broadcast(m)).groupBy("solution").agg(F.count(F.when(F.col("took_s") < F.col("med"), 1)).alias("wins"), F.round(F.avg(clean), 6).alias("mean"), F.round(100 * (F.avg("took_s") / F.max("med") - 1), 4).alias("gain"))


@query("SELECT src, post_id, row_number() OVER (ORDER BY md5('g:' || post_id), post_id) AS place FROM (SELECT src, post_id FROM post_pool QUALIFY row_number() OVER (PARTITION BY src ORDER BY md5('f:' || post_id), post_id) <= 100) ORDER BY place LIMIT 150")
def sampling_p09_per_file_then_shuffle(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "post_pool").select("src", "post_id")
    digest = lambda s: F.md5(F.concat(F.lit(s), F.col("post_id").cast("string")))
    per = t.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(digest("f:"), "post_id"))).where("r <= 100")
    top = per.orderBy(digest("g:"), "post_id").limit(150)  # a sample of 150 is ranked
    return top.select("src", "post_id", F.row_number().over(Window.orderBy(digest("g:"), "post_id")).alias("place"))


@query()
def f19_noise_features(spark: SparkSession, d: str) -> DataFrame:
    return noise.features(spark, d)


@query()
def r06_learned_noise(spark: SparkSession, d: str) -> DataFrame:
    """Noise chances of the rows of every subset, from boosted trees fitted on a bounded sample of the other subsets."""
    return noise.left_out_chances(cut(noise.features(spark, d)))


@query()
def l10_predicted_noise(spark: SparkSession, d: str) -> DataFrame:
    """The 15 % of each subset with the highest predicted chance of noise share the label -1."""
    return noise.predicted_noise(r06_learned_noise(spark, d), table(spark, d, "feature_rows"), 0.15)


@query("SELECT request_id, list_concat(list_concat([101], cluster_ids[2:31]), [102]) AS ids FROM (SELECT request_id, list_concat(list_concat([101], cluster_ids[1:126]), [102]) AS cluster_ids FROM cluster_responses) WHERE len(cluster_ids) > 32")
def t14_cut_again(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "cluster_responses").select("request_id", X.encode_ids(F.col("cluster_ids"), 128, 101, 102).alias("ids")).where("size(ids) > 32")
    return t.select("request_id", X.encode_ids(F.slice("ids", 2, 30), 32, 101, 102).alias("ids"))


def _cos_sql(tf: str, out: str) -> str:
    """Clauses of the unit TF-IDF rows ``out`` of the counts ``tf``."""
    return f"{out}_df AS (SELECT term, count(*) AS df FROM {tf}, n GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= 0.95 * n), {out}_w AS (SELECT subset_id, row_no, term, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS v FROM {tf} JOIN {out}_df USING (term), n), {out} AS (SELECT subset_id, row_no, term, v / sqrt(sum(v * v) OVER (PARTITION BY subset_id, row_no)) AS x FROM {out}_w)"


_PAIR_SIM = "{o}_s AS (SELECT nn.subset_id, nn.src, nn.dst, sum(a.x * b.x) AS sim FROM nn JOIN {o} a ON a.subset_id = nn.subset_id AND a.row_no = nn.src JOIN {o} b ON b.subset_id = nn.subset_id AND b.row_no = nn.dst AND a.term = b.term GROUP BY ALL)"


@query(f"""WITH {BENCH_TF_SQL}, n AS (SELECT count(*) AS n FROM bench_rows), c0 AS (SELECT subset_id, row_no, '#' || unnest(list_transform(range(1, length({Q.clean('text')}) - 1), lambda i: substr({Q.clean('text')}, i, 3))) AS term FROM bench_rows WHERE length({Q.clean('text')}) >= 3),
ctf AS (SELECT subset_id, row_no, term, count(*) AS tf FROM c0 GROUP BY ALL), {_cos_sql('tf', 'w')}, {_cos_sql('ctf', 'c')}, {knn_sql('g', 10)}, {_PAIR_SIM.format(o='w')}, {_PAIR_SIM.format(o='c')},
m AS (SELECT subset_id, CASE WHEN median(length(text)) < 120 THEN 0.35 ELSE 0.1 END AS q FROM bench_rows WHERE text IS NOT NULL GROUP BY subset_id)
SELECT nn.subset_id, nn.src, nn.dst, round(q * (1 - nn.dist) + (1 - q) / 2 * (coalesce(w_s.sim, 0) + coalesce(c_s.sim, 0)), 6) AS sim FROM nn JOIN m USING (subset_id)
LEFT JOIN w_s ON w_s.subset_id = nn.subset_id AND w_s.src = nn.src AND w_s.dst = nn.dst LEFT JOIN c_s ON c_s.subset_id = nn.subset_id AND c_s.src = nn.src AND c_s.dst = nn.dst""")
def f15_blended_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each row and its ten dense neighbours: the dense cosine, and those of words and of characters, whose
    shares depend on the median length of the subset."""
    n = table(spark, d, "bench_rows").count()
    nn = cut(K.exact_knn(table(spark, d, "feature_rows"), "row_no", "g", 10, group="subset_id").select("subset_id", "src", "dst", (1 - F.col("dist")).alias("dense")))
    c = X.clean(F.col("text"))
    grams = F.transform(F.sequence(F.lit(1), F.length("c") - 2), lambda i: F.concat(F.lit("#"), F.substring(F.col("c"), i, 3)))
    chars = cut(O.counts(bench(spark, d).select(*BENCH, c.alias("c")).where("length(c) >= 3"), BENCH, grams))
    out = nn
    for name, tf in (("words", cut(bench_tf(spark, d))), ("chars", chars)):
        u = O.tfidf(tf, BENCH, n, min_df=2, max_df=0.95).select(F.col("subset_id").cast("long").alias("subset_id"), F.col("row_no").cast("long").alias("row_no"), F.struct("term", "value").alias("t"))
        rows = cut(u.groupBy("subset_id", "row_no").agg(F.map_from_entries(F.collect_list("t")).alias("m")))
        x, y = (rows.select("subset_id", F.col("row_no").alias(i), F.col("m").alias(f"m_{i}")) for i in ("src", "dst"))
        shared = F.aggregate(F.map_entries("m_src"), F.lit(0.0), lambda a, e: a + e.value * F.coalesce(F.try_element_at("m_dst", e.key), F.lit(0.0)))
        sim = nn.join(x, ["subset_id", "src"]).join(y, ["subset_id", "dst"]).select("subset_id", "src", "dst", shared.alias(name))
        out = out.join(sim, ["subset_id", "src", "dst"], "left")
    q = table(spark, d, "bench_rows").where("text is not null").groupBy(F.col("subset_id").cast("long").alias("subset_id")).agg(F.when(F.median(F.length("text")) < 120, 0.35).otherwise(0.1).alias("q"))
    sim = F.col("q") * F.col("dense") + (1 - F.col("q")) / 2 * (F.coalesce("words", F.lit(0.0)) + F.coalesce("chars", F.lit(0.0)))
    return out.join(q, "subset_id").select("subset_id", "src", "dst", F.round(sim, 6).alias("sim"))


@query()
def c11_codebook(spark: SparkSession, d: str) -> DataFrame:
    from weftline.operators.codecs import codebook

    t = table(spark, d, "feature_rows").where("g is not null").select(F.explode("g").alias("x"))
    return spark.createDataFrame([(i, v) for i, v in enumerate(codebook(t, "x", 16))], "code int, value double")


@query("WITH s AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS w FROM eval_items), p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_filter(a.w, lambda x: NOT list_contains(b.w, x))) + len(list_filter(b.w, lambda x: NOT list_contains(a.w, x))) AS differing FROM s a JOIN s b ON a.item_id <> b.item_id) SELECT a AS item_id, b AS base, differing FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY differing, b) = 1")
def r08_nearest_base(spark: SparkSession, d: str) -> DataFrame:
    """For every item of the fixed table the other one with the smallest symmetric difference of words."""
    s = table(spark, d, "eval_items").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    a, b = (s.select(F.col("item_id").alias(i), F.col("w").alias(f"w{i}")) for i in ("a", "b"))
    p = a.join(F.broadcast(b), F.col("a") != F.col("b")).select("a", F.struct(X.symmetric_difference_size(F.col("wa"), F.col("wb")).alias("n"), F.col("b").alias("b")).alias("x"))
    return p.groupBy(F.col("a").alias("item_id")).agg(F.min("x").alias("x")).select("item_id", F.col("x.b").alias("base"), F.col("x.n").alias("differing"))


__all__ = ["bench_tfidf"]
