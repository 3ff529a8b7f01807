"""Queries on texts: sources, normalisers, counts and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import features as O
from weftline.plans import sqltext as Q
from weftline.plans.registry import query
from weftline.session import spread, table

BENCH = ["subset_id", "row_no"]


def bench(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "bench_rows").select(*BENCH, "text"))


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


TOK_SQL = f"list_filter(string_split({Q.clean('text')}, ' '), lambda x: length(x) > 2 AND x NOT IN ({', '.join(repr(w) for w in X.STOP_WORDS)}))"
BENCH_TF_SQL = f"t AS (SELECT subset_id, row_no, unnest({TOK_SQL}) AS term FROM bench_rows), tf AS (SELECT subset_id, row_no, term, count(*) AS tf FROM t GROUP BY ALL)"


def bench_tokens(spark: SparkSession, d: str) -> DataFrame:
    tok = F.filter(F.split(X.clean(F.col("text")), " "), lambda t: (F.length(t) > 2) & ~t.isin(X.STOP_WORDS))
    return bench(spark, d).select(*BENCH, tok.alias("tok"))


def bench_tf(spark: SparkSession, d: str) -> DataFrame:
    return O.counts(bench_tokens(spark, d), BENCH, F.col("tok"))


@query("SELECT post_id, text, label FROM post_pool WHERE trim(text) <> ''")
def s02_projected_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "post_pool").select("post_id", "text", "label").where(F.trim("text") != "")


@query("SELECT 'reddit' AS pool, post_id AS id, text FROM post_pool WHERE src = 'reddit' UNION ALL SELECT 'fresh' AS pool, fetch_id AS id, text FROM fresh_posts")
def s03_union_of_pools(spark: SparkSession, d: str) -> DataFrame:
    from weftline.sources.files import tagged_scan

    posts = tagged_scan(spark, [f"{d}/post_pool.parquet"], {"post_pool": "reddit"}, "pool").where("src = 'reddit'").select("pool", F.col("post_id").alias("id"), "text")
    fresh = tagged_scan(spark, [f"{d}/fresh_posts.parquet"], {"fresh": "fresh"}, "pool").select("pool", F.col("fetch_id").alias("id"), "text")
    return posts.unionByName(fresh)


@query("SELECT fetch_id, coalesce(text, keyword) AS body, nullif(nullif(datetime, 'None'), '') AS posted FROM fresh_posts WHERE trim(coalesce(text, keyword)) <> ''")
def s07_tolerant_fields(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "fresh_posts")
    return t.select("fetch_id", F.coalesce("text", "keyword").alias("body"), F.nullif(F.nullif("datetime", F.lit("None")), F.lit("")).alias("posted")).where(F.trim("body") != "")


@query("SELECT doc_id, substr(text, 1, 280) AS head FROM documents")
def s10_truncated(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.substring("text", 1, 280).alias("head"))


@query("SELECT paper_id, cat FROM paper_pool WHERE cat NOT IN (SELECT cat FROM paper_pool WHERE cat IS NOT NULL GROUP BY cat HAVING count(*) >= 20)")
def s13_resume_append(spark: SparkSession, d: str) -> DataFrame:
    """What a resumed fetch still has to get: papers of categories that are not complete, at 20 papers, yet."""
    t = table(spark, d, "paper_pool").where("cat is not null").select("paper_id", "cat")
    done = t.groupBy("cat").agg(F.count(F.lit(1)).alias("n")).where("n >= 20").select("cat")
    return t.join(done, "cat", "left_anti").select("paper_id", "cat")


@query("SELECT event_id, regexp_extract(props, '\"k\": ([0-9]+)', 1) AS literal FROM events")
def s17_literal_from_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.regexp_extract("props", r'"k": ([0-9]+)', 1).alias("literal"))


@query(f"SELECT subset_id, row_no, {Q.clean('text')} AS clean FROM bench_rows")
def t01_clean(spark: SparkSession, d: str) -> DataFrame:
    return bench(spark, d).select(*BENCH, X.clean(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, {Q.clean('text', ' ')} AS clean FROM documents")
def t02_clean_long(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", X.clean_long(F.col("text")).alias("clean"))


@query()
def t03_clean_short(spark: SparkSession, d: str) -> DataFrame:
    return bench(spark, d).select(*BENCH, X.clean_short(F.col("text")).alias("clean"))


@query(f"SELECT subset_id, row_no, {Q.squeeze(Q.rep(Q.rep(Q.rep(Q.rep('text', Q.URL_STRICT, ' '), '(?i)^rt' + chr(92) + 's+', ' '), Q.MENTION, ' '), Q.HASHTAG, chr(92) + '1'))} AS clean FROM bench_rows")
def t03_clean_short_safe(spark: SparkSession, d: str) -> DataFrame:
    return bench(spark, d).select(*BENCH, X.clean_short_safe(F.col("text")).alias("clean"))


@query(rf"SELECT doc_id, substr({Q.squeeze(Q.rep(Q.rep('lower(' + Q.rep(Q.rep('text', Q.URL_STRICT, ' '), Q.MENTION, ' ') + ')', '&[' + chr(92) + 'pL' + chr(92) + 'pN_]+;', ' '), '[^' + chr(92) + 'pL' + chr(92) + 'pN_' + chr(92) + 's一-鿿]', ' '))}, 1, 1000) AS clean FROM documents")
def t04_clean_projection(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", X.clean_projection(F.col("text")).alias("clean"))


@query(f"SELECT post_id, length({Q.squeeze(Q.rep(Q.rep(Q.rep(Q.rep('lower(text)', Q.URL_STRICT, ' '), Q.MENTION, ' '), Q.HASHTAG, chr(92) + '1'), Q.NON_WORD, ' '))}) = 0 AS empty FROM post_pool")
def t05_empty_after_clean(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "post_pool").select("post_id", "text")).select("post_id", X.is_empty_after_clean(F.col("text")).alias("empty"))


@query(r"SELECT subset_id, row_no, list_filter(list_transform(regexp_extract_all(text, '(\pL[\pL\pN_''-]*)', 1), lambda x: lower(x)), lambda x: length(x) > 2 AND x NOT IN (" + ", ".join(repr(w) for w in X.STOP_WORDS) + ")) AS tokens FROM bench_rows")
def t06_tokens(spark: SparkSession, d: str) -> DataFrame:
    return bench(spark, d).select(*BENCH, X.tokens(F.col("text")).alias("tokens"))


_SCRIPTS = {1: r"\x{0400}-\x{052F}", 2: r"\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}", 3: r"\x{0600}-\x{06FF}", 4: r"\x{0590}-\x{05FF}", 5: r"\x{0E00}-\x{0E7F}", 6: r"\x{0900}-\x{097F}"}
SCRIPT_COUNTS_SQL = ", ".join(f"length(regexp_replace(text, '[^{r}]', '', 'g')) AS c{i}" for i, r in _SCRIPTS.items())
SCRIPT_SQL = "CASE WHEN top > 0 AND top * 8 >= greatest(length(text), 1) THEN CASE " + " ".join(f"WHEN c{i} = top THEN {i}" for i in range(1, 7)) + " END ELSE 0 END"


@query(f"WITH c AS (SELECT doc_id, text, {SCRIPT_COUNTS_SQL} FROM documents), g AS (SELECT *, greatest(c1, c2, c3, c4, c5, c6) AS top FROM c) SELECT doc_id, {SCRIPT_SQL} AS script FROM g")
def t07_script(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", X.script_id(F.col("text")).alias("script"))


@query(r"SELECT doc_id, contains(text, chr(10)) AS newline, regexp_matches(lower(text), 'http|www\.') AS url FROM documents")
def t08_presence_flags(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", X.has_newline(F.col("text")).alias("newline"), X.has_url(F.col("text")).alias("url"))


@query(r"SELECT doc_id, regexp_matches(text, '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]') AS cjk, regexp_matches(text, '[\pP$+<=>^`|~]') AS punctuation FROM documents")
def t10_character_tests(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", X.has_cjk(F.col("text")).alias("cjk"), X.has_punctuation(F.col("text")).alias("punctuation"))


@query(r"SELECT subset_id, row_no, list_filter(regexp_split_to_array(regexp_replace(text, '([\pP$+<=>^`|~])', ' \1 ', 'g'), '\s+'), lambda x: x <> '') AS tokens FROM bench_rows")
def t11_pre_tokens(spark: SparkSession, d: str) -> DataFrame:
    return bench(spark, d).select(*BENCH, X.pre_tokens(F.col("text")).alias("tokens"))


@query()
def t09_t12_wordpiece(spark: SparkSession, d: str) -> DataFrame:
    from weftline.functions.wordpiece import encode

    return encode(bench(spark, d), BENCH, "text", table(spark, d, "vocab_pieces"), most=128)


@query("SELECT request_id, list_concat(list_concat([101], cluster_ids[1:126]), [102]) AS ids FROM cluster_responses")
def t13_framed_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cluster_responses").select("request_id", X.encode_ids(F.col("cluster_ids"), 128, 101, 102).alias("ids"))


@query(r"SELECT post_id, regexp_replace(text, '\s*\n\s*', ' ', 'g') AS flat FROM post_pool WHERE NOT regexp_matches(lower(text), 'http|www\.')")
def t15_flat_without_links(spark: SparkSession, d: str) -> DataFrame:
    t = spread(table(spark, d, "post_pool").select("post_id", "text"))
    return t.where(~X.has_url(F.col("text"))).select("post_id", X.flatten_newlines(F.col("text")).alias("flat"))


@query(rf"SELECT paper_id, {Q.squeeze('title')} AS title, split_part(paper_id, '/', -1) AS id, split_part(primary_cat, '.', 1) AS archive FROM paper_pool")
def t16_paper_fields(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "paper_pool")
    return t.select("paper_id", X.squeeze(F.col("title")).alias("title"), X.last_path_part(F.col("paper_id")).alias("id"), X.archive_of(F.col("primary_cat")).alias("archive"))


@query(f"SELECT post_id, CASE WHEN length({Q.clean('text')}) = 0 THEN 'x' ELSE {Q.clean('text')} END AS clean FROM post_pool")
def t17_placeholder(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "post_pool").select("post_id", "text")).select("post_id", X.placeholder(X.clean(F.col("text"))).alias("clean"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[;\n]'), lambda x: trim(x)), lambda x: x <> '') AS a, list_filter(list_transform(regexp_split_to_array(lower(text), '[;\n]'), lambda x: trim(x)), lambda x: x <> '') AS b FROM documents)
SELECT doc_id, len(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))) + len(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x)))) AS differing FROM s""")
def t18_statement_difference(spark: SparkSession, d: str) -> DataFrame:
    t = docs(spark, d)
    return t.select("doc_id", X.symmetric_difference_size(X.statements(F.col("text")), X.statements(F.lower("text"))).alias("differing"))


@query(r"SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '[\pL\pN_]+')) AS words FROM documents")
def t19_lengths(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.length("text").alias("chars"), F.size(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]+)"), 1)).alias("words"))


@query("SELECT r_regionkey, unnest(list_concat([r_regionkey], range(r_regionkey + 3, r_regionkey + 6))) AS number FROM region")
def t20_number_ranges(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region")
    spec = F.concat_ws(",", F.col("r_regionkey").cast("string"), F.concat_ws("-", (F.col("r_regionkey") + 3).cast("string"), (F.col("r_regionkey") + 5).cast("string")))
    return r.select("r_regionkey", F.explode(X.number_ranges(spec)).alias("number"))


@query(f"WITH t AS (SELECT subset_id, row_no, {TOK_SQL} AS k FROM bench_rows), g AS (SELECT subset_id, row_no, unnest(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))) AS term FROM t) SELECT subset_id, row_no, term, count(*) AS tf FROM g GROUP BY ALL")
def f01_word_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return O.counts(bench_tokens(spark, d), BENCH, X.word_ngrams(F.col("tok")))


@query(f"""WITH w AS (SELECT subset_id, row_no, ' ' || unnest(string_split({Q.clean('text')}, ' ')) || ' ' AS w FROM bench_rows),
g AS (SELECT subset_id, row_no, w, unnest(range(3, least(5, greatest(3, length(w))) + 1)) AS n FROM w WHERE w <> '  '),
h AS (SELECT subset_id, row_no, substr(w, unnest(range(1, greatest(length(w) - n + 1, 1) + 1)), n) AS gram FROM g)
SELECT gram, count(*) AS n, count(DISTINCT subset_id * 1000000 + row_no) AS df FROM h GROUP BY gram""")
def f02_char_wb(spark: SparkSession, d: str) -> DataFrame:
    tf = O.counts(bench(spark, d), BENCH, X.char_wb(X.clean(F.col("text"))))
    return tf.groupBy(F.col("term").alias("gram")).agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df"))


@query(f"WITH {BENCH_TF_SQL}, n AS (SELECT count(*) AS n FROM bench_rows) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf, n GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= 0.95 * n ORDER BY cf DESC, term LIMIT 2000")
def f03_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "bench_rows").count()
    v = bench_tf(spark, d).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    return v.where((F.col("df") >= 2) & (F.col("df") <= 0.95 * n)).orderBy(F.desc("cf"), "term").limit(2000)


_TFIDF = f"{BENCH_TF_SQL}, n AS (SELECT count(*) AS n FROM bench_rows), df AS (SELECT term, count(*) AS df FROM tf, n GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= 0.95 * n), w AS (SELECT subset_id, row_no, term, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS v FROM tf JOIN df USING (term), n), u AS (SELECT subset_id, row_no, term, v / sqrt(sum(v * v) OVER (PARTITION BY subset_id, row_no)) AS value FROM w)"


def bench_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return O.tfidf(bench_tf(spark, d), BENCH, table(spark, d, "bench_rows").count(), min_df=2, max_df=0.95)


@query(f"WITH {_TFIDF} SELECT subset_id, row_no, term, round(value, 6) AS value FROM u")
def f04_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return bench_tfidf(spark, d).withColumn("value", F.round("value", 6))


@query(f"WITH {_TFIDF}, r AS (SELECT *, row_number() OVER (PARTITION BY subset_id, row_no ORDER BY round(value, 6) DESC, term) AS place FROM u) SELECT subset_id, row_no, term, place FROM r WHERE place <= 5")
def f04_tfidf_top_terms(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*BENCH).orderBy(F.desc(F.round("value", 6)), "term")
    return bench_tfidf(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 5").select(*BENCH, "term", "place")


@query(f"""WITH {BENCH_TF_SQL}, n AS (SELECT count(*) AS n FROM bench_rows), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2),
p AS (SELECT * FROM tf JOIN df USING (term)), dl AS (SELECT subset_id, row_no, sum(tf) AS dl FROM p GROUP BY ALL), a AS (SELECT avg(dl) AS avgdl FROM dl)
SELECT subset_id, row_no, term, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 4 / (tf + 3 * (1 - 0.75 + 0.75 * dl / avgdl)), 6) AS value FROM p JOIN dl USING (subset_id, row_no), a, n""")
def f06_bm25(spark: SparkSession, d: str) -> DataFrame:
    return O.bm25(bench_tf(spark, d), BENCH, table(spark, d, "bench_rows").count(), min_df=2).withColumn("value", F.round("value", 6))


_PPMI = "r AS (SELECT a, sum(n) AS r FROM p GROUP BY a), s AS (SELECT sum(n) AS s FROM p) SELECT p.a, p.b, round(ln(p.n * s / (r.r * c.r)), 6) AS value FROM p JOIN r ON p.a = r.a JOIN r AS c ON p.b = c.a, s WHERE ln(p.n * s / (r.r * c.r)) > 0"


@query(f"""WITH t AS (SELECT row_number() OVER () AS id, {TOK_SQL} AS k FROM bench_rows), e AS (SELECT id, unnest(k) AS w, unnest(range(1, len(k) + 1)) AS pos FROM t),
o AS (SELECT x.w AS a, y.w AS b FROM e x JOIN e y ON x.id = y.id AND y.pos BETWEEN x.pos + 1 AND x.pos + 10),
p AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM o UNION ALL SELECT b, a FROM o) GROUP BY ALL), {_PPMI}""")
def f08_window_ppmi(spark: SparkSession, d: str) -> DataFrame:
    return O.ppmi(O.window_pairs(bench_tokens(spark, d), BENCH, F.col("tok"), 10)).withColumn("value", F.round("value", 6))


@query(f"""WITH {BENCH_TF_SQL}, v AS (SELECT term FROM tf GROUP BY term HAVING count(*) >= 3 ORDER BY count(*) DESC, term LIMIT 6000), k AS (SELECT * FROM tf JOIN v USING (term)),
p AS (SELECT x.term AS a, y.term AS b, count(*) AS n FROM k x JOIN k y ON x.subset_id = y.subset_id AND x.row_no = y.row_no AND x.term <> y.term GROUP BY ALL), {_PPMI}""")
def f09_document_ppmi(spark: SparkSession, d: str) -> DataFrame:
    tok = bench_tokens(spark, d)
    vocab = O.counts(tok, BENCH, F.col("tok")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df >= 3").orderBy(F.desc("df"), "term").limit(6000)
    return O.ppmi(O.document_pairs(tok, BENCH, F.col("tok"), vocab)).withColumn("value", F.round("value", 6))


@query(f"WITH {BENCH_TF_SQL}, c AS (SELECT term, sum(tf) AS cf FROM tf GROUP BY term), s AS (SELECT sum(cf) AS s FROM c) SELECT term, round(0.001 / (0.001 + cf / s), 6) AS weight FROM c, s")
def f10_sif(spark: SparkSession, d: str) -> DataFrame:
    return O.sif(bench_tf(spark, d)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {BENCH_TF_SQL}, b AS (SELECT subset_id, row_no, {Q.stable_hash('term')} % 8192 AS bucket, ln(1 + sum(tf)) AS v FROM tf GROUP BY ALL) SELECT subset_id, row_no, CAST(bucket AS INT) AS bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY subset_id, row_no)), 6) AS value FROM b")
def f13_hashed(spark: SparkSession, d: str) -> DataFrame:
    return O.hashed(bench_tf(spark, d), BENCH, 8192).withColumn("value", F.round("value", 6))


@query(f"""WITH {BENCH_TF_SQL}, b AS (SELECT subset_id, row_no, CAST({Q.stable_hash('term')} % 512 AS INT) AS bucket, ln(1 + sum(tf)) AS v FROM tf GROUP BY ALL),
u AS (SELECT subset_id, row_no, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY subset_id, row_no)) AS x FROM b),
w AS (SELECT b.bucket, j.j, {Q.stable_hash("'w:' || b.bucket || ':' || j.j")} / 4294967296.0 - 0.5 AS w FROM range(512) b(bucket), range(8) j(j))
SELECT subset_id, row_no, CAST(j AS INT) AS dim, round(sum(x * w), 5) AS value FROM u JOIN w USING (bucket) GROUP BY subset_id, row_no, j""")
def f14_hashed_projection(spark: SparkSession, d: str) -> DataFrame:
    w = spark.range(512).select(F.col("id").cast("int").alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("dim"))
    w = w.withColumn("w", X.stable_hash(F.concat(F.lit("w:"), F.col("bucket").cast("string"), F.lit(":"), F.col("dim").cast("string"))) / 4294967296.0 - 0.5)
    u = O.hashed(bench_tf(spark, d), BENCH, 512)
    return u.join(F.broadcast(w), "bucket").groupBy(*BENCH, "dim").agg(F.round(F.sum(F.col("value") * F.col("w")), 5).alias("value"))


@query(f"""WITH r AS (SELECT subset_id, row_no, label, {TOK_SQL} AS k, row_number() OVER (PARTITION BY subset_id, label ORDER BY row_no) AS rn FROM bench_rows WHERE label >= 0),
t AS (SELECT subset_id, label, unnest(k) AS term FROM r WHERE rn <= 80), tf AS (SELECT subset_id, label, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT count(DISTINCT subset_id * 100000 + label) AS n FROM tf), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT subset_id, label, term, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS v FROM tf JOIN df USING (term), n)
SELECT subset_id, label, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY subset_id, label)), 6) AS value FROM w""")
def f18_cluster_documents(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    keys = ["subset_id", "label"]
    w = Window.partitionBy(*keys).orderBy("row_no")
    rows = table(spark, d, "bench_rows").where("label >= 0").withColumn("rn", F.row_number().over(w)).where("rn <= 80").select(*BENCH, "label")
    tf = O.counts(bench_tokens(spark, d).join(rows, BENCH), keys, F.col("tok"))
    n = tf.select(*keys).distinct().count()
    return O.tfidf(tf, keys, n).withColumn("value", F.round("value", 6))


@query(f"WITH {BENCH_TF_SQL}, n AS (SELECT count(*) AS n FROM bench_rows), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term) SELECT subset_id, row_no, count(*) FILTER (df >= 5 AND df <= 0.05 * n) AS anchors, round(avg(ln(n / (1.0 + df))), 6) AS mean_idf, round(max(ln(n / (1.0 + df))), 6) AS max_idf FROM tf JOIN df USING (term), n GROUP BY subset_id, row_no")
def f19_f20_idf_features(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "bench_rows").count()
    p = O.prune(bench_tf(spark, d), n)
    idf = F.log(F.lit(float(n)) / (1 + F.col("df")))
    return p.groupBy(*BENCH).agg(
        F.count(F.when((F.col("df") >= 5) & (F.col("df") <= 0.05 * n), 1)).alias("anchors"), F.round(F.avg(idf), 6).alias("mean_idf"), F.round(F.max(idf), 6).alias("max_idf")
    )
