"""Queries of the problems of this subpackage, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import distinctive, languages, leaks, markov, nearcopies, neighbours, packing, subjects, visible
from weftline.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    g = markov.group_texts(markov.request_texts(table(spark, d, "cluster_requests"))).select("request_id", "pos", "cluster")
    x, y = (g.withColumnRenamed("pos", n) for n in ("pos_a", "pos_b"))
    return x.join(y, ["request_id", "cluster"]).where("pos_a < pos_b").select("request_id", "pos_a", "pos_b")


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    texts = markov.request_texts(table(spark, d, "cluster_requests"))
    return markov.describe(markov.group_texts(texts), texts)


def p1_responses(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "cluster_requests")
    return markov.responses(markov.group_texts(markov.request_texts(requests)), requests)


def p1_bench(spark: SparkSession, d: str) -> DataFrame:
    """Groups found in the labelled subsets, beside their labels."""
    rows = table(spark, d, "bench_rows").select(F.col("subset_id").cast("long").alias("request_id"), F.col("row_no").alias("pos"), "text", "label")
    g = markov.group_texts(rows)
    found = rows.select("request_id", "pos", "label").join(g.select("request_id", "pos", "cluster"), ["request_id", "pos"], "left")
    return found.select(F.col("request_id").alias("subset_id"), F.col("pos").alias("row_no"), "label", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "post_pool").select("post_id", "text")
    return visible.look_alike_pairs(posts, "post_id", "text", "post_a", "post_b")


def p2_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", visible.consistent_form(F.col("text")).alias("text"))


def p2_eval_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").select("item_id", "text")
    return items.select("item_id", visible.consistent_form(F.col("text")).alias("text"))


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.distinctive_terms(table(spark, d, "bench_rows").select("subset_id", "row_no", "text"), ["subset_id", "row_no"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    scored = p3_scores(spark, d).where("score > background")
    return scored.where("tf >= 2 and df between 2 and 10").select("subset_id", "row_no", "term")


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "feature_rows").select("vec_id", "subset_id", "g", "proj_bd")
    return neighbours.nearest(rows, "vec_id", "subset_id", ["g", "proj_bd"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(p4_neighbours(spark, d), "vec_a", "vec_b")


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    s = languages.language_segments(table(spark, d, "documents"))
    return s.select("doc_id", F.posexplode("segments").alias("segment_no", "s")).select("doc_id", "segment_no", "s.*")


def p5_documents(spark: SparkSession, d: str) -> DataFrame:
    s = languages.language_shares(languages.language_segments(table(spark, d, "documents")))
    top = F.get("langs", F.lit(0))
    return s.select("doc_id", "label", top.lang.alias("lang"), top.share.alias("share"), top.confidence.alias("confidence"), F.size("langs").alias("n_langs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.wrong_languages(languages.language_shares(languages.language_segments(table(spark, d, "documents"))))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    member, links = nearcopies.similar_sets(docs, "doc_id", "text", shingle=3, num=1, den=2, min_words=25, miss=0.0051)
    return nearcopies.similar_pairs(member, links, "doc_a", "doc_b")


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.similar_groups(table(spark, d, "documents"), "doc_id", "text")


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return packing.pack_budgets(docs, table(spark, d, "pack_budgets"))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_passages(spark, d).select("doc_id", "item_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    model = subjects.fit_subjects(docs, table(spark, d, "subject_labels"), table(spark, d, "subjects"))
    return subjects.accepted(subjects.subject_shares(docs, model))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_shares(spark, d).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents by subject over the whole corpus."""
    return p9_found(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_clusters, p1_responses, p1_bench, p2_found, p2_documents, p2_eval_items, p3_found, p3_scores, p4_found, p4_neighbours, p5_found, p5_segments, p5_documents, p6_found, p6_groups, p7_pack, p8_found, p8_passages, p9_found, p9_shares, p9_composition)}

#: The visible text in SQL, as far as the tables' characters need it: full-width forms, blanks, what shows nothing, and
#: lower-case letters of other scripts drawn like Latin ones.
_WIDE = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | dict.fromkeys(["\u00a0", "\u1680", "\u202f", "\u205f", "\u3000", *map(chr, range(0x2000, 0x200B))], " ")
_ALIKE = {v: k for t in (visible.LOOKALIKE_CYRILLIC, visible.LOOKALIKE_GREEK) for k, v in t.items() if k.islower()}
_HIDDEN = "\u200b\u200c\u200d\u2060\ufeff\u00ad\u034f\u200e\u200f"


def _translate(x: str, by: dict[str, str], gone: str = "") -> str:
    old, new = ("".join(part).replace("'", "''") for part in (by, by.values()))
    return f"translate({x}, '{old}{gone}', '{new}')"


def words_sql(text: str) -> str:
    """The list of words of the visible text."""
    shown = f"nfc_normalize({_translate('lower(' + _translate(text, _WIDE, _HIDDEN) + ')', _ALIKE)})"
    return rf"regexp_extract_all({shown}, '[\pL\p{{Nd}}]+')"


def _runs_sql(table_: str, key: str, n: int, least: int) -> str:
    run = ", ".join(f"w[i + {k}]" for k in range(n))
    return f"SELECT DISTINCT {key}, list_value({run}) AS run FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT {key}, {words_sql('text')} AS w FROM {table_}) WHERE len(w) >= {least})"


_NEAR_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS field_name, a.subset_id, a.vec_id AS x, b.vec_id AS y, round(list_dot_product(a.u, b.u), 6) AS sim FROM {c}_u a JOIN {c}_u b ON a.subset_id = b.subset_id AND a.vec_id <> b.vec_id""" for c in ("g", "proj_bd")
)
_UNITS_SQL = ", ".join(
    f"""{c}_v AS (SELECT vec_id, subset_id, CAST({c} AS DOUBLE[]) AS v FROM feature_rows WHERE {c} IS NOT NULL), {c}_u AS (SELECT vec_id, subset_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM {c}_v WHERE list_dot_product(v, v) > 0)""" for c in ("g", "proj_bd")
)

ORACLES: dict[str, str] = {
    "p3_found": r"""
        WITH t AS (SELECT subset_id, row_no, unnest(regexp_extract_all(lower(text), '\p{L}{3,}')) AS term FROM bench_rows),
        tf AS (SELECT subset_id, row_no, term, count(*) AS tf FROM t GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
        SELECT subset_id, row_no, term FROM tf JOIN df USING (term) WHERE tf >= 2 AND df BETWEEN 2 AND 10
    """,
    "p4_found": f"""
        WITH {_UNITS_SQL}, p AS ({_NEAR_SQL}), n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY field_name, x ORDER BY sim DESC, y) <= 10)
        SELECT DISTINCT field_name, least(x, y) AS vec_a, greatest(x, y) AS vec_b FROM n
    """,
    "p6_found": f"""
        WITH s AS ({_runs_sql('documents', 'doc_id', 3, 25)}), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        b AS (SELECT x.doc_id AS doc_a, y.doc_id AS doc_b, count(*) AS k FROM s x JOIN s y ON x.run = y.run AND x.doc_id < y.doc_id GROUP BY ALL)
        SELECT doc_a, doc_b FROM b JOIN n p ON p.doc_id = doc_a JOIN n q ON q.doc_id = doc_b WHERE 2 * k >= p.n + q.n - k
    """,
    "p8_found": f"""
        WITH d AS ({_runs_sql('documents', 'doc_id', 13, 13)}), e AS ({_runs_sql('eval_items', 'item_id', 13, 13)})
        SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (run)
    """,
}
