"""Token features and weights, in long form: one row per document and term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.session import cut


def counts(df: DataFrame, keys: list[str], terms: Column) -> DataFrame:
    """(keys..., term, tf) from a column with an array of terms."""
    return df.select(*keys, F.explode(terms).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def prune(tf: DataFrame, n_docs: int, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """(keys..., term, tf, df) of terms inside the document-frequency bounds, the most frequent ones if limited."""
    vocab = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    vocab = vocab.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if max_features:
        vocab = vocab.orderBy(F.desc("cf"), "term").limit(max_features)
    return tf.join(vocab.select("term", "df"), "term")


def unit(df: DataFrame, keys: list[str], col: str = "value") -> DataFrame:
    """Scale each document's values to unit length; zero rows stay zero."""
    norm = F.sqrt(F.sum(F.col(col) * F.col(col)).over(Window.partitionBy(*keys)))
    return df.withColumn(col, F.when(norm > 0, F.col(col) / norm).otherwise(F.col(col)))


def tfidf(tf: DataFrame, keys: list[str], n_docs: int, **bounds) -> DataFrame:
    """Sublinear TF-IDF with smoothed document frequencies, unit length."""
    p = prune(tf, n_docs, **bounds)
    value = (1 + F.log("tf")) * (F.log(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1)
    return unit(p.select(*keys, "term", value.alias("value")), keys)


def bm25(tf: DataFrame, keys: list[str], n_docs: int, k1: float = 3.0, b: float = 0.75, **bounds) -> DataFrame:
    """Okapi weights with lengths of the pruned documents."""
    p = prune(tf, n_docs, **bounds)
    dl = p.groupBy(*keys).agg(F.sum("tf").alias("dl"))
    total = dl.agg(F.avg("dl").alias("avgdl"))
    q = p.join(dl, keys).join(F.broadcast(total))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    value = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return q.select(*keys, "term", value.alias("value"))


def hashed(tf: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Feature hashing: log of the count per bucket, unit length."""
    cells = tf.withColumn("bucket", (X.stable_hash(F.col("term")) % buckets).cast("int")).groupBy(*keys, "bucket").agg(F.sum("tf").alias("n"))
    return unit(cells.select(*keys, "bucket", F.log1p("n").alias("value")), keys)


def window_pairs(df: DataFrame, keys: list[str], terms: Column, width: int, by: list[str] | None = None) -> DataFrame:
    """([by...,] a, b, n): symmetric counts of terms that follow each other within ``width`` places, for each of ``by``."""
    by = by or []
    t = df.select(*keys, terms.alias("t")).where("size(t) > 1")
    near = F.flatten(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.transform(F.slice(F.col("t"), i + 1, width), lambda b: F.struct(F.element_at(F.col("t"), i).alias("a"), b.alias("b")))))
    one = t.select(*by, F.inline(near)).groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return one.unionByName(one.select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "n")).groupBy(*by, "a", "b").agg(F.sum("n").alias("n"))


def ppmi(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """([by...,] a, b, value): positive pointwise mutual information of pair counts, for each of ``by``."""
    by = by or []
    row = pairs.groupBy(*by, "a").agg(F.sum("n").alias("r"))
    total = pairs.groupBy(*by).agg(F.sum("n").alias("s"))
    q = pairs.join(row, [*by, "a"]).join(row.select(*by, F.col("a").alias("b"), F.col("r").alias("c")), [*by, "b"])
    q = q.join(total, by) if by else q.join(F.broadcast(total))
    return q.select(*by, "a", "b", F.log(F.col("n") * F.col("s") / (F.col("r") * F.col("c"))).alias("value")).where("value > 0")


def grouped_weights(tf: DataFrame, group: str, id_col: str, kind: str = "tfidf", min_df: int = 2, max_df: float = 0.95, few: int = 50, max_features: int | None = None) -> DataFrame:
    """(group, id, term, value): TF-IDF or Okapi weights with the statistics of each group, rows of unit length.

    Where a group has fewer than ``few`` rows, or none of its terms is frequent enough, its terms need one row only: the
    vocabulary of a group with terms is never empty.  ``max_features`` keeps the most frequent terms of a group.
    """
    tf = cut(tf.select(group, id_col, "term", "tf"))
    n = tf.select(group, id_col).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    vocab = tf.groupBy(group, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).join(n, group)
    vocab = vocab.withColumn("ok", (F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")) & (F.col("n") >= few))
    vocab = vocab.withColumn("some", F.max("ok").over(Window.partitionBy(group))).where("ok or not some")
    if max_features:
        best = Window.partitionBy(group).orderBy(F.desc("cf"), "term")
        vocab = vocab.withColumn("r", F.row_number().over(best)).where(F.col("r") <= max_features)
    p = tf.join(vocab.select(group, "term", "df", "n"), [group, "term"])
    if kind == "tfidf":
        value = (1 + F.log("tf")) * (F.log((1.0 + F.col("n")) / (1 + F.col("df"))) + 1)
    else:
        dl = p.groupBy(group, id_col).agg(F.sum("tf").alias("dl"))
        mean = dl.groupBy(group).agg(F.avg("dl").alias("avgdl"))
        p = p.join(dl, [group, id_col]).join(mean, group)
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        value = idf * F.col("tf") * 4.0 / (F.col("tf") + 3.0 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
    return unit(p.select(group, id_col, "term", value.alias("value")), [group, id_col])


def document_pairs(df: DataFrame, keys: list[str], terms: Column, vocab: DataFrame) -> DataFrame:
    """(a, b, n): documents that hold both of two different terms of a vocabulary, in both orders."""
    t = df.select(*keys, F.explode(F.array_distinct(terms)).alias("term")).join(vocab.select("term"), "term")
    t = t.groupBy(*keys).agg(F.sort_array(F.collect_list("term")).alias("t")).where("size(t) > 1")
    near = F.flatten(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.transform(F.slice(F.col("t"), i + 1, F.size("t")), lambda b: F.struct(F.element_at(F.col("t"), i).alias("a"), b.alias("b")))))
    one = t.select(F.inline(near)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))


def sif(tf: DataFrame, w: float = 0.001) -> DataFrame:
    """(term, weight): smooth inverse frequency of each term."""
    cf = tf.groupBy("term").agg(F.sum("tf").alias("cf"))
    return cf.join(F.broadcast(cf.agg(F.sum("cf").alias("s")))).select("term", (F.lit(w) / (w + F.col("cf") / F.col("s"))).alias("weight"))
