"""Whole pipelines: texts or vectors of many subsets in, one cluster label per row out, -1 for none."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import clustering, features, knn, labels, layout, svd
from weftline.session import cut

# Ranks of the decompositions, width of a co-occurrence window, neighbours and share of smoothing.
RANK_TFIDF, RANK_WINDOW, RANK_BLEND, WINDOW, SMOOTH_K, SMOOTH = 128, 128, 192, 10, 16, 0.2
# Weight of characters in the blend, neighbours and dimensions of the spectral part, clusters and share of
# singletons of long texts, clusters of a finer cut, least cosine and sizes of rescue.
CHAR_WEIGHT, GRAPH_K, SPECTRAL_DIM, LONG_K, LONG_SINGLE, FINE_K, RESCUE_COS, RESCUE_SIZES = 0.35, 15, 16, 28, 0.20, 130, 0.77, (5, 40)
# Bounds of the route of short texts.
SHORT_MEDIAN, SHORT_BREAKS, SHORT_LINKS = 130, 0.08, 0.03


def _rows(df: DataFrame, group: str, id_col: str, text_col: str, clean: Callable[[Column], Column]) -> DataFrame:
    return df.select(F.col(group).cast("long").alias(group), F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"), F.coalesce(clean(F.col(text_col)), F.lit("")).alias("clean"))


def _words(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, F.filter(F.split("clean", " "), lambda t: (F.length(t) > 2) & ~t.isin(X.STOP_WORDS)).alias("tok"))


def dense_features(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys..., v): TF-IDF of word uni- and bigrams of each group (the first key) in its leading singular dimensions."""
    group, id_col = keys
    rows = _rows(df, group, id_col, text_col, X.clean).where("clean <> ''")
    tf = features.counts(_words(rows, keys), keys, X.word_ngrams(F.col("tok")))
    return svd.grouped_svd(cut(features.grouped_weights(tf, group, id_col)), group, id_col, RANK_TFIDF)


def _over_texts(df: DataFrame, group: str, id_col: str, text_col: str, label: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Labels of each group's distinct cleaned texts, given back to all its rows; -1 for empty ones."""
    rows = cut(_rows(df, group, id_col, text_col, X.clean).drop("text"))
    distinct = rows.where("clean <> ''").groupBy(group, "clean").agg(F.min(id_col).alias(id_col))
    told = label(cut(distinct.withColumnRenamed("clean", "text")))
    by_text = distinct.join(told, [group, id_col], "left").select(group, "clean", F.coalesce("cluster", F.lit(0)).alias("cluster"))
    return rows.join(by_text, [group, "clean"], "left").select(group, id_col, F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


def root_of_half(n: int) -> int:
    return int(np.clip(np.sqrt(n / 2), 2, 100))


def baseline(df: DataFrame, group: str, id_col: str, text_col: str, k: Callable[[int], int] = root_of_half) -> DataFrame:
    """Each group by itself: clean, drop repeats, TF-IDF, 128 singular dimensions, k-means, labels back to all rows."""
    return _over_texts(df, group, id_col, text_col, lambda t: clustering.grouped_kmeans(dense_features(t, [group, id_col], "text"), group, id_col, "v", k))


def fallback(df: DataFrame, group: str, id_col: str, text_col: str) -> DataFrame:
    """What is left when a pipeline cannot be run: as the baseline, with one cluster for 40 texts, 2 to 60; texts
    without terms are in cluster 0."""
    return baseline(df, group, id_col, text_col, lambda n: int(np.clip(n // 40, 2, 60)))


def large_batch(df: DataFrame, group: str, id_col: str, text_col: str, isolated: float = 0.25) -> DataFrame:
    """The variant for large groups: 2 sqrt(n / 2) clusters, 2 to 400, and singletons."""
    return _over_texts(df, group, id_col, text_col, lambda t: clustering.grouped_kmeans(dense_features(t, [group, id_col], "text"), group, id_col, "v", lambda n: int(np.clip(2 * np.sqrt(n / 2), 2, 400)), isolated))


def leader_vectors(rows: DataFrame, group: str, id_col: str) -> DataFrame:
    """(group, id, v): windowed co-occurrence vectors beside blended word and character weights, each part of unit
    length; ``rows`` are (group, id, text, clean) without blank ones."""
    keys = [group, id_col]
    tok = cut(_words(rows, keys))
    tf = cut(features.counts(tok, keys, F.col("tok")))
    often = tf.groupBy(group, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    total = tf.groupBy(group).agg(F.sum("tf").alias("s"))
    pairs = features.window_pairs(tok, keys, F.col("tok"), WINDOW, by=[group])
    vocab = often.where("df >= 3").select(group, "term")
    for side in ("a", "b"):
        pairs = pairs.join(vocab.withColumnRenamed("term", side), [group, side], "left_semi")
    info = features.ppmi(cut(pairs), by=[group]).select(group, F.col("a").alias("word"), F.col("b").alias("term"), "value")
    words = svd.grouped_svd(cut(info), group, "word", RANK_WINDOW).withColumnRenamed("word", "term")
    smooth_weight = F.col("tf") * 0.001 / (0.001 + F.col("cf") / F.col("s"))
    weights = tf.join(often, [group, "term"]).join(total, group).select(group, id_col, "term", smooth_weight.alias("w"))
    one = svd.grouped_means(weights, cut(words), group, id_col, "w")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("clean") - 2, F.lit(1))), lambda i: F.concat(F.lit("#"), F.substring(F.col("clean"), i, 3)))
    chars = features.grouped_weights(features.counts(rows, keys, grams), group, id_col, "okapi", max_features=8000).withColumn("value", CHAR_WEIGHT * F.col("value"))
    blend = features.grouped_weights(tf, group, id_col, "okapi", max_features=20_000).unionByName(chars)
    two = svd.grouped_svd(cut(blend), group, id_col, RANK_BLEND)
    unit = lambda t, c: t.select(*keys, knn.normalise(F.col("v")).alias(c))
    both = rows.select(*keys).join(unit(one, "one"), keys, "left").join(unit(two, "two"), keys, "left")
    width = both.groupBy(group).agg(F.max(F.size("one")).alias("n1"), F.max(F.size("two")).alias("n2"))
    zeros = lambda n: F.array_repeat(F.lit(0.0), F.greatest(F.coalesce(F.col(n), F.lit(0)), F.lit(0)))
    both = both.join(width, group).select(*keys, F.concat(F.coalesce("one", zeros("n1")), F.coalesce("two", zeros("n2"))).alias("v")).where("size(v) > 0")
    return both.select(*keys, knn.normalise(F.col("v")).alias("v"))


def routes(rows: DataFrame, group: str) -> DataFrame:
    """(group, short): whether the texts of a group are short, without line breaks and links."""
    n = F.length("clean")
    m = rows.groupBy(group).agg(
        F.count(F.when(n >= 40, 1)).alias("many"), F.median(F.when(n > 0, n)).alias("all"), F.median(F.when(n >= 40, n)).alias("longer"),
        F.avg(X.has_newline(F.col("text")).cast("double")).alias("breaks"), F.avg(X.has_url(F.col("text")).cast("double")).alias("links"),
    )
    median = F.when(F.col("many") >= 50, F.col("longer")).otherwise(F.col("all"))
    return m.select(group, F.coalesce((median < SHORT_MEDIAN) & (F.col("breaks") < SHORT_BREAKS) & (F.col("links") < SHORT_LINKS), F.lit(False)).alias("short"))


def _node(group: str, c: str) -> Column:
    return F.col(group) * F.lit(1 << 32) + F.col(c)


def leader(df: DataFrame, group: str, id_col: str, text_col: str) -> DataFrame:
    """The routed pipeline, each group by itself: vectors, smoothing over neighbours, a spectral part for long texts,
    average linkage, and repair of the labels.

    Long texts: 28 clusters, a fifth of singletons (texts of other scripts and medium clusters are spared), rescue of
    small clusters, merging of tiny ones, finer cut of oversized ones.  Short texts: as many clusters as the density of
    the group asks for, and two rounds of reassignment to the nearest centre.  Blank texts are -1; a group of fewer than
    three filled texts is one cluster.
    """
    keys = [group, id_col]
    rows = cut(_rows(df, group, id_col, text_col, X.clean_long))
    filled = cut(rows.where("clean <> ''"))
    few = filled.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    base = cut(leader_vectors(filled.join(few.where("n >= 3"), group, "left_semi"), group, id_col))
    node = base.withColumn("node", _node(group, id_col))
    nn = cut(knn.exact_knn(base, id_col, "v", SMOOTH_K, group=group))
    ids = nn.select(_node(group, "src").alias("src"), _node(group, "dst").alias("dst"))
    v = knn.smooth(node, "node", "v", ids, SMOOTH).select(F.floor(F.col("node") / F.lit(1 << 32)).alias(group), (F.col("node") % F.lit(1 << 32)).alias(id_col), "v")
    short = cut(routes(rows, group))
    v = cut(v.join(short, group))
    links = cut(knn.exact_knn(v, id_col, "v", GRAPH_K, group=group))
    e = knn.symmetric(links.join(short.where("not short"), group, "left_semi").select(_node(group, "src").alias("src"), _node(group, "dst").alias("dst")), loops=True)
    e = e.select(F.floor(F.col("src") / F.lit(1 << 32)).cast("long").alias(group), "src", "dst", F.lit(1.0).alias("w"))
    spec = layout.spectral(e, group, SPECTRAL_DIM).select(group, (F.col("id") % F.lit(1 << 32)).alias(id_col), F.col("v").alias("s"))
    v = cut(v.join(spec, keys, "left").select(*keys, "short", knn.normalise(F.concat("v", F.coalesce("s", F.array().cast("array<double>")))).alias("v")))
    told = clustering.average_linkage(v, group, id_col, "v", LONG_K, resplit=FINE_K)
    told = cut(told.join(v, keys).join(rows.select(*keys, X.script_id(F.col("text")).alias("script")), keys))
    told = cut(labels.merge_scripts(told, group).select(*keys, F.col("merged").alias("cluster"), "v", "short", "script"))
    # short texts move to the nearest centre, twice
    moved = told.where("short")
    for _ in range(2):
        near = knn.nearest_centroid(moved, id_col, "v", knn.centroids(moved, [group, "cluster"], "v"), "cluster", group=group).select(group, F.col("id").alias(id_col), "cluster")
        moved = cut(moved.drop("cluster").join(near, keys).select(*told.columns))
    told = told.where("not short").unionByName(moved)
    far = links.where(F.col("rank") == GRAPH_K).select(group, F.col("src").alias(id_col), "dist")
    spared = labels.protected(told, group, id_col, "v").select(group, "cluster", F.lit(True).alias("spared"))
    told = told.join(far, keys, "left").join(spared, [group, "cluster"], "left")
    free = (F.col("script") == 0) & F.col("spared").isNull() & F.col("dist").isNotNull()
    told = told.withColumn("isolation", F.when(free, F.col("dist")).otherwise(-1.0))
    told = labels.singletons(told, group, id_col, F.col("isolation"), LONG_SINGLE)
    told = cut(told.select(*keys, F.when(F.col("isolation") >= 0, F.col("relabelled")).otherwise(F.col("cluster")).cast("long").alias("cluster"), "v", "short"))
    long = told.where("not short").select(*keys, "cluster", "v")
    vec = long.select(*keys, "v")
    for size in RESCUE_SIZES:
        fixed = cut(labels.rescue(long, id_col, "cluster", "v", size, RESCUE_COS, group=group))
        long = cut(vec.join(fixed, keys).select(*keys, "cluster", "v"))
        if size == RESCUE_SIZES[0]:
            merged = labels.merge_tiny(long, id_col, "cluster", "v", group)
            long = cut(vec.join(merged, keys).select(*keys, F.col("cluster").cast("long").alias("cluster"), "v"))
    out = cut(long.select(*keys, "cluster").unionByName(told.where("short").select(*keys, "cluster")))
    dense = out.select(group, "cluster").distinct()
    dense = dense.select(group, "cluster", labels.dense(dense, group).alias("label"))
    out = out.join(dense, [group, "cluster"]).select(*keys, "label")
    return rows.select(*keys, "clean").join(out, keys, "left").select(*keys, F.when(F.col("clean") == "", -1).otherwise(F.coalesce("label", F.lit(0))).cast("int").alias("cluster"))


def layout_and_density(df: DataFrame, group: str, id_col: str, vec_col: str, k: int = 15, dim: int = 5, epochs: int | None = None, least: int = 25, samples: int = 10) -> DataFrame:
    """Neighbour graph, fuzzy weights, force layout and density clusters of every subset; rows without vector are -1."""
    rows = df.select(F.col(group).cast("long").alias(group), F.col(id_col).cast("long").alias(id_col), vec_col)
    # node ids unique over all subsets
    keyed = rows.where(F.col(vec_col).isNotNull()).withColumn("node", F.col(group) * F.lit(1 << 32) + F.col(id_col))
    nn = cut(knn.exact_knn(keyed, id_col, vec_col, k, group=group))
    node = lambda c: F.col(group) * F.lit(1 << 32) + F.col(c)
    graph = knn.fuzzy_graph(nn.select(node("src").alias("src"), node("dst").alias("dst"), "dist"), k)
    graph = graph.select(F.floor(F.col("src") / F.lit(1 << 32)).cast("long").alias(group), "src", "dst", "w")
    y = layout.umap(graph, group, dim, epochs)

    def label(pdf):  # noqa: ANN001, ANN202
        pdf = pdf.sort_values("id")
        pdf["cluster"] = clustering.density_labels(np.stack(pdf.v.to_list()), least, samples).astype(np.int32)
        return pdf[[group, "id", "cluster"]]

    told = y.groupBy(group).applyInPandas(label, f"{group} long, id long, cluster int").select(group, (F.col("id") % F.lit(1 << 32)).alias(id_col), "cluster")
    return rows.select(group, id_col).join(told, [group, id_col], "left").select(group, id_col, F.coalesce("cluster", F.lit(-1)).alias("cluster"))
