"""Noise features of labelled texts, and a classifier that is always fitted on other subsets than it scores."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import knn as K
from weftline.session import cut, table

KEY = ["subset_id", "row_no"]
FEATURES = [
    "n_chars", "n_words", "upper_share", "mean_idf", "max_idf", "n_topical", "d1", "d5", "d10", "d30", "rank_pct", "near_ratio", "density_ratio",
    "cluster_size", "agreement", "centroid_cos", "subset_size", "subset_words", "subset_d10",
]
#: Rows that a model is fitted on at most, groups of subsets that are left out in turn at most, idf of a topical word.
FIT_ROWS, FOLDS, TOPICAL = 20_000, 6, 4.0


def features(spark: SparkSession, d: str) -> DataFrame:
    """(subset_id, row_no, label, 19 features) of every row with a text; vector features are 0 where there is no vector.

    Lengths; rarity of the words inside the subset; distances to the 1st, 5th, 10th and 30th neighbour, the percent rank
    of the 10th, and its ratios to the 30th and to the subset's mean; size of the predicted cluster, share of the ten
    neighbours in it and cosine to its centre; and the subset's size, mean length and mean distance.
    """
    t = table(spark, d, "bench_rows").where("text is not null").select(*KEY, "label", "text")
    v = table(spark, d, "feature_rows").where("g is not null").select(*KEY, "pred", "g")
    each = Window.partitionBy("subset_id")
    words = t.select(*KEY, F.explode(X.tokens(F.col("text"))).alias("w"))
    n = t.groupBy("subset_id").agg(F.count(F.lit(1)).alias("n"))
    idf = words.distinct().groupBy("subset_id", "w").agg(F.count(F.lit(1)).alias("df")).join(n, "subset_id").select("subset_id", "w", F.log(F.col("n") / F.col("df")).alias("idf"))
    rare = words.join(idf, ["subset_id", "w"]).groupBy(*KEY).agg(F.avg("idf").alias("mean_idf"), F.max("idf").alias("max_idf"), F.count(F.when(F.col("idf") >= TOPICAL, 1)).alias("n_topical"))
    nn = cut(K.exact_knn(v, "row_no", "g", 30, group="subset_id"))
    far = lambda k: F.coalesce(F.max(F.when(F.col("rank") == k, F.col("dist"))), F.max("dist"))
    dist = nn.groupBy("subset_id", F.col("src").alias("row_no")).agg(*[far(k).alias(f"d{k}") for k in (1, 5, 10, 30)])
    own = v.where("pred is not null").select("subset_id", F.col("row_no").alias("src"), "pred")
    other = own.select("subset_id", F.col("src").alias("dst"), F.col("pred").alias("theirs"))
    agree = nn.where("rank <= 10").join(own, ["subset_id", "src"]).join(other, ["subset_id", "dst"]).groupBy("subset_id", F.col("src").alias("row_no")).agg(F.avg((F.col("pred") == F.col("theirs")).cast("double")).alias("agreement"))
    cents = K.centroids(v.where("pred >= 0"), ["subset_id", "pred"], "g").select("subset_id", "pred", F.col("v").alias("c"), F.col("size").alias("cluster_size"))
    centre = v.join(cents, ["subset_id", "pred"]).select(*KEY, "cluster_size", K.dot(K.normalise(F.col("g")), F.col("c")).alias("centroid_cos"))
    one = t.select(*KEY, "label", F.length("text").alias("n_chars"), F.size(F.split("text", " ")).alias("n_words"), (F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("upper_share"))
    all_ = reduce(lambda a, b: a.join(b, KEY, "left"), [rare, dist, agree, centre], one)
    all_ = all_.withColumns({
        "rank_pct": F.percent_rank().over(each.orderBy(F.coalesce("d10", F.lit(0.0)))), "near_ratio": F.col("d10") / F.nullif(F.col("d30"), F.lit(0.0)),
        "density_ratio": F.col("d10") / F.nullif(F.avg("d10").over(each), F.lit(0.0)), "subset_size": F.count(F.lit(1)).over(each), "subset_words": F.avg("n_words").over(each), "subset_d10": F.avg("d10").over(each),
    })
    return all_.select(*KEY, "label", *[F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 6).alias(c) for c in FEATURES])


def left_out_chances(f: DataFrame) -> DataFrame:
    """(subset_id, row_no, noise, chance): every subset is scored by a model that has not seen it.

    Subsets are left out one by one up to ``FOLDS`` of them, in so many groups above; a model is fitted on at most
    ``FIT_ROWS`` labelled rows of the others, chosen by hash.  Without two kinds of rows to fit on, chances are 0.5.
    """
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(f).withColumn("noise", (F.col("label") == -1).cast("int"))
    subsets = data.select("subset_id").distinct()
    fold = subsets.select("subset_id", ((F.row_number().over(Window.orderBy("subset_id")) - 1) % FOLDS).alias("fold"))  # one row a subset
    data = cut(data.join(fold, "subset_id").select(*KEY, "noise", "features", "fold"))
    out = None
    for k in sorted(r.fold for r in data.select("fold").distinct().collect()):
        known = data.where((F.col("fold") != k) & F.col("noise").isNotNull()).orderBy(F.xxhash64(*KEY)).limit(FIT_ROWS)
        held = data.where(F.col("fold") == k)
        if known.select("noise").distinct().count() == 2:
            model = GBTClassifier(labelCol="noise", maxIter=10, maxDepth=3, seed=1).fit(known)
            one = model.transform(held).select(*KEY, "noise", F.round(vector_to_array("probability")[1], 6).alias("chance"))
        else:
            one = held.select(*KEY, "noise", F.lit(0.5).alias("chance"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else data.select(*KEY, "noise", F.lit(0.5).alias("chance"))


def predicted_noise(chances: DataFrame, labels: DataFrame, share: float) -> DataFrame:
    """(subset_id, row_no, label): the ``share`` of each subset with the highest chance gets -1."""
    each = Window.partitionBy("subset_id")
    t = chances.join(labels.select(*KEY, "pred"), KEY)
    r = F.row_number().over(each.orderBy(F.desc("chance"), "row_no"))
    return t.select(*KEY, F.when(r <= F.floor(share * F.count(F.lit(1)).over(each)), -1).otherwise(F.col("pred")).alias("label"))
