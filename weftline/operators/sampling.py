"""Seeded samples that are the same on any cluster: choices depend on a digest of seed and key only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import stable_hash, stable_uniform


def uniform(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def by_quota(df: DataFrame, key: str, label: str, quotas: DataFrame, seed: int = 0) -> DataFrame:
    """The quota's number of rows of each label; ``quotas`` is (label, quota)."""
    w = Window.partitionBy(label).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    return df.join(quotas, label).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= F.col("quota")).drop("__r", "quota")


def weighted(df: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement with chances by weight: the smallest -ln(u) / w."""
    u = stable_uniform(F.col(key), seed) + 1.0 / (1 << 33)
    return df.where(F.col(weight) > 0).withColumn("__k", F.round(-F.log(u) / F.col(weight), 9)).orderBy("__k", key).limit(n).drop("__k")


def permutation(df: DataFrame, key: str, group: str, seed: int = 0) -> DataFrame:
    """Adds ``place``: the row's place in a seeded order of its group."""
    w = Window.partitionBy(group).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    return df.withColumn("place", F.row_number().over(w))


def bootstrap(df: DataFrame, value: str, replicates: int, seed: int = 0, draws: int | None = None) -> DataFrame:
    """(replicate, mean): means of resamples with replacement, of ``draws`` or else as many values as there are.  ``df`` is a table of scores, at most 100,000 rows."""
    vals = df.select(F.col(value).cast("double").alias("v")).where("v is not null").agg(F.array_sort(F.collect_list("v")).alias("v"), F.count(F.lit(1)).alias("n"))
    n = vals.select("n").first()[0]
    if n > 100_000:
        raise ValueError(f"{n} scores; at most 100000 are resampled")
    r = df.sparkSession.range(replicates).withColumnRenamed("id", "replicate")
    draw = lambda i: F.element_at("v", (stable_hash(F.concat(F.lit(f"{seed}:"), F.col("replicate").cast("string"), F.lit(":"), i.cast("string"))) % F.col("n") + 1).cast("int"))
    size = F.lit(draws) if draws else F.col("n")
    return r.join(F.broadcast(vals)).where("n > 0").select("replicate", (F.aggregate(F.transform(F.sequence(F.lit(1), size.cast("int")), draw), F.lit(0.0), lambda s, x: s + x) / size).alias("mean"))


def length_batches(df: DataFrame, key: str, length: str, budget: int, salts: int = 64, most_lengths: int = 1_000_000) -> DataFrame:
    """(key, length, batch): rows in ascending order of length, greedily put into batches whose number of rows times
    longest row is at most ``budget``; a longer row is a batch of its own.

    The cuts are made on the histogram of lengths, checked to have at most ``most_lengths`` bars.  Ranks inside a length
    are counted by (length, salt), so a length that many rows share is in no single task.
    """
    spark = df.sparkSession
    rows = df.select(key, F.col(length).cast("int").alias("n")).where("n > 0").withColumn("__salt", (stable_hash(F.col(key).cast("string")) % salts).cast("int"))
    cells = rows.groupBy("n", "__salt").agg(F.count(F.lit(1)).alias("c"))
    bars = cells.groupBy("n").agg(F.sum("c").alias("c"))
    kinds = bars.count()
    if kinds > most_lengths:
        raise ValueError(f"{kinds} lengths; at most {most_lengths} are batched")
    spans, batch, held = [], -1, 0  # (length, first rank, rows a batch, first batch, room in the first batch)
    for n, c in sorted((r.n, r.c) for r in bars.collect()):
        room = max(budget // n, 1)
        left = max(room - held, 0) if batch >= 0 else 0
        take = min(left, c)
        if take:
            spans.append((n, 0, take, batch, take))
            held += take
        if c > take:
            spans.append((n, take, c, batch + 1, room))
            full, rest = divmod(c - take, room)
            batch, held = batch + full + (rest > 0), rest or room
    before = Window.partitionBy("n").orderBy("__salt")
    base = cells.select("n", "__salt", (F.sum("c").over(before) - F.col("c")).alias("base"))
    rank = Window.partitionBy("n", "__salt").orderBy(key)
    ranked = rows.withColumn("r", F.row_number().over(rank) - 1).join(base, ["n", "__salt"]).select(key, "n", (F.col("r") + F.col("base")).alias("rank"))
    cuts = spark.createDataFrame(spans, "n int, lo long, hi long, first long, room long")  # two spans of a length at most
    placed = ranked.join(cuts, "n").where("rank >= lo and rank < hi")
    return placed.select(key, F.col("n").alias(length), (F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("room"))).cast("long").alias("batch"))


#: Labels whose quotas are drawn on the driver, at most.
MOST_LABELS = 100_000


def _digest(seed: int, what: str, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:{what}:"), F.col(key).cast("string")))


def topic_quotas(sizes: dict[str, int], n: int, seed: int, topics: tuple[int, int] = (15, 50), least: int = 150) -> dict[str, int]:
    """How many of ``n`` rows each focus topic gets: some topics of at least ``least`` rows, with weights from a shifted
    Pareto law, and a multinomial draw limited by the topic's rows."""
    rng = np.random.default_rng(seed)
    large = sorted(k for k, v in sizes.items() if v >= least)
    chosen = rng.choice(large, min(len(large), int(rng.integers(*topics))), replace=False) if large else []
    weight = rng.pareto(1.2, len(chosen)) + 0.3
    drawn = rng.multinomial(n, weight / weight.sum()) if len(chosen) else []
    return {str(k): int(min(c, sizes[str(k)])) for k, c in zip(chosen, drawn, strict=True) if c}


def topic_subset(df: DataFrame, key: str, text: str, label: str, n: int, seed: int, focus: float = 0.7, **how) -> DataFrame:  # noqa: ANN003
    """(key, label, focus, place): ``n`` rows of different texts, a share ``focus`` of them from focus topics by
    :func:`topic_quotas`, the others from all remaining rows, in a seeded order.

    Of rows with one text the smallest key counts; null labels are no topic; missing rows are topped up from the rest.
    """
    rows = df.where(F.col(text).isNotNull() & (F.trim(text) != "")).groupBy(text).agg(F.min(F.struct(key, label)).alias("r")).select("r.*")
    sizes = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    kinds = sizes.count()
    if kinds > MOST_LABELS:
        raise ValueError(f"{kinds} labels; at most {MOST_LABELS} get quotas")
    quotas = topic_quotas({r[label]: r.n for r in sizes.collect()}, int(n * focus), seed, **how)
    table = df.sparkSession.createDataFrame(list(quotas.items()), f"{label} string, quota long")
    first = Window.partitionBy(label).orderBy(_digest(seed, "focus", key), key)
    ranked = rows.join(table, label, "left")
    ranked = ranked.withColumn("focus", F.coalesce(F.row_number().over(first) <= F.col("quota"), F.lit(False)))
    picked = ranked.orderBy(F.desc("focus"), _digest(seed, "rest", key), key).limit(n)
    place = F.row_number().over(Window.orderBy(_digest(seed, "place", key), key))  # the sample of ``n`` rows is ranked
    return picked.select(key, label, "focus", place.alias("place"))


def group_mix(df: DataFrame, key: str, group: str, n: int, seed: int, shares: dict[str, float] | None = None, alpha: float = 1.0) -> DataFrame:
    """(key, group): ``n`` rows without replacement, groups mixed by ``shares`` jittered by 0.7 to 1.3, or by a
    Dirichlet draw where none are given; inside a group all rows have the same chance."""
    rng = np.random.default_rng(seed)
    sizes = {r[group]: r["count"] for r in df.where(F.col(group).isNotNull()).groupBy(group).count().orderBy(group).collect()}
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"{len(sizes)} groups; at most {MOST_LABELS} are mixed")
    names = sorted(sizes)
    mix = np.array([shares.get(x, 0.0) for x in names]) * rng.uniform(0.7, 1.3, len(names)) if shares is not None else rng.dirichlet(np.full(len(names), alpha)) if names else np.zeros(0)
    weights = [(x, float(m / sizes[x])) for x, m in zip(names, mix, strict=True)]
    table = df.sparkSession.createDataFrame(weights, f"{group} string, __w double")
    return weighted(df.select(key, group).join(table, group), key, "__w", n, seed).select(key, group)


def left_out_folds(df: DataFrame, group: str) -> DataFrame:
    """(held_out, group, rows): for every group left out, which groups a model is fitted on and how many rows they have."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    held = sizes.select(F.col(group).alias("held_out"))
    return held.join(sizes, F.col("held_out") != F.col(group)).select("held_out", group, "rows")


def simulated_rounds(units: DataFrame, rounds: int, seed: int, many: int = 3, one: int = 1) -> DataFrame:
    """(round, gain): in each round ``many`` different subsets of the main domain and ``one`` of the others, one random
    unit (variant and order) of each, and the gain of the mean score of the second solution over the first, in percent.

    ``units`` are (subset_id, main, one, other), a table of scores: at most ``MOST_LABELS`` rows.  A domain with fewer
    subsets gives all it has.
    """
    n = units.count()
    if n > MOST_LABELS:
        raise ValueError(f"{n} units; at most {MOST_LABELS} are drawn from")
    by = units.groupBy("main", "subset_id").agg(F.array_sort(F.collect_list(F.struct("one", "other"))).alias("u"))
    packed = by.groupBy().agg(F.array_sort(F.collect_list(F.when(F.col("main"), F.struct("subset_id", "u")))).alias("m"), F.array_sort(F.collect_list(F.when(~F.col("main"), F.struct("subset_id", "u")))).alias("o"))
    r = units.sparkSession.range(rounds).withColumnRenamed("id", "round").join(F.broadcast(packed))
    text = lambda *x: F.concat_ws(":", F.lit(str(seed)), F.col("round").cast("string"), *[y.cast("string") for y in x])

    def draw(c: str, k: int) -> Column:
        order = F.array_sort(F.transform(c, lambda s: F.struct(stable_hash(text(s.subset_id)).alias("h"), s.alias("s"))))
        return F.transform(F.slice(order, 1, k), lambda x: F.element_at(x.s.u, (stable_hash(text(x.s.subset_id, F.lit("unit"))) % F.size(x.s.u) + 1).cast("int")))

    picks = F.concat(draw("m", many), draw("o", one))
    mean = lambda f: F.aggregate("p", F.lit(0.0), lambda a, x: a + f(x)) / F.size("p")
    out = r.select("round", picks.alias("p")).where("size(p) > 0").select("round", mean(lambda x: x.one).alias("one"), mean(lambda x: x.other).alias("other"))
    return out.where("one <> 0").select("round", (100 * (F.col("other") / F.col("one") - 1)).alias("gain"))
