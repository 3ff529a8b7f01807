"""Seeded subsets, mixes and simulated rounds."""

import numpy as np
from pyspark.sql import functions as F

from weftline.operators import sampling


def test_topic_subset(spark):
    rows = [(i, f"text {i}", f"t{i % 4}" if i % 5 else None) for i in range(1000)] + [(2000 + i, "text 1", "t1") for i in range(50)] + [(3000, None, "t1"), (3001, "  ", "t2")]
    df = spark.createDataFrame(rows, "id long, text string, label string").withColumn("focus", F.lit(1))
    got = sampling.topic_subset(df, "id", "text", "label", 300, 7, focus=0.6, topics=(2, 4), least=100).collect()
    again = sampling.topic_subset(df.repartition(7), "id", "text", "label", 300, 7, focus=0.6, topics=(2, 4), least=100).collect()
    assert len(got) == 300 and sorted(r.place for r in got) == list(range(1, 301)) and len({r.id for r in got}) == 300
    assert {(r.id, r.place) for r in got} == {(r.id, r.place) for r in again}
    focus = [r for r in got if r.focus]
    assert 100 <= len(focus) <= 180 and len({r.label for r in focus}) <= 3
    assert sampling.topic_subset(df.limit(0), "id", "text", "label", 10, 1).count() == 0
    assert sampling.topic_subset(df, "id", "text", "label", 5000, 1).count() == 1000


def test_topic_quotas():
    q = sampling.topic_quotas({"a": 500, "b": 300, "c": 10}, 200, 1)
    assert set(q) <= {"a", "b"} and sum(q.values()) <= 200 and q == sampling.topic_quotas({"a": 500, "b": 300, "c": 10}, 200, 1)
    assert sampling.topic_quotas({}, 10, 1) == {}


def test_group_mix(spark):
    df = spark.createDataFrame([(i, "ab"[i % 10 == 0]) for i in range(2000)] + [(9999, None)], "id long, g string")
    got = [r.g for r in sampling.group_mix(df, "id", "g", 200, 3, {"a": 0.5, "b": 0.5}).collect()]
    assert len(got) == 200 and 50 < got.count("b") < 150
    assert sampling.group_mix(df, "id", "g", 100, 3).count() == 100


def test_simulated_rounds(spark):
    units = [(s, True, 0.5, 0.5 * (1 + s / 100)) for s in range(1, 5) for _ in range(2)] + [(9, False, 0.5, 0.5)]
    df = spark.createDataFrame(units, "subset_id int, main boolean, one double, other double")
    g = np.array([r.gain for r in sampling.simulated_rounds(df, 2000, 1).collect()])
    # three different ones of 1..4 percent and one of 0: four equally likely means
    values, n = np.unique(g.round(6), return_counts=True)
    assert np.allclose(values, [1.5, 1.75, 2.0, 2.25]) and n.min() > 400
    assert sampling.simulated_rounds(df.limit(0), 10, 1).count() == 0
    assert sampling.simulated_rounds(df.where("not main"), 10, 1).count() == 10
