import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import clustering, codecs, features, graph, knn, labels, metrics, sampling, statistics
from weftline.operators.layout import force_layout, top_vectors


def test_bm25_of_a_single_term(spark):
    tf = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "id int, term string, tf long")
    got = features.bm25(tf, ["id"], 2).collect()
    assert {round(r.value, 6) for r in got} == {round(math.log(2), 6)}


def test_ppmi_is_symmetric(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b"]), (3, [])], "id int, t array<string>")
    got = {(r.a, r.b): round(r.value, 9) for r in features.ppmi(features.window_pairs(df, ["id"], F.col("t"), 10)).collect()}
    assert got and all(got[(b, a)] == v for (a, b), v in got.items())


def vectors(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)] + list(extra), "id long, v array<float>")


@pytest.mark.parametrize("block", [3, 4096])
def test_exact_neighbours_match_brute_force(spark, block):
    x = np.random.default_rng(1).normal(size=(25, 4))
    x[7] = x[3]
    got = knn.exact_knn(vectors(spark, x, [(99, None)]), "id", "v", 4, block=block).orderBy("src", "rank").collect()
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for i in range(25):
        d = np.maximum(np.rint((1 - u @ u[i]) * 1e6), 0)
        d[i] = np.inf
        want = np.lexsort((np.arange(25), d))[:4].tolist()
        assert [r.dst for r in got if r.src == i] == want


def test_empty_vectors(spark):
    assert knn.exact_knn(spark.createDataFrame([], "id long, v array<float>"), "id", "v", 3).count() == 0


def test_fuzzy_union_and_bandwidth(spark):
    x = np.random.default_rng(2).normal(size=(40, 5))
    nn = knn.exact_knn(vectors(spark, x), "id", "v", 8).cache()
    bw = {r.src: (r.rho, r.sigma) for r in knn.bandwidths(nn, 8).collect()}
    by = {}
    for r in nn.collect():
        by.setdefault(r.src, []).append(r.dist)
    for i, d in by.items():
        rho, sigma = bw[i]
        total = sum(math.exp(-(y - rho) / sigma) if y > rho else 1 for y in d)
        assert abs(total - math.log2(8)) < 1e-3
    w = {(r.src, r.dst): r.w for r in knn.fuzzy_graph(nn, 8).collect()}
    assert all(abs(w[(b, a)] - v) < 1e-12 and 0 < v <= 1 for (a, b), v in w.items())


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (None, 1)], "src long, dst long")
    assert {(r.node, r.component) for r in graph.connected_components(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long")
    assert graph.connected_components(chain).select("component").distinct().count() == 1
    assert graph.connected_components(e.limit(0)).count() == 0


def scores(spark, pairs):
    df = spark.createDataFrame([(0, a, b) for a, b in pairs], "g int, a int, b int")
    r = metrics.partition_scores(df, "g", "a", "b").first()
    return round(r.ari, 6), round(r.nmi, 6)


def test_partition_scores(spark):
    assert scores(spark, [(0, 0), (0, 0), (1, 1), (1, 2)]) == (0.571429, 0.8)
    assert scores(spark, [(0, 5), (0, 5), (1, 3), (None, 3)]) == (1, 1)
    assert scores(spark, [(0, 5), (0, 5)]) == (1, 1)


def test_auc(spark):
    df = spark.createDataFrame([(0, 1.0, False), (0, 2.0, True), (0, 2.0, False), (0, 3.0, True)], "g int, s double, p boolean")
    assert metrics.rank_auc(df, "g", "s", "p").first().auc == 0.875


def test_average_linkage_of_blobs():
    rng = np.random.default_rng(0)
    x = np.repeat(np.eye(4)[:3], 10, axis=0) + rng.normal(scale=0.02, size=(30, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = clustering.cut_tree(clustering.linkage_average(x), 30, 3)
    assert lab.tolist() == [0] * 10 + [1] * 10 + [2] * 10
    assert len(set(clustering.cut_tree(clustering.linkage_average(x), 30, 7))) == 7
    assert clustering.cut_tree(clustering.linkage_average(x[:1]), 1, 3).tolist() == [0]


def test_density_clusters_and_noise():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(scale=0.05, size=(40, 2)) + c for c in ([0, 0], [3, 3], [0, 4])] + [rng.uniform(-20, 20, (5, 2))])
    lab = clustering.density_labels(x, 15, 5, guard=False)
    assert len(set(lab[:120]) - {-1}) == 3
    assert (lab[120:] == -1).sum() >= 3
    assert (clustering.density_labels(x[:3], 15, 5) == -1).all()


def test_rest_of_a_large_group_is_voted(spark, monkeypatch):
    monkeypatch.setattr(clustering, "LIMIT", 20)
    x = np.repeat(np.eye(3), 15, axis=0) + np.random.default_rng(0).normal(scale=0.02, size=(45, 3))
    df = vectors(spark, x).withColumn("g", F.lit(1))
    got = {r.id: r.cluster for r in clustering.average_linkage(df, "g", "id", "v", 3).collect()}
    assert len(got) == 45 and all(len({got[i] for i in range(a, a + 15)}) == 1 for a in (0, 15, 30))


def test_layout_is_seeded():
    src = np.array([0, 1, 2, 3, 4, 5] * 2)
    dst = np.array([1, 2, 0, 4, 5, 3] + [2, 0, 1, 5, 3, 4])
    w = np.ones(12)
    a = force_layout(6, src, dst, w, 2, 30, 1)
    assert np.allclose(a, force_layout(6, src, dst, w, 2, 30, 1)) and np.isfinite(a).all()
    assert top_vectors(6, src, dst, w, 2).shape == (6, 2)


def test_singletons_and_rescue(spark):
    df = spark.createDataFrame([(0, i, 7, float(i)) for i in range(10)], "g int, id long, cluster int, d double")
    got = {r.id: r.relabelled for r in labels.singletons(df, "g", "id", F.col("d"), 0.25).collect()}
    assert got[9] == 1000000 and got[8] == 1000001 and got[0] == 7
    rows = [(i, 1, [1.0, 0.0]) for i in range(6)] + [(6, 2, [0.99, 0.01]), (7, 3, [0.0, 1.0])]
    t = spark.createDataFrame(rows, "id long, cluster int, v array<double>")
    got = {r.id: r.cluster for r in labels.rescue(t, "id", "cluster", "v", 5, 0.77).collect()}
    assert got[6] == 1 and got[7] == 3


def test_mutual_merges_by_given_label(spark, tmp_path):
    from weftline.plans.registry import QUERIES

    far = [[-1.0, 0.1 * i, 1.0] for i in range(12)]
    rows = [(0, 7, [1.0, 0.0, 0.0])] * 3 + [(0, 9, [0.9, 0.1, 0.0])] * 5 + [(0, 2, v) for v in far] + [(0, -1, [1.0, 0.01, 0.0])] * 2
    # the same labels in another subset are other clusters; there 9 is too large
    rows += [(1, 7, [0.0, 1.0, 0.0])] * 2 + [(1, 9, [0.0, 0.9, 0.1])] * 6 + [(1, None, [0.0, 1.0, 0.0]), (1, 8, None)]
    t = [(i * 400, g, i, p, v) for i, (g, p, v) in enumerate(rows)]
    spark.createDataFrame(t, "vec_id long, subset_id int, row_no int, pred int, g array<float>").write.parquet(str(tmp_path / "feature_rows.parquet"))
    got = [(r.subset_id, r.a, r.b) for r in QUERIES["j09_mutual_merges"](spark, str(tmp_path)).collect()]
    assert got == [(0, 7, 9)]


def test_density_clusters_cover_all_rows_of_a_large_group(spark, monkeypatch):
    from weftline.operators import clustering

    monkeypatch.setattr(clustering, "LIMIT", 300)  # the group was thinned to that many rows
    rng = np.random.default_rng(0)
    centres = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    sizes = [300] * 9 + [40]
    x = np.concatenate([centres[i] + rng.normal(0, 0.05, (n, 16)) for i, n in enumerate(sizes)])
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "g int, id long, v array<double>")
    got = {r.id: r.cluster for r in clustering.density_clusters(df, "g", "id", "v").collect()}
    lab = np.array([got[i] for i in range(len(x))])
    small = lab[-40:]
    mine = np.bincount(small[small >= 0]).argmax() if (small >= 0).any() else -2
    assert (small == mine).sum() >= 35 and not (lab[:-40] == mine).any()


def test_core_distances_against_brute_force():
    from weftline.operators.clustering import core_distances

    x = np.random.default_rng(1).normal(size=(50, 4))
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)
    assert np.allclose(core_distances(x, 10, rows=7), d[:, 9])


def test_samples_are_repeatable(spark):
    df = spark.range(100)
    a = [r.id for r in sampling.uniform(df, "id", 10, 1).collect()]
    assert a == [r.id for r in sampling.uniform(df.repartition(7), "id", 10, 1).collect()] and len(set(a)) == 10
    assert {r.mean for r in sampling.bootstrap(df.limit(1).selectExpr("3.0 as v"), "v", 5).collect()} == {3.0}


def test_sign_test(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 0.0), ("b", -1.0), ("b", 1.0)], "g string, x double")
    got = {r.g: r.p for r in statistics.sign_test(df, "g", "x").collect()}
    assert abs(got["a"] - 0.125) < 1e-9 and abs(got["b"] - 0.75) < 1e-9
    w = {r.g: r.w_plus for r in statistics.signed_rank(df, "g", "x").collect()}
    assert w == {"a": 6.0, "b": 1.5}


def test_sign_test_of_large_groups(spark):
    from math import comb

    counts = {"a": (20, 21), "b": (700, 640), "c": (640, 700), "d": (0, 5), "e": (5, 0), "f": (30, 30), "h": (15_100, 14_900)}
    rows = [(g, v) for g, (b, w) in counts.items() for v in [1.0] * b + [-1.0] * w]
    got = {r.g: r.p for r in statistics.sign_test(spark.createDataFrame(rows, "g string, x double"), "g", "x").collect()}
    for g, (b, w) in counts.items():
        n = b + w
        term = total = comb(n, b)
        for k in range(b, n):
            term = term * (n - k) // (k + 1)
            total += term
        assert abs(got[g] - total / 2**n) < 1e-9, g


def test_signed_rank_of_millions(spark):
    n = 1_800_000  # n * (n + 1) * (2 * n + 1) exceeds 64 bits
    df = spark.range(n).selectExpr("'a' as g", "cast(if(id % 5 < 3, 1, -1) * (id % 4 + 1) as double) as x")
    got = statistics.signed_rank(df, "g", "x").collect()
    k = n // 4
    ranks = [k * i + (k + 1) / 2 for i in range(4)]
    w = sum(r * k * 3 / 5 for r in ranks)
    z = (w - n * (n + 1) / 4) / (n * (n + 1) * (2 * n + 1) / 24 - 4 * (k**3 - k) / 48) ** 0.5
    assert [(r.g, r.n, r.w_plus) for r in got] == [("a", n, w)] and abs(got[0].z - z) < 1e-9


def test_whole_paired_tests_take_every_row(spark, tmp_path):
    from weftline.plans.registry import QUERIES

    rows = [(i, "a", float(i)) for i in range(200)] + [(1000 + i, "b", float(i * i)) for i in range(301)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    sign = {r.g: (r.better, r.worse) for r in QUERIES["r01_sign_test_whole"](spark, str(tmp_path)).collect()}
    assert sign == {"a": (100, 100), "b": (127, 174)}
    assert {r.g: r.n for r in QUERIES["r02_signed_rank_whole"](spark, str(tmp_path)).collect()} == {"a": 200, "b": 301}


def test_labels_of_copies_beyond_32_bits(spark, tmp_path):
    from weftline.plans.registry import QUERIES

    rows = [(2147, 483_648, "Far away"), (3000, 1, "far  AWAY!"), (30, 7, "near by"), (3001, 2, "Near by"), (3001, 3, "??"), (3001, 4, None)]
    spark.createDataFrame(rows, "subset_id int, row_no int, text string").write.parquet(str(tmp_path / "bench_rows.parquet"))
    got = {(r.subset_id, r.row_no): r.label for r in QUERIES["j14_labels_back_to_copies"](spark, str(tmp_path)).collect()}
    assert got == {(2147, 483_648): 2_147_483_648, (3000, 1): 2_147_483_648, (30, 7): 30_000_007, (3001, 2): 30_000_007, (3001, 3): -1, (3001, 4): -1}


def test_nibbles_round_trip(spark):
    df = spark.range(256).select(F.col("id").cast("int").alias("b"))
    c = codecs.unpack_nibbles(F.col("b"))
    assert df.where(codecs.pack_nibbles(c[0], c[1]) != F.col("b")).count() == 0
