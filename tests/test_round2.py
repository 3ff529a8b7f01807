"""Decompositions, layouts, batches, merges and noise features against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import knn, labels, layout, matrix, sampling, statistics, svd


def sparse(rng, n, m, share=0.2):
    x = np.where(rng.random((n, m)) < share, rng.normal(size=(n, m)), 0)
    return x, [(int(i), f"t{j:03d}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]


def test_sparse_decomposition(spark):
    rng = np.random.default_rng(0)
    x, long = sparse(rng, 90, 40)
    x = x @ np.diag(0.8 ** np.arange(40))
    long = [(i, t, float(x[i, int(t[1:])])) for i, t, _ in long]
    dec = svd.truncated_svd(spark.createDataFrame(long, "id long, term string, value double").withColumn("at", F.lit(1)), ["id"], 6)
    u, s, vt = np.linalg.svd(x)
    assert np.allclose(dec.sigma, s[:6], rtol=1e-3)
    got = np.zeros((90, 6))
    for r in dec.coordinates().collect():
        got[r.id] = r.v
    assert np.allclose(np.abs(got), np.abs(x @ vt[:6].T), atol=0.02)
    v = {r.term: r.v for r in dec.term_vectors().collect()}
    assert len(v) == 40 and np.allclose(np.abs(v["t005"]), np.abs(vt[:6, 5]), atol=0.01)
    mean = dec.weighted_means(spark.createDataFrame([(1, "t001", 1.0), (1, "t002", 3.0), (2, "zz", 1.0)], "k long, term string, w double"), ["k"], "w").collect()
    assert [r.k for r in mean] == [1]
    assert np.allclose(np.abs(mean[0].v), np.abs((vt[:6, 1] + 3 * vt[:6, 2]) / 4 * s[:6]), atol=0.02)


def test_empty_decomposition(spark):
    dec = svd.truncated_svd(spark.createDataFrame([], "id long, term string, value double"), ["id"], 3)
    assert len(dec.sigma) == 0 and dec.coordinates().count() == 0


def test_too_many_terms_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(svd, "MOST_TERMS", 1)
    with pytest.raises(ValueError, match="2 terms"):
        svd.truncated_svd(spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0)], "id long, term string, value double"), ["id"], 1)


def test_layout_keeps_communities_apart():
    rng = np.random.default_rng(1)
    n = 120
    src = rng.integers(0, n, 2400)
    dst = (src // 40) * 40 + rng.integers(0, 40, 2400)
    keep = src != dst
    s, t = np.concatenate([src[keep], dst[keep]]), np.concatenate([dst[keep], src[keep]])
    y = layout.force_layout(n, s, t, np.ones(len(s)), 2, 100, 3)
    assert np.isfinite(y).all()
    c = np.stack([y[k * 40 : (k + 1) * 40].mean(0) for k in range(3)])
    inside = max(np.linalg.norm(y[k * 40 : (k + 1) * 40] - c[k], axis=1).mean() for k in range(3))
    between = min(np.linalg.norm(c[a] - c[b]) for a in range(3) for b in range(a))
    assert between > 1.5 * inside
    assert layout.epochs_for(100) == 200 and layout.epochs_for(10_000) == 100 and layout.epochs_for(10**6) == 30


def test_start_positions_fill_the_box():
    y = layout.start_positions(3, np.array([0]), np.array([1]), np.ones(1), 5, np.random.default_rng(0))
    assert y.shape == (3, 5) and (y >= 0).all() and (y <= layout.BOX).all()


@pytest.mark.parametrize("sizes", [[5, 5, 5, 3, 9, 100, 1, 1], [], [7] * 50, [50, 60], [1] * 23])
def test_length_batches(spark, sizes):
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, n int")
    rows = sampling.length_batches(df, "id", "n", 20).collect()
    assert {r.id for r in rows} == set(range(len(sizes)))
    by = {}
    for r in rows:
        by.setdefault(r.batch, []).append(r.n)
    # one row at a time, in order of length
    want, now = [], []
    for n in sorted(sizes):
        if now and (len(now) + 1) * n > 20:
            want.append(now)
            now = []
        now.append(n)
    want += [now] if now else []
    assert [sorted(by[k]) for k in sorted(by)] == want


def test_merge_tiny(spark):
    v = {0: [1.0, 0.0], 1: [0.99, 0.05], 2: [0.0, 1.0], 3: [0.02, 1.0], 4: [-1.0, 0.3]}
    df = spark.createDataFrame([(1, i, 10 + i, x) for i, x in v.items()], "g long, id long, cluster long, v array<double>")
    got = {r.id: r.cluster for r in labels.merge_tiny(df, "id", "cluster", "v", "g").collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}


def test_rescue_stays_in_its_group(spark):
    rows = [(1, i, 0, [1.0, 0.0]) for i in range(4)] + [(1, 9, 5, [0.9, 0.1]), (2, 20, 7, [1.0, 0.0]), (2, 21, 8, [0.0, 1.0]), (2, 22, 8, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "g long, id long, c long, v array<double>")
    got = {r.id: r.c for r in labels.rescue(df, "id", "c", "v", 2, 0.7, group="g").collect()}
    assert got[9] == 0 and got[20] == 7 and got[21] == 8


def test_blocks_do_not_depend_on_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i) * 10**9, 1, x.tolist()) for i, x in enumerate(rng.normal(size=(60, 4)))]
    df = spark.createDataFrame(rows, "id long, g long, v array<double>")
    a, b = (sorted(knn.exact_knn(df, "id", "v", 5, group="g", block=n).collect()) for n in (7, 1000))
    assert a == b and len(a) == 300


def test_normal_tail(spark):
    from math import erfc, sqrt

    zs = [-3.0, -0.5, 0.0, 1.0, 2.5, 6.0]
    got = [r.p for r in spark.createDataFrame([(z,) for z in zs], "z double").select(statistics.normal_tail(F.col("z")).alias("p")).collect()]
    assert np.allclose(got, [erfc(z / sqrt(2)) / 2 for z in zs], atol=1e-8)


def test_distilled_projection(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 6))
    y = x @ rng.normal(size=(6, 5))
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(80) for j in range(6)], "id long, bucket int, value double")
    target = spark.createDataFrame([(i, y[i].tolist()) for i in range(60)], "id long, v array<double>")
    got = {r.id: np.array(r.v) for r in matrix.distil(cells, target, ["id"], "v", 6, 3, 1e-6).collect()}
    basis = matrix.components(target, "v", 3)[1]
    assert len(got) == 80 and all(np.allclose(got[i], y[i] @ basis, atol=1e-3) for i in range(80))
