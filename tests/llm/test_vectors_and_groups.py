import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import markov, neighbours


def brute(x, ids, k):
    u = np.asarray(x, np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    out = set()
    for i in range(len(ids)):
        s = np.rint(u @ u[i] * 1e6)
        s[i] = -np.inf
        out |= {(ids[i], ids[j]) for j in np.lexsort((ids, -s))[:k]}
    return out


@pytest.mark.parametrize("block", [16, 4096])
def test_index_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 6))
    x[40:70] = x[3]  # a hot vector
    ids = np.arange(120) * 3
    rows = [(int(i), 1, v.tolist()) for i, v in zip(ids, x, strict=True)]
    rows += [(900, 1, None), (901, 1, [0.0] * 6), (902, 1, [1.0, float("nan")] + [0.0] * 4), (903, 2, [1.0] * 6), (904, None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, grp int, g array<float>").withColumn("rep", F.lit(0))
    got = {(r.id, r.neighbour) for r in neighbours.nearest(df, "vec_id", "grp", ["g"], k=5, budget=10_000).collect()}
    assert got == brute(x, ids, 5)
    some = {(r.id, r.neighbour) for r in neighbours.nearest(df, "vec_id", "grp", ["g"], k=5, budget=30).collect()}
    assert len(some & got) >= 0.5 * len(got)
    exact = {(r.id, r.neighbour) for r in neighbours.nearest(df, "vec_id", "grp", ["g"], k=5, recall=1.0).collect()}
    assert exact == got
    measured = {(r.id, r.neighbour) for r in neighbours.nearest(df, "vec_id", "grp", ["g"], k=5).collect()}
    assert len(measured & got) >= 0.97 * len(got)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, 1, None)], "vec_id long, subset_id int, g array<float>")
    assert neighbours.nearest(df, "vec_id", "subset_id", ["g"]).count() == 0


def test_traversal_order():
    d1, d2 = np.array([[0.0, 1.0, 5.0]]), np.array([[0.0, 2.0, 3.0]])
    count = np.ones((3, 3), int)
    for budget in range(1, 10):
        taken = neighbours.traverse(d1, d2, count, budget)[0]
        total = d1.T + d2
        assert taken.sum() == budget and total[taken].max() <= total[~taken].min(initial=np.inf)


PHRASES = ["i have been looking at {0} for a while", "does anyone know why {0} changed {1}", "after all that {0} went wrong without warning", "my brother told me about {0} and {1}",
           "you can find {0} next to {1} these days", "it seems {0} will never be finished", "we waited for {0} the whole morning", "the report on {0} came out last week",
           "nobody expected {0} to matter this much", "there is more to {0} than people say", "she wrote a long note on {0}", "they moved {0} closer to {1} again"]


def texts(groups=20, each=12, strays=60, seed=0):
    """Groups that share names, told in everybody's phrases; strays name what nobody else does."""
    rng = np.random.default_rng(seed)
    out = []
    say = lambda names, n: " ".join(rng.choice(PHRASES).format(*rng.choice(names, 2, replace=False)) + "." for _ in range(n))
    for g in range(groups):
        out += [(g, say([f"name{g}x{c}" for c in "abcde"], 4)) for _ in range(each)]
    out += [(-1, say([f"thing{x}" for x in rng.integers(0, 400, 6)], 3)) for _ in range(strays)]
    return [out[i] for i in rng.permutation(len(out))]


def pairs(lab):
    return {(a, b) for a in lab for b in lab if a < b and lab[a] == lab[b]}


def group(spark, requests, **how):
    req = spark.createDataFrame(requests, "request_id long, texts array<string>").withColumn("pos", F.lit(9))
    got = markov.group_texts(markov.request_texts(req), **how).cache()
    return req, got, {i: {r.pos: r.cluster for r in got.collect() if r.request_id == i} for i, _ in requests}


def test_groups(spark):
    t = texts()
    rows = [(5, [x for _, x in t] + [None, "", "hi"]), (6, []), (7, None), (8, [None])]
    req, one, label = group(spark, rows)
    want = pairs({i: g for i, (g, _) in enumerate(t) if g >= 0})
    got = pairs(label[5])
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    ids = {r.request_id: r.cluster_ids for r in markov.responses(one, req).collect()}
    assert set(ids) == {5, 6, 8} and len(ids[5]) == len(t) + 3 and ids[5][-3:] == [-1] * 3 and ids[6] == [] and ids[8] == [-1]
    about = markov.describe(one, markov.request_texts(req)).collect()
    assert all(r.size >= markov.LEAST_SIZE and len(r.typical) == 3 for r in about)
    # neither the blocks of columns nor the other requests matter
    _, _, more = group(spark, [rows[0], (9, [x for _, x in texts(8, 10, 10, 3)])], column_block=64)
    assert pairs(more[5]) == got and more[9]


def test_copies_lose_no_member(spark):
    t = [x for _, x in texts(6, 12, 20, 1)]
    _, _, plain = group(spark, [(1, t)])
    _, _, full = group(spark, [(1, t + [t[0], t[0].upper()] * 30)])
    assert pairs({p: c for p, c in full[1].items() if p < len(t)}) == pairs(plain[1])
    assert all(full[1].get(p) == full[1].get(0) for p in range(len(t), len(t) + 60))


@pytest.mark.parametrize("cell", [120, 16_384])
def test_index_finds_the_neighbours(spark, cell):
    t = texts(30, 14, 60, 2)
    req = spark.createDataFrame([(1, [x for _, x in t])], "request_id long, texts array<string>")
    _, reps = markov.representatives(markov.request_texts(req))
    vec = markov.vectors(reps).cache()
    x = np.zeros((len(t), 5000))
    col = {}
    for r in vec.collect():
        x[r.pos, col.setdefault(r.word, len(col))] = r.val
    c = np.rint(x @ x.T * 1e5) / 1e5
    np.fill_diagonal(c, 0)
    want = set()
    for i in range(len(t)):
        best = [j for j in np.lexsort((np.arange(len(t)), -c[i]))[: markov.KNN] if c[i, j] >= markov.LEAST_COS]
        want |= {(i, int(j)) for j in best} | {(int(j), i) for j in best}
    got = {(r.pos, r.other) for r in markov.similarity_graph(vec, cell).collect()}
    assert len(want) > 1000 and len(got & want) >= (0.99 if cell > 1000 else 0.9) * len(want)


@pytest.mark.parametrize("cell", [8, 30, 100])
def test_long_lists_lose_no_neighbour(spark, cell):
    """Lists far above a cell, and records that share one word only, whose list is long."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(150):
        words_ = [(7, 0.5, 150), *((int(w), 0.2, 30) for w in rng.choice(np.arange(10, 25), 3, replace=False)), (1000 + i, 0.0, 1)]
        own = (1 - sum(v * v for _, v, _ in words_)) ** 0.5
        rows += [(1, i, w, v or own, df) for w, v, df in words_]
    rows += [(1, 200 + i, 7, 0.6, 150) for i in range(4)] + [(1, 200 + i, 2000 + i, 0.8, 1) for i in range(4)] + [(2, i, 7, 1.0, 3) for i in range(3)]
    vec = spark.createDataFrame(rows, "request_id long, pos int, word long, val float, df long").cache()
    edges = lambda c: {tuple(r) for r in markov.similarity_graph(vec, c).select("request_id", "pos", "other", "sim").collect()}
    want = edges(100_000)
    assert len(want) > 2000 and edges(cell) == want


def test_rounds_do_not_depend_on_blocks():
    rng = np.random.default_rng(0)
    m = np.where(rng.random((50, 50)) < 0.2, rng.random((50, 50)), 0) + np.eye(50)
    m /= m.sum(0)
    col, row = np.nonzero(m.T)
    off, val, ids = np.searchsorted(col, np.arange(51)), m.T[col, row], np.arange(50)
    whole = markov.expand(off, row, val, ids, off, row, val)
    parts = [markov.expand(off[a : a + 11] - off[a], row[off[a] : off[a + 10]], val[off[a] : off[a + 10]], ids, off, row, val) for a in range(0, 50, 10)]
    assert np.array_equal(np.concatenate([p[1] for p in parts]), whole[1]) and np.allclose(np.concatenate([p[2] for p in parts]), whole[2])
    dense = np.linalg.matrix_power(m, 2) ** markov.INFLATION
    dense /= dense.sum(0)
    k = 7
    kept = dict(zip(whole[1][whole[0][k] : whole[0][k + 1]], whole[2][whole[0][k] : whole[0][k + 1]], strict=True))
    assert len(kept) <= markov.KEEP and abs(sum(kept.values()) - 1) < 1e-9
    best = max(kept, key=kept.get)
    assert best == dense[:, k].argmax()


def test_columns_of_many_entries_lose_none():
    """Flow that spreads evenly over more than a few records stays with all of them."""
    n = 120
    off, row, val = np.arange(0, n * n + 1, n), np.tile(np.arange(n), n), np.full(n * n, 1 / n)
    off2, row2, val2 = markov.expand(off, row, val, np.arange(n), off, row, val)
    assert np.array_equal(off2, off) and np.array_equal(row2, row) and np.allclose(val2, val)


def test_no_requests(spark):
    req = spark.createDataFrame([], "request_id long, texts array<string>")
    assert markov.group_texts(markov.request_texts(req)).count() == 0
