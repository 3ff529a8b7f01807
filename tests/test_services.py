"""Encoders, pipelines, requests and fetching."""

import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import wordpiece
from weftline.operators import clustering, encoder, features, svd
from weftline.plans import pipelines, service
from weftline.sources import files


def named(w, mpnet=False):
    q, k, v, o, n = ("attention.attn.q", "attention.attn.k", "attention.attn.v", "attention.attn.o", "attention.LayerNorm") if mpnet else ("attention.self.query", "attention.self.key", "attention.self.value", "attention.output.dense", "attention.output.LayerNorm")
    t = {"embeddings.word_embeddings.weight": w.tokens, "embeddings.position_embeddings.weight": w.places, "embeddings.LayerNorm.weight": w.start.gain, "embeddings.LayerNorm.bias": w.start.bias}
    if mpnet:
        t["encoder.relative_attention_bias.weight"] = w.relative
    else:
        t["embeddings.token_type_embeddings.weight"] = w.kinds
    for i, x in enumerate(w.layers):
        for name, part in ((q, x.query), (k, x.key), (v, x.value), (o, x.out), ("intermediate.dense", x.up), ("output.dense", x.down)):
            t[f"encoder.layer.{i}.{name}.weight"], t[f"encoder.layer.{i}.{name}.bias"] = part.weight.T, part.bias
        for name, part in ((n, x.after_attention), ("output.LayerNorm", x.after_feed)):
            t[f"encoder.layer.{i}.{name}.weight"], t[f"encoder.layer.{i}.{name}.bias"] = part.gain, part.bias
    if w.head:
        t["head.weight"], t["head.bias"] = w.head.weight.T, w.head.bias
    return t


@pytest.mark.parametrize("buckets", [None, 32])
def test_encoder_weights_and_padding(buckets):
    w = encoder.Weights.random(50, 16, 2, 4, longest=40, out=8, buckets=buckets)
    again = encoder.Weights.from_tensors(named(w, bool(buckets)), 4, "head")
    ids = np.array([[2, 7, 9, 3, 0, 0], [2, 5, 3, 0, 0, 0]])
    mask = ids > 0
    a, b = encoder.forward(w, ids, mask), encoder.forward(again, ids, mask)
    assert a.shape == (2, 8) and np.allclose(a, b, atol=1e-5) and np.allclose(np.linalg.norm(a, axis=1), 1)
    assert np.allclose(encoder.forward(w, ids[1:, :3], mask[1:, :3])[0], a[1], atol=1e-5)


def test_relative_buckets():
    b = encoder.relative_buckets(300)
    assert b.min() == 0 and b.max() == 31 and (np.diag(b) == 0).all()
    assert b[10, 9] == 1 and b[10, 11] == 17 and b[7, 0] == 7 and b[8, 0] == 8 and b[299, 0] == 15
    assert all(np.array_equal(np.diag(b, k)[0] * np.ones(300 - abs(k)), np.diag(b, k)) for k in (-5, 3, 140))


def test_gelu_forms():
    x = np.linspace(-4, 4, 41)
    assert np.abs(encoder.gelu(x, True) - encoder.gelu(x, False)).max() < 2e-3 and encoder.gelu(np.zeros(1), True)[0] == 0


def test_word_piece_normaliser(spark):
    texts = ["Ångström ÉCOLE ñandú", "한국어 text", "tab\tnew\nline x​", "Ёлка й", "ÅB�", "", None, "plain"]

    def plain(t):
        t = "".join(" " if c in "\t\n\r" or c.isspace() else c for c in t if c in "\t\n\r" or (c != "�" and unicodedata.category(c)[0] != "C"))
        return "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").lower()

    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(wordpiece.normalise(F.col("t")).alias("x")).collect()]
    assert got == [None if t is None else plain(t) for t in texts]


def subset_rows(n=60):
    a, b = ["engine wheel driver road", "wheel road brake engine", "driver engine brake wheel"], ["bread oven flour yeast", "oven yeast dough bread", "flour dough bread oven"]
    return [(1, i, (a if i % 2 else b)[i % 3] + f" extra{i % 5}") for i in range(n)] + [(1, 900, None), (1, 901, "!!"), (2, 0, "one single text here"), (3, 0, "")]


@pytest.mark.parametrize("name", ["baseline", "fallback", "leader"])
def test_pipelines_label_every_row(spark, name):
    df = spark.createDataFrame(subset_rows(), "g long, i long, text string").withColumn("clean", F.lit(0))
    got = {(r.g, r.i): r.cluster for r in service.PIPELINES[name](df, "g", "i", "text").collect()}
    assert len(got) == 64 and got[1, 900] == got[1, 901] == got[3, 0] == -1 and got[2, 0] == 0
    if name != "leader":
        assert all(got[1, i] == got[1, i % 30] for i in range(60))  # copies


def test_grouped_kmeans_separates(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(30, 3)) * 0.05 + c for c in np.eye(3)])
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)] + [(1, 200, None)], "g long, i long, v array<double>")
    lab = {r.i: r.cluster for r in clustering.grouped_kmeans(df, "g", "i", "v", lambda n: 3).collect()}
    assert len(lab) == 90 and all(len({lab[i] for i in range(k * 30, k * 30 + 30)}) == 1 for k in range(3)) and len(set(lab.values())) == 3
    alone = [r.cluster for r in clustering.grouped_kmeans(df, "g", "i", "v", lambda n: 3, 0.1).collect()]
    assert sum(c >= 1_000_000 for c in alone) == 9


def test_grouped_decomposition(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2, 20, 3)) @ rng.normal(size=(2, 3, 12))
    long = [(g, i, f"t{j}", float(x[g, i, j])) for g in range(2) for i in range(20) for j in range(12)]
    df = spark.createDataFrame(long, "g long, i long, term string, value double")
    rows = svd.grouped_svd(df, "g", "i", 3).collect()
    for g in range(2):
        y = np.array([r.v for r in sorted(rows, key=lambda r: r.i) if r.g == g])
        assert np.allclose(y @ y.T, x[g] @ x[g].T, atol=1e-6)
    vectors = spark.createDataFrame([(0, "t1", [1.0, 0.0]), (0, "t2", [0.0, 2.0])], "g long, term string, v array<double>")
    weights = spark.createDataFrame([(0, 5, "t1", 1.0), (0, 5, "t2", 1.0), (0, 6, "zz", 1.0), (1, 5, "t1", 1.0)], "g long, i long, term string, w double")
    got = {(r.g, r.i): list(r.v) for r in svd.grouped_means(weights, vectors, "g", "i", "w").collect()}
    assert got == {(0, 5): [0.5, 1.0], (0, 6): [0.0, 0.0]}


def test_vocabulary_is_never_empty(spark):
    tf = spark.createDataFrame([(1, 1, "a", 1), (1, 2, "b", 2)], "g long, i long, term string, tf long")
    assert features.grouped_weights(tf, "g", "i", few=0).count() == 2


def test_finer_cut_of_large_clusters():
    rng = np.random.default_rng(0)
    assert len(set(clustering.kmeans_array(rng.normal(size=(5, 2)), 50))) <= 5


def test_requests(spark):
    assert service.health(spark) == {"status": "ok"}
    with pytest.raises(service.BadRequest):
        service.cluster_request(spark, [])
    with pytest.raises(service.BadRequest):
        service.cluster_request(spark, ["a"] * 3, most=2)
    got = service.cluster_request(spark, [t for _, _, t in subset_rows(20)[:22]])
    assert len(got) == 22 and got[20] == got[21] == -1
    with pytest.raises(ValueError, match="registered"):
        service.register(service.PIPELINES, "baseline")(pipelines.baseline)
    taps = service.Taps()
    assert taps("first", spark.range(3)).count() == 3 and taps.sizes() == {"first": 3}


def test_fetching_resumes(spark, tmp_path):
    path, keys = str(tmp_path / "f"), spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("bad",)], "k string")

    def fetch(k):
        if k == "bad":
            raise OSError("gone")
        return k * 2

    files.fetch_missing(keys, "k", fetch, path, stored=False)
    got = {r.k: (r.body, r.error) for r in spark.read.parquet(path).collect()}
    assert got == {"a": ("aa", None), "b": ("bb", None), "bad": (None, "OSError: gone")}
    files.fetch_missing(keys, "k", lambda k: "late", path, stored=True)
    assert sorted(r.body for r in spark.read.parquet(path).where("body is not null").collect()) == ["aa", "bb", "late"]
    files.write_jsonl(spark.range(2), str(tmp_path / "j"))
    files.write_jsonl(spark.range(3), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    files.write_arrays(spark.range(2).selectExpr("array(id) as a"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
