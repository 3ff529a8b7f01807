import json
import struct

import numpy as np

from weftline.sources import files
from weftline.sources.pages import PagedIndex


def test_jsonl_and_log(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"text": "x", "label": 1}\n\n{"text": "y"}\n')
    rows = files.read_jsonl(spark, str(p), "text string, label int").collect()
    assert [(r.text, r.label) for r in rows] == [("x", 1), ("y", None)]
    out = str(tmp_path / "log")
    for _ in range(2):
        files.append_log(spark.range(2), out)
    assert spark.read.json(out).count() == 4


def test_arrays_and_tensors(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6.0).reshape(3, 2))
    got = files.read_arrays(spark, str(tmp_path / "a.npy")).orderBy("row_no").collect()
    assert [r["values"] for r in got] == [[0, 1], [2, 3], [4, 5]]
    head = json.dumps({"w": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}}).encode()
    (tmp_path / "m.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + np.array([1.5, 2.5], "<f4").tobytes())
    r = files.read_safetensors(spark, str(tmp_path / "m.safetensors")).first()
    assert (r.name, r.shape, r["values"]) == ("w", [2], [1.5, 2.5])


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<feed><entry><id>http://x/abs/12</id><title>A\n  b</title><category term="cs.LG"/><primary_category term="cs.LG"/></entry></feed>')
    r = files.read_feed(spark, str(tmp_path / "f.xml")).first()
    assert (r.paper_id, r.title, r.cat, r.primary_cat) == ("12", "A b", "cs.LG", "cs.LG")


def test_pick_append_and_shards(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "t"), (2, "c", "u")], "k int, content string, title string")
    assert [r.body for r in files.pick(df, body=["content", "text", "title"]).collect()] == ["t", "c"]
    p = str(tmp_path / "t")
    files.append_missing(df, p, "k", spark, known=False)
    files.append_missing(df.unionByName(df.selectExpr("k + 10 as k", "content", "title")), p, "k", spark, known=True)
    assert spark.read.parquet(p).count() == 4
    files.write_sharded(spark.range(25).coalesce(1), str(tmp_path / "s"), 10)
    assert len(list((tmp_path / "s").glob("*.parquet"))) == 3


def test_pages(spark, tmp_path):
    for n, size in enumerate((2, 2, 1)):
        (tmp_path / f"page-{n}.json").write_text(json.dumps([{"i": i} for i in range(size)]))
    spark.dataSource.register(PagedIndex)
    got = spark.read.format("paged_index").option("path", str(tmp_path)).option("size", 2).load()
    assert got.count() == 5 and got.rdd.getNumPartitions() == 3
