import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import visible, words


def norm(*texts, **how):
    return visible.normalise_array(pa.array(list(texts), pa.string()), **how).to_pylist()


def test_visible_forms():
    assert norm("Ｈｅｌｌｏ　ｗ", " a  b \n", "x​y­", None, "", "​ ", "café") == ["Hello w", "a b", "xy", None, "", "", "café"]


def test_letters_that_look_alike():
    latin, mixed, cyr = norm("passport now", "раѕѕроrt now", "привет мир о сор")
    assert latin == mixed == "passport now"
    assert cyr == "привет мир о сор"
    a, b = norm("мoй дом", "мой дом")
    assert a == b == "мой дом"


def test_visible_differences_stay():
    for a, b in (("a", "A"), ("e", "é"), ("a.", "a,"), ("x²", "x2"), ("a b", "ab"), ("ё", "е")):
        x, y = norm(a, b, key=True)
        assert x != y


SAFE = st.text(st.one_of(st.characters(min_codepoint=32, max_codepoint=0x24F), st.characters(min_codepoint=0x300, max_codepoint=0x36F), st.sampled_from("각한글각 　​﻿")), max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(SAFE, max_size=5))
def test_idempotent_and_stable_under_decomposition(texts):
    once = norm(*texts)
    assert norm(*once) == once
    assert norm(*[unicodedata.normalize("NFD", t) for t in texts]) == once
    assert norm(*[unicodedata.normalize("NFC", t) for t in texts]) == once
    assert [norm(t)[0] for t in texts] == once  # rows do not touch each other
    k = norm(*texts, key=True)
    assert all((a == b) == (x == y) for a, x in zip(once, k, strict=True) for b, y in zip(once, k, strict=True))


def test_long_run_of_marks():
    assert norm("a" + "́" * 3000)[0] == "á" + "́" * 2999


def test_words_and_shingles():
    w = words.words_of(pa.array(["Ein Wort, ein WORT!", None, "", "abc"]))
    assert (w.off == [0, 4, 4, 4, 5]).all()
    assert w.hash[0] == w.hash[2] and w.hash[1] == w.hash[3] and w.hash[0] != w.hash[1]
    h, off = words.shingles(w, 2)
    assert off.tolist() == [0, 2, 2, 2, 2]
    assert words.shingles(words.words_of(pa.array([], pa.string())), 3)[1].tolist() == [0]


@pytest.mark.parametrize("n", [0, 6])
def test_look_alike_pairs(spark, n):
    rows = [(1, "a b"), (2, "a b"), (3, "a b"), (4, None), (5, "​"), (6, " ")][:n]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("a", F.lit(0)).withColumn("__k", F.lit(1))
    got = {(r.a, r.b) for r in visible.look_alike_pairs(df, "id", "text", "a", "b").collect()}
    assert got == ({(1, 2), (2, 3)} if n else set())


def test_many_copies_and_one_variant(spark):
    copies = spark.range(20_000).select("id", F.lit("one common text").alias("text"))
    df = copies.unionByName(spark.createDataFrame([(90_000, "one\u200b common text"), (None, "one common  text")], "id long, text string"))
    got = visible.look_alike_pairs(df, "id", "text", "a", "b")
    assert got.where("b = 90000").distinct().count() == 20_000 and got.count() == 20_000
