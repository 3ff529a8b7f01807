import pytest
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions.wordpiece import encode, match


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Hi @bob see http://a.b/c #Topic!!", "hi see topic"), ("", ""), ("  ", ""), (None, None), ("Ça va—bien", "ça va bien")],
)
def test_clean(spark, raw, want):
    assert one(spark, raw, X.clean) == want


def test_clean_short_splits_and_squeezes(spark):
    assert one(spark, "HelloWorld soooo", X.clean_short) == "Hello World soo"
    assert len(one(spark, "ab " * 5000, X.clean_short)) == 4000


def test_script_needs_an_eighth(spark):
    assert one(spark, "a" * 14 + "бб", X.script_id) == 1
    assert one(spark, "a" * 15 + "бб", X.script_id) == 0
    assert one(spark, "", X.script_id) == 0


def test_char_wb_short_word(spark):
    assert one(spark, "ab", X.char_wb) == [" ab", "ab ", " ab "]
    assert one(spark, "", X.char_wb) == []


def test_number_ranges_and_ngrams(spark):
    assert one(spark, "0,3-5", X.number_ranges) == [0, 3, 4, 5]
    assert one(spark, "a b c", lambda c: X.word_ngrams(F.split(c, " "))) == ["a", "b", "c", "a b", "b c"]
    assert one(spark, "a", lambda c: X.word_ngrams(F.split(c, " "))) == ["a"]


def test_tokens_drop_stop_words(spark):
    assert one(spark, "The Cat's own e-mail at 9", X.tokens) == ["cat's", "e-mail"]


def test_wordpiece(spark):
    vocab = {p: i for i, p in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##able", "##a", "!"])}
    assert match("unable", vocab, 1) == [4, 5]
    assert match("unzip", vocab, 1) == [1]
    assert match("u" * 101, vocab, 1) == [1]
    pieces = spark.createDataFrame(list(vocab.items()), "piece string, piece_id int")
    df = spark.createDataFrame([(1, "Únable!"), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.ids for r in encode(df, ["id"], "text", pieces, 5).collect()}
    assert got == {1: [2, 4, 5, 7, 3], 2: [2, 3], 3: [2, 3]}
