import unicodedata

import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as X


def run(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t")).alias("x")).collect()]


def test_lower_digits(spark):
    assert run(spark, X.lower_digits, "Wikipedia 2001") == ["wikipedia 0000"]


def test_tokens_v1(spark):
    got = run(spark, X.tokens_v1, "<b>Ice-cream</b>, 42!", "city's president", "3.50 dollars", "co_op under_score", "foo#bar%baz@qux", "", None)
    assert got == [["ice", "cream", "00"], ["city", "s", "president"], ["0", "00", "dollars"], ["co_op", "under_score"], ["foo", "bar", "baz", "qux"], [], None]


def test_tokens_v2(spark):
    got = run(spark, X.tokens_v2, "City's", "City’s well‑known", unicodedata.normalize("NFD", "café"), "2001", "U.S.A.", "word.Next sentence")
    assert got == [["city's"], ["city's", "well-known"], ["café"], ["2001"], ["u", "s", "a"], ["word", "next", "sentence"]]
    assert run(spark, lambda c: X.tokens_v2(c, lower=False), "Ab") == [["Ab"]]
    assert run(spark, lambda c: X.tokens_v2(c, normalize_digits=True), "2001") == [["0000"]]


def test_to_item(spark):
    assert run(spark, lambda c: X.to_item(X.composed_tokens_v2(c)), "w", "", "a b", None) == ["w", None, None, None]


def test_sentences(spark):
    assert run(spark, X.sentence_tokens, "The cat sat. Dogs <b>run</b>!\nNo") == [[["cat", "sat"], ["dogs", "run"], []]]


def test_unknown_tokenizer():
    with pytest.raises(ValueError):
        X.tokenizer("v9")
