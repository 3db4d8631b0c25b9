"""Tokens and pair counts of whole columns: the same as from rows, and nothing that grows with pairs of positions leaves a worker."""

import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.operators import cooc, vocab
from wordloom.operators.cooc import PairParams

TEXTS = [
    "a-b--c d'e' -f g- 'h", "don’t re‐enter ice‑cream", "x", "", None, "   ", "ΟΔΥΣΣΕΥΣ και ΣΑΣ", "İstanbul a-İ", "Ünïcode café Straße-Ärger ÉCOLE", "日本語 text 😀-x ١٢٣ Ⅻ",
    "trailing-", "-leading", "under_score 3.50 a\nb\r\nc", "Ǆ ǅ ﬁ ﬀ", "a‍b x­z", "B A b a B", "end'",
] * 3


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(TEXTS)], "doc_id long, text string, file string").repartition(3)


def test_column_tokens_are_those_of_the_expression(spark, docs):
    toks, texts = vocab.tokenize(docs, "v2-composed"), vocab.Texts(docs)
    every = sorted({w for r in toks.collect() for w in r.tokens})
    words = spark.createDataFrame([(w, i) for i, w in enumerate(every[::2])], "token string, id int")
    one, two = ({r.doc_id: r.ids for r in vocab.encode(t, words, len(every)).collect()} for t in (toks, texts))
    assert one == two and len(one) > 30
    for by, a in (((), toks), (("file",), docs.select("file", "doc_id", X.composed_tokens_v2(F.col("text")).alias("tokens")))):
        assert sorted(map(tuple, vocab.token_stats(a, *by).collect())) == sorted(map(tuple, vocab.token_stats(texts, *by).collect()))


@pytest.mark.parametrize("mode", ["deter", "prob"])
def test_pairs_are_summed_up_in_workers(spark, monkeypatch, mode):
    monkeypatch.setattr(cooc, "RANGE_PAIRS", 64)
    monkeypatch.setattr(cooc, "HELD_PAIRS", 500)
    rows = [(d, [(d * i * i + i) % 7 if d % 3 else 1 for i in range(60)]) for d in range(40)]
    ids = spark.createDataFrame(rows, "doc_id long, ids array<int>").coalesce(1)
    params = PairParams(window=3, dynamic_window=mode, subsample=None)
    got = cooc.count_pairs(ids, 6, params)
    found = {(r.w, r.c): r.n for r in got.collect()}
    monkeypatch.setattr(cooc, "BROADCAST_ROWS", 0)  # by rows
    assert found == pytest.approx({(r.w, r.c): r.n for r in cooc.count_pairs(ids, 6, params).collect()})
    assert found[1, 1] > 255
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "MapInArrow" in plan
