"""The dense search in small pieces against brute force; its queries never make rows of pairs."""

import numpy as np
import pytest

from wordloom.operators import evaluate, search
from wordloom.operators.evaluate import Embedding
from wordloom.sources import gold


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (120, 4)).astype(float)  # many are equal
    v[np.abs(v).sum(axis=1) == 0, 0] = 1
    v = np.round(v / np.linalg.norm(v, axis=1, keepdims=True), 3)
    return v, spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "id int, vec array<double>").repartition(3)


@pytest.fixture(autouse=True)
def small(monkeypatch):
    for name, value in (("READ_ROWS", 50), ("TILE_ROWS", 16)):
        monkeypatch.setattr(search, name, value, raising=False)


def best(score, n, drop=None, high=False):
    order = sorted((i for i in range(len(score)) if i != drop), key=lambda i: (-round(score[i], 6), -i if high else i))
    return order[:n]


@pytest.mark.parametrize("self_", [True, False])
def test_most_similar(spark, vectors, self_):
    v, table = vectors
    asked = table.selectExpr("id AS q", "vec AS qvec")
    got = {(r.q, r["rank"]): r.id for r in search.dense_most_similar(table, asked, 5, 4, include_self=self_, digits=6).collect()}
    want = {(q, k + 1): i for q in range(len(v)) for k, i in enumerate(best(v @ v[q], 5, None if self_ else q, self_))}
    assert got == want
    found = search.dense_best(table, asked.selectExpr("q", "1 AS sign", "qvec"), 1, 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" not in plan and "explode" not in plan  # no block is sent to every other


def test_products_of_several_parts(spark, vectors):
    v, table = vectors
    parts = [(q, (q * k + k) % 120, s) for q in range(120) for k, s in [(3, 1), (7, -1), (11, 1), (5, -1)][: 1 + q % 4]]
    asked = spark.createDataFrame(parts, "q int, word int, sign int")
    got = {(r.q, r["rank"]): r.id for r in search.dense_mul(table, asked, 4, 3, digits=6).collect()}
    want = {}
    for q in range(120):
        score = np.ones(120)
        low = np.ones(120)
        for _, w, s in (p for p in parts if p[0] == q):
            side = score if s > 0 else low
            side *= (v @ v[w] + 1) / 2
        want |= {(q, k + 1): i for k, i in enumerate(best(score / (low + 0.01), 3))}
    assert got == want


def test_categories_without_rows_of_pairs(spark, vectors):
    v, table = vectors
    rows = [(n, o, 10 * i + o, f"w{(i * 7) % 125}", f"c{i % 3}") for n, o, k in (("a", 0, 125), ("b", 1, 40)) for i in range(k)]
    words = spark.createDataFrame([(i, f"w{i}") for i in range(125)], "id int, token string")  # the last five have no vector
    report = evaluate.eval_categories(Embedding(table, 4, 6), spark.createDataFrame(rows, gold.SCHEMAS["category"]), words)
    full = np.vstack([v, np.zeros((5, 4))])
    for r in report.collect():
        own = [((i * 7) % 125, i % 3) for i in range(125 if r.name == "a" else 40)]
        near = [best([round(float(full[w] @ full[x]), 6) for x, _ in own], 1, drop=i)[0] for i, (w, _) in enumerate(own)]
        assert r.score == pytest.approx(np.mean([own[i][1] == own[j][1] for i, j in enumerate(near)]))
    assert "MapInArrow" in report._jdf.queryExecution().optimizedPlan().toString()
