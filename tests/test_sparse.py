"""The sparse search in small files and blocks against brute force, and what leaves its tasks."""

import numpy as np
import pytest

from wordloom.operators import search


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    m = np.where(rng.random((60, 60)) < np.linspace(0.5, 0.02, 60)[None, :], rng.integers(1, 4, (60, 60)), 0).astype(float)
    m[7] = m[30] = 0
    m[11] = m[12]
    return m, spark.createDataFrame([(i, j, float(m[i, j])) for i, j in zip(*(x.tolist() for x in m.nonzero()))], "w int, c int, x double").repartition(3)


@pytest.fixture(autouse=True)
def small(monkeypatch):
    for name, value in (("BLOCK_CELLS", 100), ("FILE_CELLS", 60), ("DENSE_CELLS", 150), ("SPARSE_TILE", 5)):
        monkeypatch.setattr(search, name, value, raising=False)


@pytest.mark.parametrize("sign", [1, -1])
@pytest.mark.parametrize("kind", ["add", "mul"])
def test_signed_queries(spark, table, kind, sign):
    m, t = table
    m, t = m * np.where(np.arange(60) % 4 == 0, sign, 1)[None, :], t.selectExpr("w", "c", f"IF(c % 4 = 0, {sign}D, 1D) * x AS x")
    parts = [(q, w, s) for q in range(60) for w, s in (((q + 1) % 60, 1), ((q + 2) % 60, 1), (q, -1))]
    asked = spark.createDataFrame(parts, "q int, word int, sign int")
    got = {(r.q, r["rank"]): (r.id, round(r.score, 6)) for r in (search.sparse_add if kind == "add" else search.sparse_mul)(t, asked, 6, 6).collect()}
    want, ids = {}, [i for i in range(60) if m[i].any()]
    for q in range(60):
        p, o, a = m[(q + 1) % 60], m[(q + 2) % 60], m[q]
        if kind == "add":
            s = p + o - a
            score = {i: m[i] @ s / np.linalg.norm(s) for i in ids if ((m[i] != 0) & ((p != 0) | (o != 0) | (a != 0))).any()}
        else:
            score = {i: (m[i] @ p) * (m[i] @ o) / (m[i] @ a + 0.01) for i in ids}
        for k, i in enumerate(sorted(score, key=lambda i: (-round(score[i], 6), i))[:6]):
            want[q, k + 1] = (i, pytest.approx(score[i], abs=2e-6))
    assert got == want


def test_no_block_is_sent_to_every_other(spark, table):
    _, t = table
    words = spark.createDataFrame([(w, w) for w in range(60)], "q int, word int")
    found = search.sparse_most_similar(t, words, 5, 6)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.lower()
    assert {r.q for r in found.where("rank = 1").collect()} == {w for w in range(60) if w not in (7, 30)}


def test_svd_products_go_row_by_row(spark):
    """Cells in any order, some given twice, more files than rows of a file; the plan of a product starts from a range of tasks, not from the cells."""
    from wordloom.operators import factor

    rng = np.random.default_rng(2)
    m = np.where(rng.random((50, 50)) < 0.3, rng.standard_normal((50, 50)), 0)
    rows = [(i, j, float(m[i, j]) / 2) for i, j in zip(*(x.tolist() for x in m.nonzero()))] * 2
    cells = factor.Cells(spark.createDataFrame(rows, "w int, c int, x double").repartition(5))
    q = rng.standard_normal((50, 7))
    assert factor._times(cells, q) == pytest.approx(m.T @ (m @ q))
    assert factor.gramian(cells, 50) == pytest.approx(m.T @ m)
    u = {r.w: r.u for r in factor._left(cells, q, np.ones(7)).collect()}
    assert np.array([u.get(i, [0] * 7) for i in range(50)]) == pytest.approx(m @ q)
