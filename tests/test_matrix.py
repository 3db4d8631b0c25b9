import math

import numpy as np
import pytest

from wordloom.operators import factor, ppmi, search


def coo(spark, m, name="n"):
    m = np.asarray(m, float)
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1]) if m[i, j]], f"w int, c int, {name} double")


def test_exp_pmi(spark):
    got = {(r.w, r.c): r.epmi for r in ppmi.exp_pmi(coo(spark, [[1, 2, 0], [0, 1, 1], [3, 0, 1]]), 2, 1).collect()}
    assert got == pytest.approx({(0, 0): 9 / 12, (0, 1): 2, (1, 1): 1.5, (1, 2): 2.25, (2, 0): 27 / 16, (2, 2): 9 / 8})


def test_sppmi_rows_are_units(spark):
    x = ppmi.normalize(ppmi.sppmi(ppmi.exp_pmi(coo(spark, [[1, 2, 0], [0, 1, 1], [3, 0, 1]]), 2, 1), None))
    by = {}
    for r in x.collect():
        by.setdefault(r.w, []).append(r.x)
    assert all(math.isclose(sum(v * v for v in row), 1) for row in by.values())
    pairs = spark.createDataFrame([(0, 1), (1, 0), (0, 2)], "a int, b int")
    got = {(r.a, r.b): r.similarity for r in ppmi.similarity(x, pairs).collect()}
    assert got[0, 1] == pytest.approx(got[1, 0]) and got[0, 2] == 0


@pytest.mark.parametrize("impl", ["scipy", "scikit", "gensim"])
def test_svd_of_a_diagonal(spark, impl):
    f = factor.svd(coo(spark, np.diag([6.0, 5, 4, 3, 2, 1]), "x"), 6, 3, impl)
    assert f.s == pytest.approx([6, 5, 4], rel=1e-3)
    u = {r.w: r.u for r in f.u.collect()}
    assert abs(u[0][0]) == pytest.approx(1, abs=1e-3)


def test_svd_drops_noise_and_rejects_nothing(spark):
    rng = np.random.default_rng(0)
    low = rng.standard_normal((40, 5)) @ rng.standard_normal((5, 40))
    f = factor.svd(coo(spark, low, "x"), 40, 39)
    assert len(f.s) == 5
    assert f.s == pytest.approx(np.linalg.svd(low)[1][:5])
    with pytest.raises(ValueError):
        factor.svd(coo(spark, np.zeros((3, 3)), "x"), 3, 2)
    e = {r.id: r.vec for r in factor.embed(f, 0.5, add_context=True).collect()}
    assert all(np.linalg.norm(v) == pytest.approx(1) for v in e.values())


def test_svd_of_a_flat_spectrum_beyond_the_exact_columns(spark, monkeypatch):
    flat = coo(spark, np.diag(np.linspace(1, 0.99, 300)), "x")
    exact = factor.svd(flat, 300, 20)
    monkeypatch.setattr(factor, "EXACT_COLUMNS", 10)
    f = factor.svd(flat, 300, 20)
    assert f.s == pytest.approx(exact.s, rel=1e-7)
    assert np.abs(np.sum(f.v * exact.v, axis=0)) == pytest.approx(np.ones(20), abs=1e-5)
    with pytest.raises(ArithmeticError):
        factor.svd(flat, 300, 20, n_iter=1)


ROWS = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.95, 0.10, 0.0, 0.2958], [0.50, 0.50, 0.0, 0.7071]]


@pytest.mark.parametrize("dense", [True, False])
def test_add_and_mul_differ(spark, dense):
    table = spark.createDataFrame(list(enumerate(ROWS)), "id int, vec array<double>") if dense else coo(spark, ROWS, "x")
    asked = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 2, -1)], "q int, word int, sign int")
    for objective, best in (("add", 3), ("mul", 4)):
        found = search.most_similar_vectors(table, asked, 5, objective, 4)
        others = [r.id for r in found.orderBy("rank").collect() if r.id > 2]
        assert others[0] == best
    with pytest.raises(ValueError):
        search.most_similar_vectors(table, asked, 5, "x", 4)


def test_blocked_search_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_CELLS", 60)
    rng = np.random.default_rng(4)
    m = np.where(rng.random((40, 40)) < 0.2, rng.integers(-3, 4, (40, 40)), 0)  # whole numbers, so that many tie
    m[7] = 0
    table = coo(spark, m, "x")
    words = spark.createDataFrame([(w, w) for w in range(40)], "q int, word int")
    got = {(r.q, r["rank"]): (r.id, r.score) for r in search.sparse_most_similar(table, words, 5, 6).collect()}
    want = {}
    for q in range(40):
        shared = [i for i in range(40) if ((m[q] != 0) & (m[i] != 0)).any()]
        for rank, i in enumerate(sorted(shared, key=lambda i: (-(m[q] @ m[i]), -i))[:5]):
            want[q, rank + 1] = (i, float(m[q] @ m[i]))
    assert got == want
