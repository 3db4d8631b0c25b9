"""Every query with SQL against that SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["tokenize_v1", "vocab_ids", "pairs_deter_w2", "pairs_sub_dirty", "sppmi_norm", "sparse_most_similar", "cosadd", "eval_synonym", "build_synonym", "lint_pairs", "results_insert_ignore"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DIR)
    want = duck.execute(entry.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    rows = [dict(zip([c[0] for c in want.description], r)) for r in want.fetchall()]
    assert sorted(got.columns) == columns
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    key = lambda r: tuple(str(plain(r[c])) for c in columns)
    assert sorted(key(r.asDict()) for r in got.collect()) == sorted(key(r) for r in rows)
