"""Registered queries take whole tables and the whole vocabulary: here one that is larger than any cut that they had."""

import pytest

import __spark_entry__ as entry

WORDS = 2600


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents of 100 words, none of them twice; two sources."""
    path = str(tmp_path_factory.mktemp("whole"))
    rows = [(d, " ".join(f"w{d * 100 + i}" for i in range(100)), "en", "ab"[d % 2], 1) for d in range(WORDS // 100)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def test_sparse_search_asks_for_every_word(spark, tables):
    rows = entry.queries()["sparse_most_similar"](spark, tables).where("rank = 1").collect()
    assert sorted(r.q for r in rows) == list(range(WORDS))
    assert all(r.score == pytest.approx(1) for r in rows)


def test_encoding_knows_every_word(spark, tables):
    ids = [r.id for r in entry.queries()["encode_unk"](spark, tables).collect()]
    assert sorted(ids) == list(range(WORDS))


def test_flagship_asks_for_every_word(spark, tables):
    found = entry.queries()["flagship_neighbours"](spark, tables).where("rank = 1")
    assert sorted(r.token for r in found.collect()) == sorted(f"w{i}" for i in range(WORDS))


def test_merged_vocabulary_has_every_word(spark, tables):
    rows = entry.queries()["vocab_merge"](spark, tables).collect()
    assert sorted((r.token, r.df, r.tf) for r in rows) == sorted((f"w{i}", 1, 1) for i in range(WORDS))


def test_every_word_is_represented(spark, tables):
    found = entry.queries()["sparse_represent"](spark, tables)
    assert found.columns == ["w", "c", "x"]
    assert sorted(r.w for r in found.select("w").distinct().collect()) == list(range(WORDS))
