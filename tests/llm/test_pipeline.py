import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wordloom.llm import minhash, quality_rules

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def test_stages_chain(spark, tmp_path):
    docs = start = spark.read.parquet(f"{DIR}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / str(k)))
        kept = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert kept.columns == start.columns and kept.count() <= docs.count()
        if k == 0:
            con = duckdb.connect()
            for t in ("documents", "labels"):
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
            assert sorted(x.doc_id for x in kept.collect()) == sorted(x[0] for x in con.execute(quality_rules.ORACLE).fetchall())
        if k == 2:
            gone = {x.doc_id for x in minhash.near_duplicates(spark, docs).collect()}
            assert {x.doc_id for x in kept.collect()} == {x.doc_id for x in docs.collect()} - gone
        docs = kept
    want = {tuple(x) for x in docs.collect()}
    assert {tuple(x) for x in corpus_pipeline.run(spark, DIR).collect()} == want


def test_marked_words_on_labels_that_were_not_learned_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    taught = 2000
    words = quality_rules.learn(docs, labels, taught)
    order = sorted((r for r in labels.collect() if r.toxic is not None), key=lambda r: (hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id))
    held = docs.join(labels.where(F.col("doc_id").isin([r.doc_id for r in order[taught:]])).select("doc_id", "toxic"), "doc_id").where("text IS NOT NULL").select("text", "toxic").toArrow()
    hit = quality_rules.marked_words(words).test(quality_rules.Texts(held["text"].combine_chunks()))
    toxic = held["toxic"].to_numpy() > 0
    assert hit[toxic].mean() >= 0.85 and hit[~toxic].mean() <= 0.005
