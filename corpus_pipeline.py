"""A corpus from raw documents to packed training windows, in five stages.

quality rules -> line dedup -> near-duplicate dedup -> repeated-passage dedup -> packing. Each
stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that its predecessor kept;
all but the last return the columns of `documents`. `run` writes each stage's rows to the shared
folder and reads them again, so a lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import line_dedup, minhash, packing, quality_rules, suffix_dedup
from wordloom.llm._store import Workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_quality(docs, quality_rules.rules_of(spark, sf_dir))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows."""
    return line_dedup.dedup_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.drop_near_duplicates(spark, docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of passages of fifty words or more."""
    return suffix_dedup.remove_repeats(spark, docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes among the training windows."""
    return packing.pack(spark, docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near), ("repeated passages", passages), ("packing", windows)]

#: SQL can't express SuperMinHash and best-fit packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
