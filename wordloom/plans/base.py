"""Shared pieces of the queries: token tables, vocabularies and count matrices of `documents`."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import cooc, ppmi, vocab
from wordloom.sources import shared

#: Up to this many rows a vocabulary is held by the driver, so that it is computed once.
DRIVER_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokens(spark: SparkSession, sf_dir: str, tokenizer: str = "v2-composed") -> DataFrame:
    return vocab.tokenize(documents(spark, sf_dir), tokenizer)


def texts(spark: SparkSession, sf_dir: str) -> vocab.Texts:
    """The corpus as `tokens` cuts it by default, for what counts or encodes it."""
    return vocab.Texts(documents(spark, sf_dir))


@dataclass(frozen=True)
class Encoded:
    """Encoded documents (doc_id, ids), their vocabulary (id, token, df, tf) and its size, which is the id of unknown tokens."""

    ids: DataFrame
    vocab: DataFrame
    size: int


def settled(frame: DataFrame, rows: int | None) -> tuple[DataFrame, int]:
    """A vocabulary that isn't computed again, and its size: held by the driver if `rows` bounds it, else written."""
    if rows is not None and rows <= DRIVER_ROWS:
        held = frame.toArrow()
        return frame.sparkSession.createDataFrame(held), held.num_rows
    frame = shared.save(frame, "vocab")
    return frame, frame.count()


def encode(toks: DataFrame | vocab.Texts, keep_n: int | None = 50_000, **options) -> Encoded:
    """The corpus and its vocabulary; the ids are written once."""
    words, size = settled(vocab.build(toks, keep_n=keep_n, **options), keep_n)
    return Encoded(shared.save(vocab.encode(toks, words, size), "ids"), words, size)


def cells(enc: Encoded, params: cooc.PairParams) -> DataFrame:
    """Counts, written once for the steps behind them."""
    return shared.save(cooc.count_pairs(enc.ids, enc.size, params), "cells")


def sppmi(enc: Encoded, params: cooc.PairParams, cds: float = ppmi.CDS, neg: float | None = 1, normalize: bool = True) -> DataFrame:
    found = ppmi.sppmi(ppmi.exp_pmi(cells(enc, params), enc.size, cds), neg)
    return ppmi.normalize(found) if normalize else found


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})
