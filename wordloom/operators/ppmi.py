"""Pointwise mutual information of co-occurrence counts, as sparse tables (w, c, value)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.operators.vocab import bounded

CDS = 0.75


def marginals(cells: DataFrame, cds: float = CDS) -> tuple[DataFrame, DataFrame]:
    """(w, sum_w) and (c, sum_c): sums of rows, and of columns raised to the power cds."""
    rows = cells.groupBy("w").agg(F.sum("n").alias("sum_w"))
    columns = cells.groupBy("c").agg(F.sum("n").alias("sum_c"))
    return rows, columns.withColumn("sum_c", F.pow("sum_c", F.lit(cds))) if cds != 1 else columns


def exp_pmi(cells: DataFrame, size: int, cds: float = CDS) -> DataFrame:
    """(w, c, epmi): n * total / (sum_w * sum_c**cds), total being that of the smoothed column sums; 0 where a sum isn't positive."""
    rows, columns = marginals(cells, cds)
    total = F.broadcast(columns.agg(F.sum("sum_c").alias("total")))
    joined = cells.join(bounded(rows, size + 1), "w").join(bounded(columns, size + 1), "c").crossJoin(total)
    inverse_w = F.when(F.col("sum_w") > 0, 1 / F.col("sum_w")).otherwise(0.0)
    inverse_c = F.when(F.col("sum_c") > 0, 1 / F.col("sum_c")).otherwise(0.0)
    return joined.select("w", "c", (F.col("n") * inverse_w * inverse_c * F.col("total")).alias("epmi"))


def sppmi(epmi: DataFrame, neg: float | None = 1) -> DataFrame:
    """(w, c, x): ln(epmi) - ln(neg) where positive; None means no shift."""
    shift = math.log(neg) if neg is not None else 0.0
    return epmi.where("epmi > 0").select("w", "c", (F.ln("epmi") - F.lit(shift)).alias("x")).where("x > 0")


def normalize(matrix: DataFrame) -> DataFrame:
    """Rows of unit length; absent rows stay absent."""
    row = Window.partitionBy("w")
    return matrix.select("w", "c", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(row))).alias("x"))


def represent(matrix: DataFrame, w: int) -> DataFrame:
    """(c, x) of one row."""
    return matrix.where(F.col("w") == w).select("c", "x")


def similarity(matrix: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with their similarity: the inner product of both rows, 0 if they share no column.

    Only the rows that are asked for are joined.
    """
    wanted = pairs.select("a", "b").distinct()
    left = wanted.join(matrix.select(F.col("w").alias("a"), "c", F.col("x").alias("x1")), "a")
    both = left.join(matrix.select(F.col("w").alias("b"), "c", F.col("x").alias("x2")), ["b", "c"])
    found = both.groupBy("a", "b").agg(F.sum(F.col("x1") * F.col("x2")).alias("s"))
    return pairs.join(found, ["a", "b"], "left").withColumn("similarity", F.coalesce("s", F.lit(0.0))).drop("s")
