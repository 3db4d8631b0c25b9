"""Corpora from files and tables, as (doc_id, text)."""

from __future__ import annotations

import random
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What ends a line beside \n, \r and both.
LINE_ENDS = "\\r\\n|[\\n\\r\\x0B\\f\\x1c\\x1d\\x1e\\u0085\\u2028\\u2029]"


def split_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, text): the lines of each text by any of the line ends; a final line end opens no line, an empty text has none."""
    parts = F.split(F.col(text), LINE_ENDS, -1)
    lines = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(lines).alias("line_no", "text"))


def split_newlines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, text): the parts between line feeds, empty ones included."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "text"))


def _placed(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, path, size, block, at, value) of all parts between line feeds; `at` rises inside a block of a file. A large file is read by many tasks."""
    lines = spark.read.text(path, lineSep="\n", **({"pathGlobFilter": glob} if glob else {}))
    where = {"file": "file_name", "path": "file_path", "size": "file_size", "block": "file_block_start"}
    placed = lines.select(*(F.col(f"_metadata.{m}").alias(n) for n, m in where.items()), F.monotonically_increasing_id().alias("at"), "value")
    # names are percent-encoded here
    return placed.withColumn("file", F.expr("url_decode(replace(file, '+', '%2B'))"))


def _number(lines: DataFrame, *order: str) -> DataFrame:
    """lines with line_no: numbers from 0 in each file, from those inside each block and a running sum over the blocks."""
    sizes = lines.groupBy("path", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("path", "block").orderBy(*order)) - 1
    return lines.withColumn("inside", inside).join(starts, ["path", "block"]).withColumn("line_no", (F.col("start") + F.col("inside")).cast("int"))


def from_file(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One document a line of one file, numbered in file order, lines ending as in split_lines; `limit` keeps the first ones."""
    parts = F.split(F.concat("value", F.lit("\n")), LINE_ENDS, -1)
    lines = _placed(spark, path).select("path", "block", "at", F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("part", "text"))
    numbered_ = _number(lines, "at", "part").select(F.col("line_no").cast("long").alias("doc_id"), "text")
    return numbered_ if limit is None else numbered_.where(F.col("doc_id") < limit)


def from_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document a line of any number of large files, split by \\n, \\r\\n or \\r and read in parallel; ids rise with file and place but have gaps."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))


def from_sents(spark: SparkSession, texts: Iterable[str]) -> DataFrame:
    """One document for each string."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


from_texts = from_sents


def from_text_files(spark: SparkSession, base_dir: str, view_fraction: float = 1.0, seed: int = 1312, portable: bool = True) -> DataFrame:
    """(file, line_no, text, in_vocab) of all *.txt files in a folder, in name order, cut at line feeds (a final one makes an empty last line).

    in_vocab says whether the file counts for the vocabulary; see sample_files.
    """
    lines = _placed(spark, base_dir, "*.txt")
    # a file whose parts and line feeds add up to its size ends in a line feed
    ended = lines.groupBy("file", "path").agg(F.max("block").alias("block"), F.max("at").alias("at"), (F.sum(F.octet_length("value") + 1) == F.first("size")).alias("ended"))
    tails = ended.where("ended").select("file", "path", "block", (F.col("at") + 1).alias("at"), F.lit("").alias("value"))
    numbered_ = _number(lines.select(*tails.columns).unionByName(tails), "at")
    taken = ended.select("file", "path").distinct().withColumn("in_vocab", sample_files("file", view_fraction, seed, portable))
    return numbered_.join(taken.select("path", "in_vocab"), "path").select("file", "line_no", F.col("value").alias("text"), "in_vocab")


def sample_files(file: str, view_fraction: float, seed: int = 1312, portable: bool = True):
    """Whether a file is taken: a draw on the seed and its name is at most view_fraction. portable=False draws as random.Random does on "seed-name"."""
    if view_fraction >= 0.999:
        return F.lit(True)
    if portable:
        number = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(file))), 1, 8), 16, 10).cast("long")
        return number / F.lit(float(2**32)) <= F.lit(view_fraction)

    @F.pandas_udf("boolean")
    def taken(names: pd.Series) -> pd.Series:
        return names.map(lambda name: random.Random(f"{seed}-{name}").random() <= view_fraction)

    return taken(F.col(file))


def numbered(lines: DataFrame) -> DataFrame:
    """(doc_id, file, text, in_vocab) of (file, line_no, text, in_vocab): ids by file name and line.

    Ids come from the lines of each file and a running sum over the files, so no line is moved.
    """
    sizes = lines.groupBy("file").agg((F.max("line_no") + 1).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return lines.join(starts, "file").select((F.col("start") + F.col("line_no")).alias("doc_id"), "file", "text", "in_vocab")
