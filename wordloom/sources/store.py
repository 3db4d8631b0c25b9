"""Tables and vectors on any file system that Spark reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "<UNK>"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to the end; one that wasn't counts as absent."""
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def write(df: DataFrame, path: str, partitions: int | None = None, by: str | None = None) -> DataFrame:
    """Write df as Parquet in one commit and return the written table; `by` range-partitions it, so that filters on that column skip files."""
    if by:
        df = df.repartitionByRange(partitions, by).sortWithinPartitions(by) if partitions else df.repartitionByRange(by).sortWithinPartitions(by)
    elif partitions:
        df = df.repartition(partitions)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def keyed_vectors(vectors: DataFrame, vocab: DataFrame, delete_unknown: bool = True) -> DataFrame:
    """(token, vec) of (id, vec); the unknown token's row is left out or named <UNK>."""
    named = vectors.join(vocab.select("id", "token"), "id", "inner" if delete_unknown else "left")
    return named.select(F.coalesce("token", F.lit(UNKNOWN)).alias("token"), F.col("vec").cast("array<float>").alias("vec"))


def write_word2vec(keyed: DataFrame, path: str) -> None:
    """Text lines `token x1 x2 ...` in parallel files, without a header."""
    line = F.concat_ws(" ", "token", F.array_join(F.col("vec").cast("array<string>"), " "))
    keyed.select(line.alias("value")).write.mode("overwrite").text(path)
