"""Co-occurrence counts of a stream of encoded documents.

The distance counts of a batch are integers that add up, and so do the counts of its tokens, so a
running total needs no watermark: documents never span batches. Each batch writes its own tables
under its number; a batch that is repeated after a failure overwrites what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordloom.operators import cooc, vocab
from wordloom.operators.cooc import PairParams


def _check(params: PairParams) -> None:
    if params.subsample in ("prob", "dirty"):
        raise ValueError("random subsampling needs the token counts of the whole corpus before the first pair, which a stream doesn't have")


def count_stream(ids: DataFrame, size: int, params: PairParams, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start counting a streaming table (doc_id, ids) into `path`; trigger as in DataStreamWriter.trigger. Random subsampling raises."""
    _check(params)

    def add(batch: DataFrame, number: int) -> None:
        vocab.token_counts(batch).write.mode("overwrite").parquet(f"{path}/tokens/batch={number}")
        cooc.distances(batch, size, params).write.mode("overwrite").parquet(f"{path}/pairs/batch={number}")

    return ids.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def totals(spark: SparkSession, path: str, size: int, params: PairParams) -> DataFrame:
    """(w, c, n) of all batches so far: what count_pairs gives for all their documents together. params are those of count_stream, but that min_count, subsample and the weighting may differ."""
    _check(params)
    parts = spark.read.parquet(f"{path}/pairs").drop("batch")
    summed = parts.groupBy("w", "c").agg(*(F.sum(n).alias(n) for n in parts.columns if n not in ("w", "c")))
    tokens = spark.read.parquet(f"{path}/tokens").groupBy("id").agg(F.sum("n").alias("n"))
    return cooc.settle(summed, size, params, cooc.factors_of(tokens, params))
