"""Vocabulary: frequencies, ranked cut, ids, encoding.

Input tables are (doc_id, tokens) with one row a sentence or document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions import words as W
from wordloom.functions.text import Tokenizer, composed_tokens_v2, tokenizer

#: Largest vocabulary that is sent to every executor; beyond it the joins shuffle.
BROADCAST_ROWS = 2_000_000


@dataclass(frozen=True)
class Texts:
    """Documents (doc_id, text, ...) that stand for their tokens by composed_tokens_v2: these are cut in Python workers, whole columns at once, and never become rows."""

    docs: DataFrame

    def cut(self, *columns: str) -> tuple[DataFrame, W.Alphabet]:
        """(*columns, text, lists): texts that the JVM must cut are null, and their tokens in `lists`."""
        letters = W.alphabet(self.docs.sparkSession)
        odd, text = W.is_odd(F.col("text"), letters), F.col("text")
        return self.docs.select(*columns, F.when(odd, F.lit(None)).otherwise(text).alias("text"), F.when(odd, composed_tokens_v2(text)).alias("lists")), letters


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df as a broadcast side if its known number of rows allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as the cluster has slots; a file of one row group is a single task otherwise."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= wanted:
        return df
    return df.repartition(wanted)


def tokens_of(text: str, choice: str | Tokenizer = "v2") -> Column:
    """The tokens of a column; of null none."""
    return F.coalesce(tokenizer(choice)(F.col(text)), F.array().cast("array<string>"))


def tokenize(docs: DataFrame, choice: str | Tokenizer = "v2", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens); a null text has no tokens."""
    return docs.select(F.col(doc_id).alias("doc_id"), tokens_of(text, choice).alias("tokens"))


def _text_stats(texts: Texts, *by: str) -> DataFrame:
    """token_stats of texts: each batch of documents is summed up where it is cut."""
    docs, letters = texts.cut(*by, "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, sizes = W.with_cut(*W.split(batch.column("text"), sent.value), batch.column("lists"))
            coded = tokens.dictionary_encode()
            code, row = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
            groups = pa.array(np.zeros(len(sizes), np.int8)).dictionary_encode()
            if by:
                groups = pa.StructArray.from_arrays([batch.column(c) for c in by], names=list(by)) if len(by) > 1 else batch.column(by[0])
                groups = groups.dictionary_encode("encode")
            words, rows = max(1, len(coded.dictionary)), max(1, len(sizes))
            at = (groups.indices.to_numpy().astype(np.int64)[row] * words + code) * rows + row
            at.sort()
            cell, row = at // rows, at % rows
            heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(at) else np.zeros(0, np.int64)
            tf = np.diff(np.append(heads, len(at)))
            new = np.concatenate([[1], at[1:] != at[:-1]]).astype(np.int64)[: len(at)]
            ids = batch.column("doc_id").to_numpy()[row]
            df, first = (np.add.reduceat(new, heads), np.minimum.reduceat(ids, heads)) if len(heads) else (new, ids)
            cells = cell[heads]
            keys = groups.dictionary.take(pa.array(cells // words)) if by else None
            keys = ([keys.field(c) for c in range(len(by))] if len(by) > 1 else [keys]) if by else []
            yield pa.RecordBatch.from_arrays([*keys, coded.dictionary.take(pa.array(cells % words)), pa.array(df), pa.array(tf.astype(np.int64)), pa.array(first.astype(np.int64))], names=[*by, "token", "df", "tf", "first_doc"])

    kinds = [docs.schema[c] for c in by] + [T.StructField("token", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("df", "tf", "first_doc"))]
    return docs.mapInArrow(run, T.StructType(kinds)).groupBy(*by, "token").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"), F.min("first_doc").alias("first_doc"))


def token_stats(tokens: DataFrame | Texts, *by: str) -> DataFrame:
    """(*by, token, df, tf, first_doc): documents with the token, its occurrences and the first document, for each value of the columns `by`.

    Sorting the tokens inside their row marks the first of each, so one aggregation with partial
    sums does for both counts.
    """
    if isinstance(tokens, Texts):
        return _text_stats(tokens, *by)
    sorted_ = tokens.select(*by, "doc_id", F.array_sort("tokens").alias("t"))
    marked = sorted_.select(*by, "doc_id", F.explode(F.expr("transform(t, (x, i) -> struct(x AS token, IF(i = 0 OR x <> t[greatest(i - 1, 0)], 1L, 0L) AS new))")).alias("x"))
    return marked.groupBy(*by, F.col("x.token").alias("token")).agg(F.sum("x.new").alias("df"), F.count("*").alias("tf"), F.min("doc_id").alias("first_doc"))


def cut(stats: DataFrame, num_docs: int, no_below: int = 0, no_above: float = 1.0, keep_n: int | None = 50_000, keep_tokens: Sequence[str] = ()) -> DataFrame:
    """The rows of stats with no_below <= df <= no_above * num_docs or in keep_tokens; of these the keep_n of the highest df, ties by first document and token.

    Kept tokens rank as if every document had them.
    """
    kept: Column = F.col("token").isin(list(keep_tokens)) if keep_tokens else F.lit(False)
    most = int(no_above * num_docs)
    fits = stats.where(((F.col("df") >= no_below) & (F.col("df") <= most)) | kept)
    if keep_n is None:
        return fits
    rank = F.when(kept, F.lit(num_docs)).otherwise(F.col("df"))
    return fits.orderBy(rank.desc(), "first_doc", "token").limit(keep_n)


def assign_ids(stats: DataFrame) -> DataFrame:
    """(id, token, df, tf): ids from 0 by first document, then token. The window is global over a vocabulary that has been cut."""
    order = Window.orderBy("first_doc", "token")
    return stats.select((F.row_number().over(order) - 1).alias("id"), "token", "df", "tf")


def build(tokens: DataFrame | Texts, no_below: int = 0, no_above: float = 1.0, keep_n: int | None = 50_000, keep_tokens: Sequence[str] = (), num_docs: int | None = None) -> DataFrame:
    """The vocabulary (id, token, df, tf) of tokens."""
    if num_docs is None:
        num_docs = (tokens.docs if isinstance(tokens, Texts) else tokens).count() if no_above < 1 or keep_tokens else (1 << 62)
    return assign_ids(cut(token_stats(tokens), num_docs, no_below, no_above, keep_n, keep_tokens))


def merge(stats: DataFrame, per_file: int | None = None) -> DataFrame:
    """Statistics of several files (file, token, df, tf, first_doc) as one; per_file keeps each file's most frequent tokens only."""
    if per_file is not None:
        order = Window.partitionBy("file").orderBy(F.col("df").desc(), "first_doc", "token")
        stats = stats.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_file)
    return stats.groupBy("token").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"), F.min(F.struct("file", "first_doc")).alias("first")).select(
        "token", "df", "tf", F.col("first.file").alias("file"), F.col("first.first_doc").alias("first_doc")
    )


def encode(tokens: DataFrame | Texts, vocab: DataFrame, size: int) -> DataFrame:
    """(doc_id, ids) of documents with tokens; tokens that aren't in the vocabulary have the id `size`.

    A vocabulary of up to BROADCAST_ROWS words is sent to the executors and looked up inside each
    row, so nothing is shuffled; beyond that each token meets its word in a join.
    """
    texts, tokens = tokens if isinstance(tokens, Texts) else None, tokens.docs if isinstance(tokens, Texts) else tokens
    if texts and size > BROADCAST_ROWS:
        texts, tokens = None, tokenize(tokens, "v2-composed")
    some = tokens.where(F.size("tokens") > 0) if texts is None else None
    if size > BROADCAST_ROWS:
        long = some.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.posexplode("tokens").alias("pos", "token"))
        found = long.join(vocab.select("token", "id"), "token", "left").select("row", "doc_id", "pos", F.coalesce("id", F.lit(size)).cast("int").alias("id"))
        ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
        return found.groupBy("row", "doc_id").agg(ids.alias("ids")).drop("row")
    known = vocab.select("token", "id").toArrow()
    shared = tokens.sparkSession.sparkContext.broadcast((known["token"].combine_chunks().cast(pa.string()), known["id"].combine_chunks().cast(pa.int32())))

    letters = None
    if texts:
        some, alphabet = texts.cut("doc_id")
        letters = tokens.sparkSession.sparkContext.broadcast(alphabet)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, numbers = shared.value
        words, numbers = pa.concat_arrays([words, pa.array([None], words.type)]), pa.concat_arrays([numbers, pa.array([size], numbers.type)])
        for batch in batches:
            if letters:
                found, counts = W.with_cut(*W.split(batch.column("text"), letters.value), batch.column("lists"))
            else:
                found, counts = batch.column(1).flatten().cast(words.type), pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            at = pa.compute.fill_null(pa.compute.index_in(found, value_set=words[: len(words) - 1]), len(words) - 1)
            offsets = np.zeros(len(counts) + 1, np.int32)
            np.cumsum(counts, out=offsets[1:])
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), numbers.take(at))], names=["doc_id", "ids"])
            yield out.filter(pa.array(counts > 0)) if letters else out

    schema = T.StructType([T.StructField("doc_id", tokens.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return (some if letters else some.select("doc_id", "tokens")).mapInArrow(run, schema)


def encode_long(tokens: DataFrame | Texts, vocab: DataFrame, size: int) -> DataFrame:
    """(doc_id, pos, id); see encode."""
    return encode(tokens, vocab, size).select("doc_id", F.posexplode("ids").alias("pos", "id"))


def token_counts(ids: DataFrame) -> DataFrame:
    """(id, n) over encoded documents, unknown tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n.astype(np.int64))], names=["id", "n"])

    return ids.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def corpus_size(tokens: DataFrame) -> DataFrame:
    """One row (documents, tokens); documents without tokens count."""
    return tokens.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("long").alias("tokens"))
