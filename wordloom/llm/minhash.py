"""Operator 8: near duplicates by SuperMinHash signatures, banding, verification and union-find.

Signature (Ertl's SuperMinHash): each element of a document's set (its runs of `shingle` words,
or its words in a shorter text) draws a random permutation of the m slots and a uniform number
for each rank; slot p_j gets min(u_j + j) over the elements. Ranks are tried in rising order and
a document stops as soon as no later rank can lower any of its slots, so a long document needs
about one draw an element. Slots of two documents agree with probability equal to the Jaccard
similarity of their sets, and with less variance than independent hashes.

Banding: documents that agree in all rows of one band are candidates. In each such bucket the
documents are compared by their whole signatures (verification: the share of equal slots is at
least `threshold`), breadth first from the smallest id: a document that is already reached
needs no further comparison, so a bucket of thousands of copies takes one comparison each, and
no pair that could join two parts is left out. A bucket of more than `block` documents is cut into
parts, every two of which are compared in a task of their own, so a task's memory is bounded. The groups are the connected components of all
verified pairs, found by union-find inside partitions and by rounds of star contraction across
them. The smallest doc_id of a group is the one that stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm._store import Workspace
from wordloom.llm._text import Words, chunks, mix, release, run_hashes, text_buffers

SLOTS = 128
BANDS = 32
SHINGLE = 3
THRESHOLD = 0.55
SEED = 1
#: Documents of a bucket that are compared in one task; a task holds two such parts.
BLOCK = 16384

_U64 = np.uint64


def element_sets(words: Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, element) pairs: hashes of the runs of `shingle` words; of a shorter text, of all its words together."""
    first, gram = words.grams(shingle)
    row = words.row[first]
    short = np.flatnonzero((words.counts > 0) & (words.counts < shingle))
    if len(short):
        whole = run_hashes(words.hashes, words.bounds[short], words.bounds[short + 1])
        row, gram = np.concatenate([row, short]), np.concatenate([gram, whole])
        order = np.argsort(row, kind="stable")
        row, gram = row[order], gram[order]
    return row, gram


def superminhash(row: np.ndarray, element: np.ndarray, n: int, slots: int = SLOTS, seed: int = SEED) -> np.ndarray:
    """Signatures (n x slots, 16 bits a slot) of the sets {element[i] : row[i] = r}; row rises, rows without elements keep the top value.

    Level j holds the draws of rank j of all elements of the documents that are not finished.
    A draw is kept as a 64-bit number: the rank in the upper bits, the uniform part below.
    """
    if slots > 256:
        raise ValueError("at most 256 slots")
    none = _U64(0xFFFFFFFFFFFFFFFF)
    best = np.full(n * slots, none, dtype=_U64)
    base = mix(element ^ _U64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    active, perm = np.arange(len(row)), None
    for level in range(slots):
        if not len(active):
            break
        if perm is None and level:
            # redo the first swap for those that go on; their permutations are now needed in full
            perm = np.tile(np.arange(slots, dtype=np.uint8), (len(active), 1))
            place = np.arange(len(active))
            k = (first_pick[active]).astype(np.int64)
            perm[place, k] = 0
            perm[place, 0] = k
        draw = mix(base[active] + _U64((0xD1342543DE82EF95 * (2 * level + 1)) & 0xFFFFFFFFFFFFFFFF))
        pick = level + ((draw >> _U64(40)) * _U64(slots - level) >> _U64(24)).astype(np.int64)
        if level == 0:
            first_pick = pick.astype(np.uint8)
            slot = pick
        else:
            place = np.arange(len(active))
            slot = perm[place, pick].astype(np.int64)
            perm[place, pick] = perm[:, level]
            perm[place, level] = slot
        value = (_U64(level) << _U64(56)) | (mix(draw) >> _U64(8))
        cell = row[active] * slots + slot
        np.minimum.at(best, cell, value)
        # a document is finished when every slot is below the next rank
        open_ = (best.reshape(n, slots).max(axis=1) >= _U64(level + 1) << _U64(56))[row[active]]
        if not open_.all():
            if perm is not None:
                perm = perm[open_]
            active = active[open_]
    return (mix(best) & _U64(0xFFFF)).astype(np.uint16).reshape(n, slots)


def signatures(docs: DataFrame, shingle: int = SHINGLE, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """(doc_id, signature as binary, copy_of) of the rows with a doc_id and at least one word.

    copy_of is the smallest doc_id of the same signature among the texts at hand, so that a text
    that makes up a large share of all rows is mostly grouped before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            words = Words(*text_buffers(batch.column(1)), lower=True)
            row, element = element_sets(words, shingle)
            signature = superminhash(row, element, batch.num_rows, slots, seed)
            has = np.flatnonzero(words.counts > 0)
            ids = batch.column(0).to_numpy()[has]
            raw = [s.tobytes() for s in signature[has]]
            least: dict[bytes, int] = {}
            for s, i in zip(raw, ids.tolist()):
                least[s] = min(i, least.get(s, i))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array([least[s] for s in raw], pa.int64())], names=["doc_id", "signature", "copy_of"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return texts.mapInArrow(run, "doc_id long, signature binary, copy_of long")


def _similar(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    return (others == one).mean(axis=1)


def bucket_edges(ids: np.ndarray, signature: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Edges (smaller end first reached) that connect the same documents as all pairs of the bucket with similarity >= threshold."""
    order = np.argsort(ids, kind="stable")
    rest, out = order, []
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = _similar(signature[at], signature[rest]) >= threshold
            if near.any():
                hit = rest[near]
                out += [(int(ids[at]), int(ids[h])) for h in hit]
                frontier += hit.tolist()
                rest = rest[~near]
    return out


def _bucket_run(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last = None

        def close():
            if not held:
                return []
            ids = np.concatenate([h[0] for h in held])
            return bucket_edges(ids, np.concatenate([h[1] for h in held]), threshold) if len(ids) > 1 else []

        for batch in batches:  # sorted by bucket and cell
            bucket, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(bucket):
                continue
            ids = batch.column(2).to_numpy()
            raw = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(len(ids), -1)
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])) + 1
            out: list[tuple[int, int]] = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
                if (bucket[a], cell[a]) != last:
                    out += close()
                    held.clear()
                    last = (bucket[a], cell[a])
                held.append((ids[a:b], raw[a:b]))
            yield _pairs(out)
        yield _pairs(close())
        release()

    return run


def _pairs(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(edges, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the edges (a, b): (member, smallest member) of each non-trivial component, the smallest itself left out."""
    ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    n = len(a)
    for x, y in zip(inverse[:n].tolist(), inverse[n:].tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array([find(x) for x in range(len(ids))], dtype=np.int64)
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition become stars around the smallest member of each component in it."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        member, root = forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        yield pa.RecordBatch.from_arrays([pa.array(member), pa.array(root)], names=["a", "b"])


def components(spark: SparkSession, edges: DataFrame, work: Workspace | None = None) -> DataFrame:
    """(doc_id, keep_doc_id): each member of a connected component but the smallest, with the smallest.

    Rounds of large-star and small-star contraction, each written to the shared folder, until
    every member points straight at its root; the number of rounds grows with the logarithm of
    the components' size. No edge list is gathered on one machine.
    """
    work = work or Workspace(spark)
    stars = work.save(edges.select("a", "b").mapInArrow(_contract, "a long, b long").distinct(), "stars")
    while True:
        # large star: every neighbour that is larger moves to the smallest neighbour
        both = stars.select("a", "b").unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the smaller neighbours and the node itself move to the smallest of them
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = work.save(small.where("a <> b").distinct(), "stars")
        # done when all are stars: nobody that is pointed at points on, and nobody points twice
        chained = after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        twice = 0 if chained else after.groupBy("a").count().where("count > 1").limit(1).count()
        work.drop(stars)
        stars = after
        if not chained and not twice:
            return stars.select(F.col("a").alias("doc_id"), F.col("b").alias("keep_doc_id"))


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    threshold: float = THRESHOLD,
    shingle: int = SHINGLE,
    slots: int = SLOTS,
    bands: int = BANDS,
    seed: int = SEED,
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, keep_doc_id) of every document that goes, with the one that stays for its group.

    Words are compared without regard to ASCII case. Rows with a null doc_id or a text without
    words are in no group. Rows that share a doc_id count as one document with all their texts:
    it is near another one if any of them is.
    """
    if slots % bands:
        raise ValueError("bands must divide slots")
    work = Workspace(spark)
    signed = work.save(signatures(docs, shingle, slots, seed), "signatures")
    # documents of equal signatures are copies: one of them stands for all in the buckets
    near_by = signed.where("doc_id <> copy_of").select(F.col("copy_of").alias("a"), F.col("doc_id").alias("b"))
    alone = signed.where("doc_id = copy_of").select("doc_id", "signature")
    first = alone.groupBy("signature").agg(F.min("doc_id").alias("keep"), F.count("*").alias("n"))
    same = alone.join(first.where("n > 1").select("signature", "keep"), "signature").where("doc_id <> keep").select(F.col("keep").alias("a"), F.col("doc_id").alias("b"))
    size = 2 * slots // bands
    unique = first.select(F.col("keep").alias("doc_id"), "signature")
    band = F.explode(F.array(*(F.xxhash64(F.lit(i), F.substring("signature", i * size + 1, size)) for i in range(bands)))).alias("bucket")
    # only (bucket, id) is shuffled for all; signatures travel for buckets of several documents
    shared = unique.select(band, "doc_id").withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).where("n > 1").select("bucket", "doc_id", "n")
    # a bucket of more than `block` documents is cut into g parts, and every two parts meet in a cell of their own
    cells = f"""IF(n <= {block}, array(0L), transform(
        array_remove(sequence(0L, (n - 1) DIV {block}), pmod(xxhash64(doc_id), (n - 1) DIV {block} + 1)),
        o -> least(o, pmod(xxhash64(doc_id), (n - 1) DIV {block} + 1)) * ((n - 1) DIV {block} + 1) + greatest(o, pmod(xxhash64(doc_id), (n - 1) DIV {block} + 1))))"""
    rows = shared.select("bucket", "doc_id", F.explode(F.expr(cells)).alias("cell")).join(unique, "doc_id").select("bucket", "cell", "doc_id", "signature")
    found = rows.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell").mapInArrow(_bucket_run(threshold), "a long, b long")
    edges = work.save(near_by.unionByName(same).unionByName(found).where("a <> b").mapInArrow(_contract, "a long, b long"), "edges")
    return components(spark, edges, work)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, without those that near_duplicates lets go; see there for nulls and repeated ids."""
    gone = near_duplicates(spark, docs, **options).select(F.col("doc_id").alias("__wl_id"))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__wl_id"), "left_anti")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that goes as a near duplicate, with the one that stays."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
