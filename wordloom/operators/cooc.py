"""Windowed co-occurrence counts of encoded documents.

A pair (w, c) counts for every two positions of one document that are at most `window` apart, in
both directions. The counts of each distance are summed as integers and weighted once at the
end, so results don't depend on partitioning.

Removing a token closes the window (unknown tokens, "dirty" subsampling); blanking it keeps its
slot ("prob" subsampling), so it still separates its neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.draws import RANGE
from wordloom.operators.vocab import BROADCAST_ROWS, bounded, token_counts

#: Pairs that a worker holds before it sums them up, and pairs of one range of the space of pairs, which are summed up together.
HELD_PAIRS, RANGE_PAIRS = 1 << 24, 1 << 21
#: An odd number: multiplying by it spreads the pairs over their space, one to one.
_SPREAD = 0x9E3779B97F4A7C15

MODES = (None, False, "deter", "prob", "dirty", "off", "decay")


@dataclass(frozen=True)
class PairParams:
    """How pairs are counted; see count_pairs."""

    window: int = 2
    dynamic_window: str | bool | None = "deter"
    decay_rate: float = 0.25
    delete_oov: bool = True
    subsample: str | bool | None = "deter"
    subsample_factor: float = 1e-5
    seed: int = 1312
    min_count: float | None = 0

    def __post_init__(self) -> None:
        for name in ("dynamic_window", "subsample"):
            value = getattr(self, name)
            if not any(value is m or (isinstance(value, str) and value == m) for m in MODES):
                raise ValueError(f"{name} is {value!r}; it can be {MODES}")
        if self.window < 1:
            raise ValueError("window must be positive")

    def weight(self, distance: int) -> float:
        """Weight of a pair at a distance; modes that name no weighting are flat."""
        if self.dynamic_window == "deter":
            return (self.window + 1 - distance) / self.window
        if self.dynamic_window == "decay":
            return math.exp(-self.decay_rate * (distance - 1))
        return 1.0


def keep_factors(counts: DataFrame, factor: float) -> DataFrame:
    """(id, p) of tokens more frequent than factor * all tokens: p = sqrt(threshold / n)."""
    total = F.broadcast(counts.agg((F.lit(factor) * F.sum("n")).alias("t")))
    return counts.crossJoin(total).where("n > t").select("id", F.sqrt(F.col("t") / F.col("n")).alias("p"))


def drop_unknown(ids: DataFrame, size: int) -> DataFrame:
    """Documents without unknown tokens; the gaps close."""
    return ids.select("doc_id", F.filter("ids", lambda x: x < size).alias("ids"))


def subsample(ids: DataFrame, factors: DataFrame, seed: int, dirty: bool, size: int) -> DataFrame:
    """Documents whose frequent tokens are kept with probability p each: the others are removed (dirty) or become null slots.

    Draws are made inside the row: the probabilities of all ids travel as one array, which is
    indexed by id, so no token is shuffled. A vocabulary too large for that joins instead.
    """
    number = "cast(conv(substr(md5(concat_ws('-', '{seed}', 'keep', cast(doc_id AS string), cast({pos} AS string))), 1, 8), 16, 10) AS long) / {range}D"
    if size > BROADCAST_ROWS:
        long = ids.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.posexplode("ids").alias("pos", "id")).join(factors, "id", "left")
        kept = F.col("p").isNull() | (F.expr(number.format(seed=seed, pos="pos", range=RANGE)) < F.col("p"))
        slots = long.select("row", "doc_id", F.struct("pos", F.when(kept, F.col("id")).alias("id")).alias("s"))
        if dirty:
            slots = slots.where("s.id IS NOT NULL")
        return slots.groupBy("row", "doc_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["id"]).alias("ids")).drop("row")
    # one row of size + 1 numbers; 2 stands for ids that are always kept
    every = ids.sparkSession.range(size + 1).join(F.broadcast(factors), "id", "left").select("id", F.coalesce("p", F.lit(2.0)).alias("p"))
    odds = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "p"))), lambda x: x["p"]).alias("__p"))
    kept = f"IF(x IS NULL OR coalesce(get(__p, x), 2) > 1 OR {number.format(seed=seed, pos='i', range=RANGE)} < get(__p, x), x, CAST(NULL AS int))"
    drawn = ids.crossJoin(F.broadcast(odds)).select("doc_id", F.expr(f"transform(ids, (x, i) -> {kept})").alias("ids"))
    return drawn.select("doc_id", F.filter("ids", lambda x: x.isNotNull()).alias("ids")) if dirty else drawn


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, row of each) of a column of lists; a null slot is -1."""
    values = lists.flatten()
    values = (values.fill_null(-1) if values.null_count else values).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0)
    return values, np.repeat(np.arange(len(lists)), sizes.to_numpy(zero_copy_only=False))


def _add_up(docs: DataFrame, most: int, base: int, classes: int, pairs_of: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, int]]], mirror: bool) -> DataFrame:
    """(w, c, n1..n<classes>) of the pairs (w, c, class) that pairs_of gives for a batch of docs; w and c are below `base`, the pairs at most `most`. With `mirror` each pair (w <= c) is written in both directions.

    A pair is a number in a space whose size is a power of two, spread over it by a product. A
    worker sorts and sums up HELD_PAIRS pairs, cuts them into ranges of the space and sends each
    range as one row: 4 bytes a pair and class, and one for its count. Then each range is summed
    up by itself, so memory is bounded by the two constants, whatever the corpus.
    """
    bits = max(1, (base * base - 1).bit_length())
    ranges = max(0, math.ceil(math.log2(max(1, most) / RANGE_PAIRS)) if most > RANGE_PAIRS else 0, bits - 32 + (classes - 1).bit_length())
    ranges = min(ranges, bits)
    low, mask = bits - ranges, np.uint64((1 << bits) - 1)
    spread, back = np.uint64(_SPREAD & ((1 << bits) - 1)), np.uint64(pow(_SPREAD, -1, 1 << bits))
    width, k = np.uint64((1 << low) * classes), np.uint64(classes)

    def sums(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate(held)
        held.clear()
        codes.sort()
        heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        n = np.diff(np.append(heads, len(codes)))
        codes = codes[heads]
        many = (n + 254) // 255
        if many.max() > 1:  # a count beyond one byte is several entries
            codes, left = np.repeat(codes, many), np.repeat(n, many)
            nth = np.arange(len(codes)) - np.repeat(np.cumsum(many) - many, many)
            n = np.minimum(255, left - 255 * nth)
        of = (codes // width).astype(np.int64)
        parts, firsts = np.unique(of, return_index=True)
        places, n = (codes - of.astype(np.uint64) * width).astype(np.uint32), n.astype(np.uint8)
        stops = np.append(firsts, len(codes))
        for s in range(0, len(parts), 256):
            e = min(s + 256, len(parts))
            cuts = stops[s : e + 1] - stops[s]
            columns = [pa.Array.from_buffers(pa.binary(), e - s, [None, pa.py_buffer((cuts * data.itemsize).astype(np.int32)), pa.py_buffer(data[stops[s] : stops[e]])]) for data in (places, n)]
            yield pa.RecordBatch.from_arrays([pa.array(parts[s:e].astype(np.int32)), *columns], names=["part", "places", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for w, c, kind in pairs_of(batch):
                codes = (w * base + c).astype(np.uint64)
                held.append(((codes * spread) & mask) * k + np.uint64(kind))
                size += len(codes)
                if size >= HELD_PAIRS:
                    yield from sums(held)
                    size = 0
        if size:
            yield from sums(held)

    def merge(table: pa.Table) -> pa.Table:
        part = np.uint64(table["part"][0].as_py())
        places, n = (np.frombuffer(b"".join(table[c].to_pylist()), t).astype(np.uint64) for c, t in (("places", np.uint32), ("n", np.uint8)))
        both = (places << np.uint64(32)) | n
        both.sort()
        places = both >> np.uint64(32)
        heads = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
        n, codes = np.add.reduceat((both & np.uint64(0xFFFFFFFF)).astype(np.int64), heads), part * width + places[heads]
        pairs, kind = codes // k, (codes % k).astype(np.int64)
        first = np.concatenate([[True], pairs[1:] != pairs[:-1]])
        counts = np.zeros((classes, int(first.sum())), np.int64)
        counts[kind, np.cumsum(first) - 1] = n
        pairs = ((pairs[first] * back) & mask).astype(np.int64)
        w, c = pairs // base, pairs % base
        if mirror:
            same = w == c
            counts[:, same] *= 2
            other = ~same
            w, c, counts = np.concatenate([w, c[other]]), np.concatenate([c, w[other]]), np.concatenate([counts, counts[:, other]], axis=1)
        return pa.table([pa.array(w, pa.int32()), pa.array(c, pa.int32()), *map(pa.array, counts)], names=["w", "c", *names])

    names = [f"n{d + 1}" for d in range(classes)]
    parts = docs.mapInArrow(count, "part int, places binary, n binary")
    return parts.groupBy("part").applyInArrow(merge, "w int, c int, " + ", ".join(f"{n} long" for n in names))


def _extent(ids: DataFrame) -> tuple[int, int]:
    """(tokens, the largest id) of documents."""
    row = ids.agg(F.sum(F.size("ids")), F.max(F.array_max("ids"))).first()
    return row[0] or 0, row[1] or 0


def _fits(highest: int, classes: int) -> bool:
    """Whether pairs of ids up to `highest` can be numbers of ranges of 32 bits."""
    return highest <= BROADCAST_ROWS and (highest + 1) ** 2 * classes < 1 << 48


def _right_pairs(window: int) -> str:
    """All (a, b, d) with b standing d places behind a: an array for each row, built without repeating the row."""
    each = [
        f"transform(slice(ids, 1, greatest(size(ids) - {d}, 0)), (x, i) -> struct(least(x, ids[i + {d}]) AS w, greatest(x, ids[i + {d}]) AS c, {d} AS d, x IS NOT NULL AND ids[i + {d}] IS NOT NULL AS ok))"
        for d in range(1, window + 1)
    ]
    return "filter(flatten(array(" + ", ".join(each) + ")), p -> p.ok)"


def histogram(ids: DataFrame, window: int, highest: int, tokens: int) -> DataFrame:
    """(w, c, n1..nW): for each ordered pair the number of times that it occurs at each distance. ids are at most `highest`; the corpus has at most `tokens` of them.

    The distance counts are symmetric, so only unordered pairs are shuffled, and each is written
    in both directions afterwards.
    """
    if _fits(highest, window):

        def pairs_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
            x, row = _flat(batch.column(0))
            for d in range(1, window + 1):
                a, b = x[:-d], x[d:]
                ok = (row[:-d] == row[d:]) & (a >= 0) & (b >= 0)
                a, b = a[ok], b[ok]
                yield np.minimum(a, b), np.maximum(a, b), d - 1

        return _add_up(ids.select("ids"), tokens * window, highest + 1, window, pairs_of, True)
    pairs = ids.select(F.explode(F.expr(_right_pairs(window))).alias("p")).select("p.w", "p.c", "p.d")
    half = pairs.groupBy("w", "c").agg(*(F.sum(F.expr(f"IF(d = {d}, 1L, 0L)")).alias(f"n{d}") for d in range(1, window + 1)))
    counts = [f"n{d}" for d in range(1, window + 1)]
    both = F.expr(
        "IF(w = c, array(struct(w, c, 2 AS k)), array(struct(w, c, 1 AS k), struct(c AS w, w AS c, 1 AS k)))"
    )
    out = half.select(F.explode(both).alias("p"), *counts)
    return out.select("p.w", "p.c", *((F.col(n) * F.col("p.k")).alias(n) for n in counts))


def random_window(ids: DataFrame, window: int, seed: int, highest: int, tokens: int) -> DataFrame:
    """(w, c, n1): pairs within a radius that is drawn for each centre from 1 to window; not symmetric."""
    radius = (
        f"transform(ids, (x, i) -> 1 + cast(conv(substr(md5(concat_ws('-', '{seed}', 'rad', cast(doc_id AS string), cast(i AS string))), 1, 8), 16, 10) AS long) % {window})"
    )
    drawn = ids.select("ids", F.expr(radius).alias("r"))
    if _fits(highest, 1):

        def pairs_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
            x, row = _flat(batch.column(0))
            r = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            for d in range(1, window + 1):
                a, b = x[:-d], x[d:]
                ok = (row[:-d] == row[d:]) & (a >= 0) & (b >= 0)
                for w, c, near in ((a, b, r[:-d]), (b, a, r[d:])):
                    kept = ok & (near >= d)
                    yield w[kept], c[kept], 0

        return _add_up(drawn, 2 * tokens * window, highest + 1, 1, pairs_of, False)
    each = []
    for d in range(1, window + 1):
        body = f"slice(ids, 1, greatest(size(ids) - {d}, 0))"
        each.append(f"transform({body}, (x, i) -> struct(x AS w, ids[i + {d}] AS c, r[i] >= {d} AS ok))")
        each.append(f"transform({body}, (x, i) -> struct(ids[i + {d}] AS w, x AS c, r[i + {d}] >= {d} AS ok))")
    made = "filter(flatten(array(" + ", ".join(each) + ")), p -> p.ok AND p.w IS NOT NULL AND p.c IS NOT NULL)"
    pairs = drawn.select(F.explode(F.expr(made)).alias("p")).select("p.w", "p.c")
    return pairs.groupBy("w", "c").agg(F.count("*").alias("n1"))


def weighted(counts: DataFrame, params: PairParams) -> Column:
    """The weighted sum of the distance counts, in a fixed order."""
    names = [c for c in counts.columns if c not in ("w", "c")]
    total = F.lit(0.0)
    for name in names:
        factor = 1.0 if params.dynamic_window == "prob" else params.weight(int(name[1:]))
        total = total + F.col(name) * F.lit(factor)
    return total


def factors_of(counts: DataFrame, params: PairParams) -> DataFrame | None:
    """The keep factors where subsampling needs them; counts (id, n) are of the documents as given, unknown tokens included."""
    return keep_factors(counts, params.subsample_factor) if params.subsample in ("deter", "prob", "dirty") else None


def distances(ids: DataFrame, size: int, params: PairParams, factors: DataFrame | None = None) -> DataFrame:
    """Counts of each pair by distance, of documents as the window sees them; positions of draws are those behind the removal of unknown tokens."""
    tokens, highest = _extent(ids)
    if params.delete_oov:
        ids = drop_unknown(ids, size)
    if params.subsample in ("prob", "dirty"):
        ids = subsample(ids, factors, params.seed, params.subsample == "dirty", size)
    return random_window(ids, params.window, params.seed, highest, tokens) if params.dynamic_window == "prob" else histogram(ids, params.window, highest, tokens)


def settle(found: DataFrame, size: int, params: PairParams, factors: DataFrame | None) -> DataFrame:
    """(w, c, n) of the distance counts: weights, then min_count, then the deterministic subsampling factors of both tokens."""
    cells = found.select("w", "c", weighted(found, params).alias("n"))
    if params.min_count:
        cells = cells.where(F.col("n") >= params.min_count)
    if params.subsample == "deter":
        side = bounded(factors, size + 1)
        cells = (
            cells.join(side.select(F.col("id").alias("w"), F.col("p").alias("pw")), "w", "left")
            .join(side.select(F.col("id").alias("c"), F.col("p").alias("pc")), "c", "left")
            .select("w", "c", (F.col("n") * F.coalesce("pw", F.lit(1.0)) * F.coalesce("pc", F.lit(1.0))).alias("n"))
        )
    return cells


def count_pairs(ids: DataFrame, size: int, params: PairParams | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(w, c, n): weighted counts of ordered pairs of ids in (doc_id, ids), ids from 0 to size, size being the unknown token. `counts` (id, n) saves counting the tokens again."""
    params = params or PairParams()
    factors = factors_of(counts if counts is not None else token_counts(ids), params)
    return settle(distances(ids, size, params, factors), size, params, factors)


def sparsity(cells: DataFrame, size: int) -> DataFrame:
    """One row: cells, and their share of all (size + 1)**2."""
    return cells.agg(F.count("*").alias("cells"), (F.count("*") / F.lit(float((size + 1) ** 2))).alias("share"))
