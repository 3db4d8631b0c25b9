"""Operator 4: exact top-k search by a three-phase uniform threshold, for a set of query rows against all rows.

A score (inner product) is the sum of `blocks` partial scores, one for each block of dimensions;
each block of a part of the rows is a source with a list of its own, kept by falling length of
the rows' pieces. Partial scores are raised by |q_b| * max |x_b|, so that none is negative.

1. Each query gathers the k best entries of every block's list over the rows of one part; the
   k-th best total among them is a safe cutoff, a lower bound of the query's final k-th score.
2. The cutoff goes with the query to all parts. A row whose total reaches it must reach
   cutoff / blocks, the uniform threshold, in one block. As no entry exceeds |q_b| |x_b|, a list
   is read from its longest pieces down to where that product falls below the threshold, and of
   what was read the entries at or above the threshold are taken. What lies behind is never read.
3. The totals of the rows that were taken from any list, and of no others, are resolved exactly in
   double precision, and the k best of each cell and then of all cells remain.

Rows meet in a grid of cells (part of queries x part of rows), so no side is ever sent whole to
a machine and each cell's memory is bounded. The work is that of the queries times the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm._store import Workspace

K = 10
BLOCKS = 4
#: Rows of one part; a cell compares this many queries with this many rows.
PART_ROWS = 8192
#: Queries that are scored at once inside a cell.
_SLICE = 256
#: Decimals of a score; rows whose rounded scores tie are ranked by id.
DECIMALS = 6

_FOUND = "query_id long, neighbour_id long, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _cuts(dim: int, blocks: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dim, min(blocks, max(dim, 1)) + 1).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


class _Lists:
    """The blocks' lists of a part's rows: `order` gives the rows by falling length of their pieces."""

    def __init__(self, x: np.ndarray, blocks: int):
        self.x, self.cuts = x, _cuts(x.shape[1], blocks)
        self.norm = np.sqrt((x**2).sum(axis=1))
        # beyond the range of single precision pieces are kept in double
        kind = np.float32 if self.norm.max(initial=0.0) < 1e15 else np.float64
        self.order, self.length, self.piece = [], [], []
        for a, b in self.cuts:
            length = np.sqrt((x[:, a:b] ** 2).sum(axis=1))
            order = np.argsort(-length, kind="stable")
            self.order.append(order)
            self.length.append(length[order])
            self.piece.append(np.ascontiguousarray(x[order, a:b], dtype=kind))
        self.read = 0  # entries of lists that were looked at

    def lift(self, q: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(|q_b|, what raises the entries) of each block."""
        size = [np.sqrt((q[:, a:b] ** 2).sum(axis=1)) for a, b in self.cuts]
        return size, [s * n[:1].sum() for s, n in zip(size, self.length)]

    def entries(self, k: int, q: np.ndarray, count: int) -> np.ndarray:
        """The first `count` entries of block k's list for each query."""
        a, b = self.cuts[k]
        self.read += len(q) * count
        return q[:, a:b].astype(self.piece[k].dtype) @ self.piece[k][:count].T

    def slack(self, q: np.ndarray) -> np.ndarray:
        """More than the error of single precision and of rounding in a total."""
        return 1e-5 * np.sqrt((q**2).sum(axis=1)) * self.norm.max(initial=0.0) + 2 * 10.0**-DECIMALS


def _totals(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the pairs (q[a], x[b]) in double precision."""
    step = 1 + (1 << 22) // max(1, x.shape[1])
    return np.concatenate([np.einsum("ij,ij->i", q[a[s : s + step]], x[b[s : s + step]]) for s in range(0, len(a), step)] or [np.zeros(0)])


def cutoffs(queries: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, blocks: int) -> np.ndarray:
    """Phase 1: for each of the rows `queries` a score that its k-th best neighbour reaches at least; -inf if fewer than k are at hand."""
    out = np.full(len(queries), -np.inf)
    if len(ids) <= k:
        return out
    lists = _Lists(x, blocks)
    for s in range(0, len(queries), _SLICE):
        at = queries[s : s + _SLICE]
        q = x[at]
        listed = np.zeros((len(q), len(ids)), bool)
        for n, order in enumerate(lists.order):
            p = lists.entries(n, q, len(ids))
            p[order[None, :] == at[:, None]] = -np.inf  # a row isn't its own neighbour
            best = np.argpartition(-p, k - 1, axis=1)[:, :k]
            np.put_along_axis(listed, order[best], True, axis=1)
        a, b = np.nonzero(listed)
        total = _totals(q, x, a, b)
        order = np.lexsort((-total, a))
        heads = np.searchsorted(a[order], np.arange(len(q)))
        out[s : s + len(q)] = total[order][heads + k - 1]
    return out


def search_cell(qid: np.ndarray, q: np.ndarray, cutoff: np.ndarray, ids: np.ndarray, lists: _Lists, k: int) -> tuple[np.ndarray, ...]:
    """Phases 2 and 3 in one cell: (query, row, score) of the k best rows of each query that can be in its final k."""
    out = []
    rows = len(ids)
    for s in range(0, len(qid), _SLICE):
        part, limit = q[s : s + _SLICE], cutoff[s : s + _SLICE]
        size, lift = lists.lift(part)
        threshold = (limit + sum(lift) - lists.slack(part)) / len(lists.cuts)
        found = []
        for n, order in enumerate(lists.order):
            least = threshold - lift[n]  # of the entries as they are
            reach = np.where(least > 0, least / np.maximum(size[n], 1e-300), 0.0)
            # the list falls, so what can reach the threshold is a prefix
            depth = rows - np.searchsorted(lists.length[n][::-1], reach * (1 - 1e-9), side="left")
            depth[(least > 0) & (size[n] == 0)] = 0
            for group in np.array_split(np.argsort(depth, kind="stable"), 4):  # queries of about one depth read together
                deepest = int(depth[group].max(initial=0))
                if not deepest:
                    continue
                a, b = np.nonzero(lists.entries(n, part[group], deepest) >= least[group][:, None])
                found.append(group[a] * rows + order[b])
        pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        a, b = pair // rows, pair % rows
        other = qid[s + a] != ids[b]
        a, b = a[other], b[other]
        total = np.round(_totals(part, lists.x, a, b), DECIMALS)
        fits = total >= limit[a] - 10.0**-DECIMALS
        a, b, total = a[fits], b[fits], total[fits]
        order = np.lexsort((ids[b], -total, a))
        a, b, total = a[order], b[order], total[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        best = rank < k
        out.append((qid[s + a[best]], ids[b[best]], total[best] + 0.0))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _phase_one(k: int, blocks: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asked = np.flatnonzero(t["asked"].to_numpy(zero_copy_only=False))
        if not len(asked):
            return pa.table({"id": pa.array([], pa.int64()), "cutoff": pa.array([], pa.float64())})
        ids = t["id"].to_numpy()
        return pa.table({"id": ids[asked], "cutoff": cutoffs(asked, ids, _matrix(t["vec"].combine_chunks()), k, blocks)})

    return run


def _cell(k: int, blocks: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            q, x = (_matrix(t["vec"].combine_chunks()) for t in (left, right))
            found = search_cell(left["id"].to_numpy(), q, left["cutoff"].to_numpy(), right["id"].to_numpy(), _Lists(x, blocks), k)
        else:
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table(dict(zip(("query_id", "neighbour_id", "score"), map(pa.array, found))))

    return run


def search(spark: SparkSession, rows: DataFrame, k: int = K, blocks: int = BLOCKS, part_rows: int = PART_ROWS, every: int = 1) -> DataFrame:
    """(query_id, rank, neighbour_id, score): for each row (vec_id, embedding) whose id is divisible by `every` its k rows of the highest inner product, of all rows.

    A row is not its own neighbour; ties of the score, rounded to 6 decimals, go to the lower id.
    Rows with a null id, or a vector that is null, empty or holds a null, NaN or infinity, neither
    ask nor answer. Rows of one id count once, with the lowest of their vectors. Vectors meet
    only those of their own length. With fewer than k others all of them are returned.
    """
    if k < 1 or blocks < 1 or every < 1 or part_rows <= k:
        raise ValueError("k, blocks and every must be positive, and part_rows larger than k")
    work = Workspace(spark)
    vec = F.col("embedding").cast("array<double>")
    plain = rows.select(F.col("vec_id").cast("long").alias("id"), vec.alias("vec")).where(
        "id IS NOT NULL AND size(vec) > 0 AND NOT exists(vec, v -> v IS NULL OR isnan(v) OR abs(v) = double('infinity'))"
    )
    single = work.save(plain.groupBy("id").agg(F.min("vec").alias("vec")), "rows")
    asks = F.col("id") % every == 0
    size = single.agg(F.count("*").alias("rows"), F.count_if(asks).alias("asked")).first()
    parts, asked_parts = (max(1, -(-n // part_rows)) for n in size)
    own = single.select("id", "vec", F.size("vec").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), asks.alias("asked"))
    cutoff = own.groupBy("dim", "part").applyInArrow(_phase_one(k, blocks), "id long, cutoff double")
    asked = work.save(own.where("asked").join(cutoff, "id"), "queries")
    all_parts, all_asked = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (parts, asked_parts))
    left = asked.select("dim", F.pmod(F.xxhash64("id"), F.lit(asked_parts)).cast("int").alias("part"), all_parts.alias("other"), "id", "vec", "cutoff")
    right = own.select("dim", all_asked.alias("part"), F.col("part").alias("other"), "id", "vec")
    keys = ("dim", "part", "other")
    cells = max(1, parts * asked_parts)
    found = (
        left.repartition(cells, *keys).groupBy(*keys).cogroup(right.repartition(cells, *keys).groupBy(*keys)).applyInArrow(_cell(k, blocks), _FOUND)
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "neighbour_id")
    return found.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}").select("query_id", "rank", "neighbour_id", "score")


#: op4 asks for the rows whose id this divides.
EVERY = 100


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all rows for every row whose id is divisible by EVERY."""
    return search(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), every=EVERY)


ORACLE = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, round(list_dot_product(a.e, b.e), {DECIMALS}) + 0.0 AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id))::INT AS rank, neighbour_id, score FROM s)
SELECT query_id, rank, neighbour_id, score FROM r WHERE rank <= {K}
"""
