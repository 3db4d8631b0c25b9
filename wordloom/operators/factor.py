"""Truncated singular value decomposition of a sparse table (w, c, x) and embeddings from it.

Cells are written once in files of whole rows, which the tasks read. The exact route sums each partition's Gramian and takes its
eigenvectors on the driver, for up to `EXACT_COLUMNS` columns; beyond them a block Krylov space is
grown until residuals are small. The randomized route is subspace iteration. Both move blocks of
n x (dim + oversampling) numbers only; the Krylov space holds up to eight of them on the driver. Partial sums are reduced
in stripes on the executors, so the driver gets one matrix, whatever the number of partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions import vectors as V
from wordloom.sources import shared

EXACT_COLUMNS = 8192
#: Beyond them the residuals |A'Av - s²v| of all wanted triplets must fall to this share of the largest s², within so many products.
TOLERANCE, MOST_PRODUCTS = 1e-8, 500
IMPLS = ("scipy", "gensim", "scikit", "randomized")
#: Rows of a partial sum that travel together.
_STRIPE = 256
#: Cells that are multiplied at once.
_BATCH = 1 << 16


@dataclass(frozen=True)
class Factors:
    """u: (w, u array) rows of the left factor; s: falling singular values; v: right vectors, one row a column id."""

    u: DataFrame
    s: np.ndarray
    v: np.ndarray

    def right(self) -> DataFrame:
        """(c, v array)."""
        spark = self.u.sparkSession
        return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(self.v)], "c int, v array<double>")


def clamp(dim: int, n: int) -> int:
    """The number of components that an n x n matrix allows."""
    dim = min(dim, n - 1)
    if dim < 1:
        raise ValueError("the matrix is too small to be factored")
    return dim


def negligible(s: np.ndarray, n: int) -> np.ndarray:
    """Which singular values are above rounding noise of single precision."""
    return s > (s.max(initial=0.0) * n * np.finfo(np.float32).eps)


def _stripes(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    for s in range(0, len(total), _STRIPE):
        part = total[s : s + _STRIPE]
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["stripe", "data"])


def _add(table: pa.Table) -> pa.Table:
    blobs = table["data"].to_pylist()
    total = np.sum([np.frombuffer(b, np.float64) for b in blobs], axis=0)
    return pa.table({"stripe": table["stripe"].slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})


def _gather(parts: DataFrame, n: int, width: int) -> np.ndarray:
    rows = parts.groupBy("stripe").applyInArrow(_add, "stripe int, data binary").toArrow().to_pydict()
    out = np.zeros((n, width))
    for stripe, data in zip(rows["stripe"], rows["data"]):
        part = np.frombuffer(data, np.float64).reshape(-1, width)
        out[stripe : stripe + len(part)] = part
    return out


class Cells:
    """A matrix that is written as files of whole rows, their cells in order; each task of a product reads its share of the files."""

    def __init__(self, rows: DataFrame) -> None:
        self.spark = rows.sparkSession
        self.tasks = self.spark.sparkContext.defaultParallelism
        self.path = shared.write(rows.select("w", "c", "x").repartition(2 * self.tasks, "w").sortWithinPartitions("w", "c"), "rows")

    def map(self, run: Callable[[Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """The results of `run` for each task's files; run gets (c, x, first cell of each row and the end, word of each row) of one file after the other."""
        path, tasks = self.path, self.tasks

        def files(mine: list[int]) -> Iterator[tuple]:
            for table in shared.files(path, mine, tasks):
                w, c, x = (table[k].to_numpy() for k in ("w", "c", "x"))
                new = np.concatenate([[True], (w[1:] != w[:-1]) | (c[1:] != c[:-1])])
                if not new.all():  # cells that are given twice add up
                    x = np.add.reduceat(x, np.flatnonzero(new))
                    w, c = w[new], c[new]
                heads = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                yield c, x, np.append(heads, len(w)), w[heads]

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from run(files([i for b in batches for i in b.column(0).to_pylist()]))

        return self.spark.range(0, tasks, 1, tasks).mapInArrow(start, schema)


def gramian(cells: Cells, n: int) -> np.ndarray:
    """A'A."""

    def run(files: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((n, n)), False
        per = max(1, _BATCH * 16 // n)
        for c, x, ends, w in files:
            some = True
            for s in range(0, len(w), per):
                part = ends[s : s + per + 1]
                dense = np.zeros((len(part) - 1, n))
                dense[np.repeat(np.arange(len(part) - 1), np.diff(part)), c[part[0] : part[-1]]] = x[part[0] : part[-1]]
                total += dense.T @ dense
        if some:
            yield from _stripes(total)

    return _gather(cells.map(run, "stripe int, data binary"), n, n)


def _times(cells: Cells, q: np.ndarray) -> np.ndarray:
    """A'(A q), row by row, so that what is gathered for a row stays in the cache; a task's sum leaves it once."""
    n, width = q.shape
    sent = cells.spark.sparkContext.broadcast(q)

    def run(files: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        q, total, some = sent.value, np.zeros((n, width)), False
        for c, x, ends, _ in files:
            some = True
            ends = ends.tolist()
            for a, b in zip(ends, ends[1:]):
                at, y = c[a:b], x[a:b]
                total[at] += np.multiply.outer(y, y @ q[at])
        if some:
            yield from _stripes(total)

    out = _gather(cells.map(run, "stripe int, data binary"), n, width)
    sent.unpersist()
    return out


def _left(cells: Cells, v: np.ndarray, s: np.ndarray) -> DataFrame:
    """(w, u): rows of A v / s."""
    sent = cells.spark.sparkContext.broadcast(v / s)

    def run(files: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for c, x, ends, w in files:
            ends = ends.tolist()
            u = np.array([x[a:b] @ sent.value[c[a:b]] for a, b in zip(ends, ends[1:])])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * u.shape[1]), pa.array(u.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), flat], names=["w", "u"])

    return cells.map(run, "w int, u array<double>")


def _converged(cells: Cells, n: int, dim: int, width: int, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The dim largest eigenvalues of A'A and their vectors, by a block Krylov space that is restarted with the best half of it; raises if TOLERANCE isn't reached in `most` products."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))
    aq = _times(cells, q)
    small = q.T @ aq
    for product in range(1, most + 1):
        values, z = np.linalg.eigh((small + small.T) / 2)
        values, z = values[::-1], z[:, ::-1]
        x = q @ z[:, :width]
        rest = aq @ z[:, :width] - x * values[:width]
        worst = np.linalg.norm(rest[:, :dim], axis=0).max()
        if worst <= TOLERANCE * values[0]:
            return values[:dim], x[:, :dim]
        if product == most:
            break
        if q.shape[1] + width > 4 * width:
            q, aq, small = q @ z[:, : 2 * width], aq @ z[:, : 2 * width], np.diag(values[: 2 * width])
        rest = rest[:, : n - q.shape[1]]
        for _ in range(2):
            rest, _ = np.linalg.qr(rest - q @ (q.T @ rest))
        new = _times(cells, rest)
        side = q.T @ new  # only the products with the new block are missing
        small = np.block([[small, side], [side.T, rest.T @ new]])
        q, aq = np.hstack([q, rest]), np.hstack([aq, new])
    raise ArithmeticError(f"no convergence in {most} products: the largest residual is {worst / values[0]:.1e} of the largest squared singular value, {TOLERANCE:.0e} is allowed")


def svd(matrix: DataFrame, n: int, dim: int = 500, impl: str = "scipy", n_iter: int | None = None, oversample: int | None = None, seed: int = 0) -> Factors:
    """The dim largest singular triplets of an n x n matrix (w, c, x); fewer if the rest is rounding noise.

    "scipy" is exact; beyond EXACT_COLUMNS it iterates until the residuals of all triplets are
    within TOLERANCE, and raises if n_iter products (MOST_PRODUCTS) don't do. "gensim" iterates 5 times with 10 more vectors, "scikit" and "randomized" 5 times with 10 unless told
    otherwise. An empty matrix raises.
    """
    if impl not in IMPLS:
        raise ValueError(f"impl is {impl!r}; it can be {IMPLS}")
    dim = clamp(dim, n)
    rows = matrix.select(F.col("w").cast("int").alias("w"), F.col("c").cast("int").alias("c"), F.col("x").cast("double").alias("x")).where("x <> 0")
    cells = Cells(rows)
    if not shared.read(rows, cells.path).take(1):
        raise ValueError("the matrix has no entries")
    if impl == "scipy" and n <= EXACT_COLUMNS:
        values, vectors = np.linalg.eigh(gramian(cells, n))
        order = np.argsort(-values)[:dim]
        s2, v = values[order], vectors[:, order]
    elif impl == "scipy":
        width = min(n, dim + (oversample if oversample is not None else 50))
        s2, v = _converged(cells, n, dim, width, n_iter if n_iter is not None else MOST_PRODUCTS, seed)
    else:
        width = min(n, dim + (oversample if oversample is not None else 10))
        q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))
        for _ in range(n_iter if n_iter is not None else 5):
            q, _ = np.linalg.qr(_times(cells, q))
        small = q.T @ _times(cells, q)
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)[:dim]
        s2, v = values[order], q @ vectors[:, order]
    s = np.sqrt(np.maximum(s2, 0))
    kept = negligible(s, n)
    s, v = s[kept], v[:, kept]
    return Factors(_left(cells, v, s), s, v)


def embed(factors: Factors, eig: float = 0.0, add_context: bool = False, normalize: bool = True) -> DataFrame:
    """(id, vec): u * s**eig, with the right vectors weighed alike added to them if asked, then of unit length; zero rows stay zero."""
    s = [float(x) for x in factors.s]
    vec = V.weigh(F.col("u"), s, eig)
    rows = factors.u.select(F.col("w").alias("id"), vec.alias("vec"))
    if add_context:
        right = factors.right().select(F.col("c").alias("id"), V.weigh(F.col("v"), s, eig).alias("other"))
        zero = F.array_repeat(F.lit(0.0), len(s))
        rows = rows.join(right, "id", "full").select("id", V.add(F.coalesce("vec", zero), F.coalesce("other", zero)).alias("vec"))
    if normalize:
        rows = rows.select("id", V.unit(F.col("vec"), V.norm(F.col("vec"))).alias("vec"))
    return rows
