"""Vectorised text primitives: whole Arrow batches of UTF-8 are handled as one byte array.

Words are maximal runs of bytes that are not ASCII white space (space, \\t, \\n, \\v, \\f, \\r).
Hashes are prefix-sum polynomials modulo 2**64 passed through a 64-bit finaliser, so the hash
of any run of words costs two look-ups however long the run is.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE_BYTES = (9, 10, 11, 12, 13, 32)
#: Bytes of text handled at once by the vectorised kernels; bounds a Python worker's memory.
CHUNK_BYTES = 1 << 21

_BASE = 0x9E3779B97F4A7C15 | 1
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACE_BYTES)] = False
#: Bytes of words without ASCII punctuation and control characters: ASCII letters, digits and all of other scripts.
PLAIN = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in [0, n)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(size, base, dtype=U64), np.full(size, inverse, dtype=U64)
        up[0] = down[0] = U64(1)
        have = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        _powers[base] = have
    return have[0][:n], have[1][:n]


#: Values whose sums are held at once; bounds the memory of hashing a long text.
_BLOCK = 1 << 19


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[s:e] for each pair (s, e); equal runs hash alike wherever they stand."""
    if len(values) <= _BLOCK:
        return _run_hashes(values, starts, ends)
    out = np.empty(len(starts), dtype=U64)
    block = starts // _BLOCK
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.diff(block[order])) + 1
    for at in np.split(order, cuts) if len(order) else ():
        low, high = int(starts[at].min()), int(ends[at].max())
        out[at] = _run_hashes(values[low:high], starts[at] - low, ends[at] - low)
    return out


def _run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=U64)
    terms = values.astype(U64, copy=True)
    terms += U64(1)
    terms *= up[:-1]
    np.cumsum(terms, dtype=U64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty. Offsets start at zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs (row, value), by row."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give memory that is free back to the system: workers are reused, and what a task leaves counts against the next one's."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text each; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    release()


class Words:
    """The words of a chunk of texts (runs of the bytes `of`): byte spans, 64-bit hashes and word counts per text."""

    __slots__ = ("bounds", "counts", "data", "ends", "hashes", "row", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, of: np.ndarray = _IS_WORD):
        n_rows = len(offsets) - 1
        self.data = data
        inside = of[data]
        before = np.empty_like(inside)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
            heads = offsets[:-1]
            before[heads[heads < len(data)]] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        if len(data):
            after[-1] = False
            after[:-1] = inside[1:]
            tails = offsets[1:] - 1
            after[tails[tails >= 0]] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        source = data
        if lower:
            source = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.hashes = run_hashes(source, self.starts, self.ends) if len(self.starts) else np.zeros(0, U64)
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.row = np.repeat(np.arange(n_rows), self.counts)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each run of k words that lies in one text, in order."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        first = np.arange(n - k + 1)
        first = first[self.row[: n - k + 1] == self.row[k - 1 :]]
        return first, run_hashes(self.hashes, first, first + k)
