"""Operator 9: byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is cut into pieces by a pattern; the bytes of a piece are its first tokens. The leaf of
each live byte position holds the rank of the pair that the token there forms with the next one,
and every node of the tree the least (rank, position) below it, so the root names the leftmost
pair of minimum rank. A merge kills the right position and changes two leaves, that of the
merged token and that of its live left neighbour: logarithmic point updates. The merge order is
that of the public byte-level encoders, and the ids are theirs.

Pieces repeat, and so do words with the white space before them, which the pattern cuts into
pieces without regard to what stands around: each batch encodes its new different words only, of
these the new different pieces, and a worker keeps what it has. The trees of all new pieces of about
one length are rows of one array and are updated together; a piece longer than `_BATCHED` bytes
has a tree of its own. Texts with white space beyond ASCII, where words would be cut otherwise,
go through the pattern as a whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm._text import Words, chunks, run_hashes, text_buffers

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space of the pattern's \\s that isn't ASCII white space.
_ODD_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_NONE = 1 << 62
_BATCHED = 64
#: Different words (32 bytes each) and pieces (some 250) that a worker remembers before it forgets all of them.
_REMEMBER, _REMEMBER_PIECES = 1 << 19, 1 << 15


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Token -> id of a file of base64 tokens and ranks."""
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
    return {base64.b64decode(a): int(b) for a, b in pairs}


class Codec:
    """The pair ranks of a vocabulary in which every byte is a token; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.pattern = regex.compile(pattern)
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        top = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        # open addressing with linear probing; -1 marks a free slot
        keys = np.fromiter(pairs, np.int64, len(pairs))
        self.mask = (1 << max(4, int(len(keys) * 4).bit_length())) - 1
        self.keys, self.ranks = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, _NONE, np.int64)
        values, at = np.fromiter(pairs.values(), np.int64, len(pairs)), self._slot(keys)
        self.probes = 0
        while len(keys):
            self.probes += 1
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of several for one slot the last one stays
            done = self.keys[at] == keys
            self.ranks[at[done]] = values[done]
            keys, values, at = keys[~done], values[~done], (at[~done] + 1) & self.mask
        sizes = np.zeros(top, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        self.size = sizes
        self.start = np.cumsum(sizes) - sizes
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        self.bytes = np.frombuffer(b"".join(t for t, _ in by_rank), np.uint8)
        self._forget()
        self._forget_words()

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (((key ^ (key >> 32) * 0x9E3779B1) * 0x2545F4914F6CDD1D) >> 20) & self.mask

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a number above all ranks."""
        key = left << 32 | right
        at = self._slot(key)
        out = np.full(len(key), _NONE, np.int64)
        open_ = np.arange(len(key))
        for _ in range(self.probes):
            there = self.keys[at]
            hit = there == key[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            on = ~hit & (there != -1)
            open_, at = open_[on], (at[on] + 1) & self.mask
            if not len(open_):
                break
        return out

    def _forget(self) -> None:
        self.known = {}
        self.ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    def merge_one(self, piece: bytes) -> list[int]:
        """The ids of one piece by one segment tree."""
        n = len(piece)
        token = [int(self.byte_id[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        size = 1 << max(0, n - 1).bit_length()
        none, get = (_NONE, 0), self.pairs.get
        tree = [none] * (2 * size)
        for i in range(n - 1):
            rank = get(token[i] << 32 | token[i + 1])
            if rank is not None:
                tree[size + i] = (rank, i)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(i: int) -> None:
            j = after[i]
            rank = get(token[i] << 32 | token[j]) if j < n else None
            node = size + i
            tree[node] = none if rank is None else (rank, i)
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] is not none and tree[1][0] < _NONE:
            rank, i = tree[1]
            j = after[i]
            token[i], after[i] = rank, after[j]
            if after[j] < n:
                before[after[j]] = i
            token[j] = -1
            node = size + j
            tree[node] = none
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])
            update(i)
            if before[i] >= 0:
                update(before[i])
        return [t for t in token if t >= 0]

    def merge_many(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of ids of each) of pieces of at most `width` bytes, `width` a power of two."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        place = np.arange(width)
        live = place < sizes[:, None]
        token = np.full((n, width), -1, np.int64)
        token[live] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(place + 1, (n, width)).copy()
        before = np.broadcast_to(place - 1, (n, width)).copy()
        # a node holds rank * width + position, so its minimum is the leftmost of the least rank
        nothing = _NONE
        tree = np.full((n, 2 * width), nothing, np.int64)
        r, c = np.nonzero(place < sizes[:, None] - 1)
        rank = self.rank_of(token[r, c], token[r, c + 1])
        tree[r, width + c] = np.where(rank < _NONE, rank * width + c, nothing)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = tree[:, level : 2 * level].reshape(n, -1, 2).min(axis=2)
            level //= 2
        rows = np.flatnonzero(tree[:, 1] < nothing)
        flat = tree.reshape(-1)
        while len(rows):
            root = tree[rows, 1]
            i = root % width
            j = after[rows, i]
            beyond = after[rows, j]
            token[rows, i] = root // width
            token[rows, j] = -1
            after[rows, i] = beyond
            has = beyond < sizes[rows]
            before[rows[has], beyond[has]] = i[has]
            prior = before[rows, i]
            # leaves: j has no pair any more, i and its left neighbour have new ones
            cells = [(rows, j, np.full(len(rows), nothing, np.int64))]
            value = np.full(len(rows), nothing, np.int64)
            rank = self.rank_of(token[rows[has], i[has]], token[rows[has], beyond[has]])
            value[has] = np.where(rank < _NONE, rank * width + i[has], nothing)
            cells.append((rows, i, value))
            left = prior >= 0
            lr, lp = rows[left], prior[left]
            rank = self.rank_of(token[lr, lp], token[lr, i[left]])
            cells.append((lr, lp, np.where(rank < _NONE, rank * width + lp, nothing)))
            base = np.concatenate([a * (2 * width) for a, _, _ in cells])
            node = np.concatenate([b for _, b, _ in cells]) + width
            flat[base + node] = np.concatenate([v for _, _, v in cells])
            while node[0] > 1:  # all leaves are equally deep
                node >>= 1
                flat[base + node] = np.minimum(flat[base + 2 * node], flat[base + 2 * node + 1])
            rows = rows[tree[rows, 1] < nothing]
        kept = token >= 0
        return token[kept], kept.sum(axis=1)

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces and remember them."""
        raw = [p.encode() for p in pieces]
        groups: dict[int, list[int]] = {}
        for k, b in enumerate(raw):
            groups.setdefault(1 << max(0, len(b) - 1).bit_length() if len(b) <= _BATCHED else 0, []).append(k)
        number = len(self.known)
        ids, lengths = [], []
        for width, members in groups.items():
            if width:
                got, count = self.merge_many([raw[k] for k in members], width)
            else:
                each = [self.merge_one(raw[k]) for k in members]
                got, count = np.fromiter(chain.from_iterable(each), np.int64), np.array([len(e) for e in each])
            for k in members:
                self.known[pieces[k]] = number
                number += 1
            ids.append(got.astype(np.int32))
            lengths.append(count.astype(np.int64))
        self.ids, self.lengths = [np.concatenate([*self.ids, *ids])], [np.concatenate([*self.lengths, *lengths])]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        if len(self.known) > _REMEMBER_PIECES:
            self._forget()
        found = [self.pattern.findall(t) for t in texts]
        pieces = list(chain.from_iterable(found))
        new = set(pieces).difference(self.known)
        if new:
            self._learn(sorted(new))
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        number = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        ids, lengths = self.ids[0], self.lengths[0]
        heads = (np.cumsum(lengths) - lengths)[number]
        count = lengths[number]
        stop = np.cumsum(count)
        at = np.repeat(heads - (stop - count), count) + np.arange(stop[-1])
        per_piece = np.concatenate([[0], stop])
        ends = np.cumsum([len(f) for f in found])
        return ids[at], np.diff(np.concatenate([[0], per_piece[ends]]))

    def _forget_words(self) -> None:
        #: Hashes of the words known, in order, and the word's number for each; ids and their counts by number.
        self.word_keys, self.word_number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.word_ids, self.word_lengths = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The numbers of the words data[s:e], new ones being encoded and remembered."""
        unique, first, inverse = np.unique(run_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.word_keys) > _REMEMBER:
            self._forget_words()
        at = np.searchsorted(self.word_keys, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.word_keys)
        known[inside] = self.word_keys[at[inside]] == unique[inside]
        number = np.empty(len(unique), np.int32)
        number[known] = self.word_number[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            spans = zip(start[first[new]].tolist(), end[first[new]].tolist())
            got, lengths = self.encode([data[a:b].tobytes().decode() for a, b in spans])
            number[new] = np.arange(len(self.word_keys), len(self.word_keys) + len(new))
            self.word_keys, self.word_number = np.insert(self.word_keys, at[new], unique[new]), np.insert(self.word_number, at[new], number[new])
            self.word_ids, self.word_lengths = np.concatenate([self.word_ids, got.astype(np.int32)]), np.concatenate([self.word_lengths, lengths.astype(np.int32)])
        return number[inverse]

    def encode_texts(self, column: pa.Array, only_counts: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """encode of a column of texts, null ones being empty; words are known by 64-bit hashes of their bytes and length. With only_counts there are no ids."""
        column = column.fill_null("") if column.null_count else column
        if self.pattern.pattern != PATTERN:
            return self.encode(column.to_pylist())
        data, offsets = text_buffers(column)
        odd = pa.compute.match_substring_regex(column, _ODD_SPACE).to_numpy(zero_copy_only=False)
        words = Words(data, offsets)
        has = words.counts > 0
        start = np.empty_like(words.starts)
        start[1:] = words.ends[:-1]
        start[words.bounds[:-1][has]] = offsets[:-1][has]
        # white space behind the last word, or alone
        tail = offsets[:-1].copy()
        tail[has] = words.ends[words.bounds[1:][has] - 1]
        rest = np.flatnonzero(tail < offsets[1:])
        row, start, end = np.concatenate([words.row, rest]), np.concatenate([start, tail[rest]]), np.concatenate([words.ends, offsets[1:][rest]])
        order = np.lexsort((start, row))
        order = order[~odd[row[order]]]
        row, start, end = row[order], start[order], end[order]
        ids, counts = np.zeros(0, np.int32), np.zeros(len(column), np.int64)
        if len(row):
            number = self._numbers(data, start, end)
            count = self.word_lengths[number].astype(np.int64)
            counts = np.bincount(row, weights=count, minlength=len(column)).astype(np.int64)
            if not only_counts:
                stop = np.cumsum(count)
                heads = (np.cumsum(self.word_lengths, dtype=np.int64) - self.word_lengths)[number]
                ids = self.word_ids[np.repeat(heads - (stop - count), count) + np.arange(stop[-1])]
        if odd.any():
            more, lengths = self.encode(column.filter(pa.array(odd)).to_pylist())
            counts[odd] = lengths
            if not only_counts:
                of_odd = np.repeat(odd, counts)
                out = np.empty(len(of_odd), np.int32)
                out[of_odd], out[~of_odd] = more, ids
                ids = out
        return ids, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts in a row, number of bytes of each) of `counts` ids each."""
        size = self.size[ids]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        at = np.repeat(self.start[ids] - (stop - size), size) + np.arange(total)
        edges = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(counts)])]
        return self.bytes[at], np.diff(edges)


_codecs: dict[tuple[int, int, str], Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    """The codec of a broadcast vocabulary; a worker builds it once."""
    ranks = shared.value
    key = (id(ranks), len(ranks), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def _lists(ids: np.ndarray, counts: np.ndarray, null: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    mask = pa.array(null) if null.any() else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()), mask=mask)


def _others(df: DataFrame, name: str, new: tuple[str, ...]) -> list:
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in (name, *new)]


def encode_column(df: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """df without `text`, with `tokens` (ids of the text), `n_tokens` and `round_trip` (whether the decoded ids are the text).

    A null text has null tokens, 0 n_tokens and a null round_trip; an empty one has none and true.
    Other columns stay; earlier ones of the new names are replaced. Texts are encoded whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    plain = df.select(F.col("text").cast("string").alias("__wl_text"), *_others(df, "text", ("tokens", "n_tokens", "round_trip")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in chunks(batches, "__wl_text"):
            column = batch.column(0)
            ids, counts = codec.encode_texts(column)
            raw, sizes = codec.decode(ids, counts)
            data, offsets = text_buffers(column)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            if np.array_equal(ends, offsets) and np.array_equal(raw, data):
                same = np.ones(len(column), bool)
            else:
                same = np.array([np.array_equal(raw[s:e], data[a:b]) for s, e, a, b in zip(ends[:-1], ends[1:], offsets[:-1], offsets[1:])], bool)
            null = column.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], _lists(ids, counts, null), pa.array(counts.astype(np.int32)), pa.array(same, pa.bool_(), mask=null)],
                names=[*batch.schema.names[1:], "tokens", "n_tokens", "round_trip"],
            )

    new = [T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("round_trip", T.BooleanType())]
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields[1:], *new]))


def token_counts(df: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """df without `text`, with `n_tokens`, the number of its text's ids (0 for a null text); the ids themselves are not kept."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    plain = df.select(F.col("text").cast("string").alias("__wl_text"), *_others(df, "text", ("n_tokens",)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in chunks(batches, "__wl_text", 1 << 20):
            _, counts = codec.encode_texts(batch.column(0), only_counts=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts)], names=[*batch.schema.names[1:], "n_tokens"])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields[1:], T.StructField("n_tokens", T.LongType())]))


def decode_column(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """df without `tokens`, with `text`, the text of the ids. Null tokens give a null text; bytes that are no UTF-8 become U+FFFD, unknown or null ids raise."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    plain = df.select(F.col("tokens").cast("array<int>").alias("__wl_tokens"), *_others(df, "tokens", ("text",)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, PATTERN)
        for batch in batches:
            column = batch.column(0)
            counts = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten()
            ids = flat.to_numpy(zero_copy_only=False)
            if flat.null_count or (len(ids) and (ids.min() < 0 or ids.max() >= len(codec.size))):
                raise ValueError("an id that the vocabulary doesn't have")
            raw, sizes = codec.decode(ids.astype(np.int64), counts)
            ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            data, null = raw.tobytes(), column.is_null().to_pylist()
            texts = [None if n else data[s:e].decode("utf-8", "replace") for n, s, e in zip(null, ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*batch.schema.names[1:], "text"])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields[1:], T.StructField("text", T.StringType())]))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document's text, and whether they decode to it."""
    return encode_column(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
