"""Words of whole columns of text at once, in Python workers: the tokens that `text.composed_tokens_v2` cuts.

What a character is, and its lower case, comes from the JVM by way of the same expressions, so both
ways agree on every character. Texts with a character whose lower case depends on its neighbours or
is longer than one character are cut by the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text as X

WORD, JOINER = 1, 2
#: The capital sigma: its lower case depends on what stands behind it.
_SIGMA = 0x3A3
#: Bytes of text that are cut at once.
_PIECE = 1 << 18
#: Code points from here on are neither letters nor numbers: unassigned, tags and private use.
_LAST = 0x40000


@dataclass(frozen=True)
class Alphabet:
    """kind (WORD, JOINER or 0) and lower case of each code point; odd: the characters that only the JVM lowers rightly."""

    kind: np.ndarray
    lower: np.ndarray
    odd: str


_known: dict[str, Alphabet] = {}


def alphabet(spark: SparkSession) -> Alphabet:
    """The alphabet of this application's JVM, asked for once."""
    app = spark.sparkContext.applicationId
    if app not in _known:
        char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        chars = spark.range(1, _LAST).where("id < 55296 OR id > 57343").select("id", char.alias("char")).where(F.length("char") == 1)
        folded = chars.select("id", "char", X.fold(F.col("char"), compose=False).alias("low"))
        word = F.col("low").rlike(f"^{X.WORD}$")
        rows = folded.where((F.col("low") != F.col("char")) | word | F.col("char").isin("'", "-")).select("id", "low", word.alias("word")).toArrow()
        kind, lower, odd = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32), [chr(_SIGMA)]
        for i, low, is_word in zip(*(rows[c].to_pylist() for c in ("id", "low", "word"))):
            if len(low) != 1:
                odd.append(chr(i))
                continue
            lower[i], kind[i] = ord(low), WORD if is_word else JOINER if low in "'-" else 0
        _known[app] = Alphabet(kind, lower, "".join(odd))
    return _known[app]


def is_odd(text: Column, letters: Alphabet) -> Column:
    return text.rlike(f"[{letters.odd}]")


def _piece(data: np.ndarray, at: np.ndarray, letters: Alphabet) -> tuple[pa.Array, np.ndarray]:
    """(tokens, tokens in each text) of texts that lie behind each other in `data`, each from at[i] to at[i + 1]."""
    plain = not len(data) or data.max() < 128
    if plain:
        chars = data
    else:
        chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
    n = len(chars)
    kind = letters.kind[:128][chars] if plain else letters.kind[chars]
    first = np.zeros(n + 1, bool)
    first[at] = True
    inside = kind == WORD
    j = np.flatnonzero(kind == JOINER)
    j = j[(j > 0) & (j < n - 1)]
    inside[j[inside[j - 1] & inside[j + 1] & ~first[j] & ~first[j + 1]]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    starts = np.flatnonzero(begins)
    stops = np.concatenate([[0], np.cumsum(np.flatnonzero(ends) - starts + 1)])
    kept = (letters.lower[:128].astype(np.uint8) if plain else letters.lower)[chars[inside]]
    if plain:
        body = kept
    else:
        stops = np.concatenate([[0], np.cumsum(1 + (kept >= 0x80).astype(np.int8) + (kept >= 0x800) + (kept >= 0x10000))])[stops]
        body = np.frombuffer(kept.tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
    tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(body)))
    return tokens, np.diff(np.searchsorted(starts, at))


def split(texts: pa.Array, letters: Alphabet) -> tuple[pa.Array, np.ndarray]:
    """(tokens of all texts behind each other, number of tokens of each text); a null text has none."""
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    parts, sizes, at = [], [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _PIECE, side="right")) - 1)
        tokens, counts = _piece(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], letters)
        parts.append(tokens)
        sizes.append(counts)
        at = to
    return pa.concat_arrays(parts), np.concatenate(sizes)


def with_cut(tokens: pa.Array, sizes: np.ndarray, lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """tokens and sizes with the tokens of the rows that have a list (those of odd texts) in their places."""
    if lists.null_count == len(lists):
        return tokens, sizes
    other = lists.fill_null([]) if lists.null_count else lists
    cut = np.asarray(pa.compute.list_value_length(other).to_numpy(zero_copy_only=False), np.int64)
    odd = np.asarray(lists.is_valid().to_numpy(zero_copy_only=False), bool)
    starts = np.where(odd, len(tokens) + np.cumsum(cut) - cut, np.cumsum(sizes) - sizes)
    sizes = np.where(odd, cut, sizes)
    order = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return pa.concat_arrays([tokens, other.flatten().cast(pa.string())]).take(pa.array(order)), sizes
