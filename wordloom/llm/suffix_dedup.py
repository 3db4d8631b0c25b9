"""Operator 1: removal of repeated passages by suffix arrays and longest-previous-factor arrays.

A passage is `min_words` words (maximal runs without ASCII white space). A word goes if it lies
in a passage that also starts at an earlier place; places are ordered by (doc_id, word number),
so the first copy stays. Each word owns the white space behind it, and both go together.

The suffixes of a whole corpus need not be sorted. Any two equal passages select the same
minimiser among their k-word grams, so they meet in the group of that anchor, each inside the
segment of words that passages around the anchor can cover:

1. one scan emits (anchor, hash of the segment, place), about one row for nine words; of equal
   segments among the texts at hand only the first goes on, the others being later copies for
   sure, so that a passage in a large share of all documents is mostly settled before anything
   is shuffled. Anchors that occur once are dropped, which is exact;
2. of segments that are equal as a whole the first one stays for comparison and all words of
   the others are covered;
3. anchors with several distinct segments fetch the words of these, and each group gets its
   suffix array (prefix doubling), and by previous and next smaller places in suffix order
   the longest previous factor of each place; factors of min_words or more are covered;
4. an anchor with more than `hot` distinct segments would be too large a group: its segments are
   taken apart into the passages of min_words words that hold the anchor, which is all that can
   be equal in it, and each passage's occurrences are sorted; all but the first are covered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm._store import Workspace
from wordloom.llm._text import Words, chunks, release, run_hashes, text_buffers

MIN_WORDS = 50
GRAM = 25

_ANCHORS = "anchor long, seg long, doc_id long, place long, later boolean"
#: Distinct segments of an anchor that are compared by a suffix array.
HOT = 20_000
#: Anchors of texts that are looked at together.
_HELD = 1 << 18
_SEGMENTS = "anchor long, doc_id long, at int, words binary"
_EDITS = "doc_id long, at int, n int, hash long"


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the rightmost minimum of each window of `width` values."""
    best, place, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[: len(best) - step], best[step:]
        later = right <= left
        place = np.where(later, place[step:], place[: len(place) - step])
        best = np.where(later, right, left)
        have += step
    return place


def anchors_of(words: Words, min_words: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor's word, its hash, first and last word of its segment) of a chunk of texts."""
    width = min_words - gram + 1
    first, hashes = words.grams(gram)
    if len(first) < width:
        return (np.zeros(0, np.int64),) * 4
    place = _sliding_argmin(hashes, width)
    inside = words.row[first[: len(place)]] == words.row[first[width - 1 :][: len(place)]]
    chosen = np.unique(place[inside])
    at = first[chosen]
    row = words.row[at]
    low = np.maximum(at - (width - 1), words.bounds[row])
    high = np.minimum(at + min_words, words.bounds[row + 1])
    return at, hashes[chosen], low, high


def _emit_anchors(min_words: int, gram: int):
    def emit(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        anchor, seg, doc, place = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((place, doc, seg, anchor))
        anchor, seg, doc, place = anchor[order], seg[order], doc[order], place[order]
        same = np.zeros(len(order), bool)
        same[1:] = (anchor[1:] == anchor[:-1]) & (seg[1:] == seg[:-1])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        later = (doc != doc[first]) | (place != place[first])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, seg, doc, place, later)], names=["anchor", "seg", "doc_id", "place", "later"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in chunks(batches, "text"):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            words = Words(*text_buffers(batch.column(1)))
            at, anchor, low, high = anchors_of(words, min_words, gram)
            row = words.row[at]
            place = (at - words.bounds[row]) << 16 | (at - low) << 8 | (high - at)
            held.append((anchor.astype(np.uint64).view(np.int64), run_hashes(words.hashes, low, high).view(np.int64), ids[row].astype(np.int64), place))
            size += len(at)
            if size >= _HELD:
                yield emit(held)
                held, size = [], 0
        if held:
            yield emit(held)

    return run


def _fetch_segments(min_words: int):
    """Words of the wanted segments: rows (text, doc_id, wanted: list of (anchor, seg, at, n, hot)); of hot ones their passages, each under its own hash and without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = Words(*text_buffers(batch.column(0)))
            row, anchor, seg, at, n, hot = _wanted(batch.column(2), ["anchor", "seg", "at", "n", "hot"])
            low = words.bounds[row] + at
            high = np.minimum(low + n, words.bounds[row + 1])
            fits = (low + n) <= words.bounds[row + 1]
            same = run_hashes(words.hashes, np.minimum(low, high), high).view(np.int64) == seg
            keep = np.flatnonzero(fits & same & (hot == 0))
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            raw = words.hashes.tobytes()
            apart = np.flatnonzero(fits & same & (hot != 0))
            each = np.maximum(n[apart] - min_words + 1, 0)
            owner = np.repeat(apart, each)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
            begin = low[owner] + inner
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([anchor[keep], run_hashes(words.hashes, begin, begin + min_words).view(np.int64)])),
                    pa.array(ids[np.concatenate([row[keep], row[owner]])].astype(np.int64)),
                    pa.array(np.concatenate([at[keep], at[owner] + inner]).astype(np.int32)),
                    pa.array([raw[8 * a : 8 * b] for a, b in zip(low[keep].tolist(), high[keep].tolist())] + [None] * len(owner), pa.binary()),
                ],
                names=["anchor", "doc_id", "at", "words"],
            )

    return run


def _wanted(column: pa.Array, fields: list[str]) -> list[np.ndarray]:
    """(row, fields...) of a column of lists of structs; a null list is empty."""
    flat = column.flatten()
    row = pa.compute.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return [row, *(flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(fields)))]


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of the keys from 1 on; equal keys share theirs."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32)
    return out


def suffix_ranks(values: np.ndarray, ends: np.ndarray, limit: int) -> list[tuple[int, np.ndarray]]:
    """(length, rank of each place by its first `length` values) for lengths 1, 2, 4... and limit.

    Places are ranked by prefix doubling; a run that is cut by its end (ends[i], the end of the
    string that holds place i) ranks before all longer ones and equal only to itself in content.
    """
    n = len(values)
    rank = _dense(values)
    out = [(1, rank)]
    length = 1
    while length < limit:
        step = min(length, limit - length)
        keys = rank.astype(np.int64)
        keys *= n + 2
        inside = np.arange(step, n, dtype=np.int32) < ends[: max(n - step, 0)]
        keys[: len(inside)] += np.where(inside, rank[step:], 0)
        rank = _dense(keys)
        length += step
        out.append((length, rank))
    return out


#: Places whose common prefixes are measured together.
_PREFIXES = 1 << 17


def longest_previous_factors(values: np.ndarray, ends: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Length, up to `limit`, of the longest run from each place that also starts at a place earlier in `order`.

    values: the strings' symbols in a row, less than 2**31 of them; ends: for each place the end
    of its string. Places of equal `order` are the same place and don't count as earlier. The
    suffix array comes from prefix doubling. In suffix order the nearest entry on either side
    with a smaller order shares the longest prefix that any earlier place shares.
    """
    n = len(values)
    if n == 0:
        return np.zeros(0, np.int32)
    ranks = suffix_ranks(values, ends, limit)
    suffix = np.lexsort((order, ranks[-1][1])).astype(np.int32)
    key = order[suffix]
    best = np.zeros(n, np.int32)
    for back in (False, True):
        near = _nearest_smaller(key[::-1] if back else key)
        if back:
            near = n - 1 - near[::-1]
        for i in range(0, n, _PREFIXES):
            part = near[i : i + _PREFIXES]
            there = np.flatnonzero((part >= 0) & (part < n))
            a, b = suffix[i + there], suffix[part[there]]
            best[a] = np.maximum(best[a], _common(ranks, ends, a, b, limit))
    return best


def _nearest_smaller(key: np.ndarray) -> np.ndarray:
    """Nearest index to the left with a smaller key, or -1, by pointer jumping."""
    near = np.arange(-1, len(key) - 1, dtype=np.int32)
    open_ = np.flatnonzero((near >= 0) & (key[near] >= key)).astype(np.int32)
    while len(open_):
        near[open_] = near[near[open_]]
        at = near[open_]
        open_ = open_[(at >= 0) & (key[at] >= key[open_])]
    return near


def _common(ranks, ends: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of places a and b, up to limit, from the ranks of doubled lengths."""
    length = np.zeros(len(a), np.int32)
    last = len(ends) - 1
    for size, rank in reversed(ranks):
        x, y = a + length, b + length
        room = (x + size <= ends[a]) & (y + size <= ends[b]) & (length + size <= limit)
        same = room & (rank[np.minimum(x, last)] == rank[np.minimum(y, last)])
        length += np.where(same, size, 0).astype(np.int32)
    return length


def _covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n places lie in a run that begins at a start."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + lengths, n), -1)
    return np.cumsum(change[:-1]) > 0


def _runs(mask: np.ndarray, string: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of True that stay inside one string."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.empty(len(mask), bool)
    cut[0] = True
    cut[1:] = (string[1:] != string[:-1]) | ~mask[:-1]
    start = np.flatnonzero(mask & cut)
    cut[:-1] = (string[1:] != string[:-1]) | ~mask[1:]
    cut[-1] = True
    return start, np.flatnonzero(mask & cut) + 1


#: Words of segments whose groups are sorted together; a larger group is sorted alone.
_SORT_WORDS = 1 << 18


def _compare(min_words: int):
    def solve(held: list[tuple[pa.RecordBatch, int, int]]) -> pa.RecordBatch:
        t = pa.Table.from_batches([batch.slice(a, b - a) for batch, a, b in held])
        held.clear()
        anchor, doc, at = (t.column(i).to_numpy().astype(np.int64) for i in range(3))
        data, offsets = text_buffers(t.column(3))
        del t
        raw, heads = data.view(np.uint64), (offsets // 8).astype(np.int32)
        sizes = np.diff(heads)
        string = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        ends = heads[1:][string]
        shift = at - heads[:-1]  # from a place to the word number in its text
        # a word counts as equal only inside its own anchor's group
        values = _dense(raw).astype(np.int64)
        values *= len(anchor) + 1
        values += _dense(anchor)[string]
        values = _dense(values)
        # places by (doc_id, word number); a word number is below 2**31
        keys = (_dense(doc).astype(np.int64) << 32)[string]
        keys += shift[string]
        keys += np.arange(len(raw), dtype=np.int32)
        order = _dense(keys)
        del keys
        factor = longest_previous_factors(values, ends, order, min_words)
        start = np.flatnonzero(factor >= min_words)
        mask = _covered(len(raw), start, factor[start])
        low, high = _runs(mask, string)
        owner = string[low]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(doc[owner]),
                pa.array((shift[owner] + low).astype(np.int32)),
                pa.array((high - low).astype(np.int32)),
                pa.array(run_hashes(raw, low, high).view(np.int64)),
            ],
            names=["doc_id", "at", "n", "hash"],
        )

    def passages(batch: pa.RecordBatch, before: tuple[int, int, int] | None) -> tuple[pa.RecordBatch, tuple[int, int, int]]:
        """Edits of the passages that aren't the first of theirs; `before` is the first one (hash, doc_id, at) of the passage that the last batch ended in."""
        key, doc, at = (batch.column(i).to_numpy().astype(np.int64) for i in range(3))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        goes_on = before is not None and before[0] == key[0]
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        first_doc, first_at = doc[first], at[first]
        if goes_on:
            first_doc[first == 0], first_at[first == 0] = before[1], before[2]
        later = np.flatnonzero((doc != first_doc) | (at != first_at))
        out = [pa.array(doc[later]), pa.array(at[later].astype(np.int32)), pa.array(np.full(len(later), min_words, np.int32)), pa.array(key[later])]
        return pa.RecordBatch.from_arrays(out, names=["doc_id", "at", "n", "hash"]), (int(key[-1]), int(first_doc[-1]), int(first_at[-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, int, int]] = []  # rows of whole groups
        group: list[tuple[pa.RecordBatch, int, int]] = []  # rows so far of the last group
        held_words = group_words = 0
        last, before = None, None
        for batch in batches:  # sorted by anchor, doc_id and place
            bare = batch.column(3).is_null()
            if bare.true_count:
                found, before = passages(batch.filter(bare), before)
                yield found
                batch = batch.filter(pa.compute.invert(bare))
            anchor = batch.column(0).to_numpy()
            if not len(anchor):
                continue
            words = text_buffers(batch.column(3))[1] // 8
            cuts = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), len(anchor)]
            for a, b, n in zip(cuts, cuts[1:], np.diff(words[cuts]).tolist()):
                if anchor[a] != last:
                    held += group
                    held_words += group_words
                    group, group_words, last = [], 0, anchor[a]
                if held and held_words + group_words + n > _SORT_WORDS:
                    yield solve(held)
                    held_words = 0
                group.append((batch, a, b))
                group_words += n
        held += group
        group = []
        if held:
            yield solve(held)
        release()

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their covered words: rows (..., text, edits) lose the column of edits."""
    for whole in batches:
        names = whole.schema.names
        for batch in chunks(iter([whole]), "__wl_text"):
            column = batch.column(names.index("__wl_text"))
            data, offsets = text_buffers(column)
            words = Words(data, offsets)
            row, at, n, hash_ = _wanted(batch.column(names.index("__wl_edits")), ["at", "n", "hash"])
            low = words.bounds[row] + at
            fits = (low + n) <= words.bounds[row + 1]
            low, n, hash_ = low[fits], n[fits], hash_[fits]
            same = run_hashes(words.hashes, low, low + n).view(np.int64) == hash_
            gone = _covered(len(words.starts), low[same], n[same])
            # a word's bytes reach to the start of the next word of its text, or to the text's end
            until = np.empty(len(gone), np.int64)
            if len(gone):
                until[:-1] = words.starts[1:]
                until[-1] = offsets[-1]
                tail = words.bounds[1:][words.counts > 0] - 1
                until[tail] = offsets[1:][words.counts > 0]
            start, end = _runs(gone, words.row)
            change = np.zeros(len(data) + 1, np.int32)
            if len(start):
                np.add.at(change, words.starts[start], 1)
                np.add.at(change, until[end - 1], -1)
            kept = np.cumsum(change[:-1], dtype=np.int32) == 0
            sizes = np.zeros(len(data) + 1, np.int32)  # a text column of a batch has less than 2**31 bytes
            np.cumsum(kept, dtype=np.int32, out=sizes[1:])
            texts = pa.Array.from_buffers(
                pa.string(),
                batch.num_rows,
                [None, pa.py_buffer(sizes[offsets].astype(np.int32)), pa.py_buffer(data[kept].tobytes())],
            )
            if column.null_count:
                texts = pa.compute.if_else(column.is_valid(), texts, pa.scalar(None, pa.string()))
            arrays = [texts if name == "__wl_text" else batch.column(i) for i, name in enumerate(names) if name != "__wl_edits"]
            yield pa.RecordBatch.from_arrays(arrays, names=[n for n in names if n != "__wl_edits"])


def apply_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs without the words that edits (doc_id, at, n, hash) cover; an edit holds where the hash does."""
    by_doc = edits.groupBy(F.col("doc_id").alias("__wl_id")).agg(F.collect_list(F.struct("at", "n", "hash")).alias("__wl_edits"))
    joined = docs.join(by_doc, F.col("doc_id").cast("long") == F.col("__wl_id"), "left")
    rest = [c for c in docs.columns if c != "text"]
    schema = T.StructType([T.StructField("__wl_text", T.StringType()), *(docs.schema[c] for c in rest)])
    wide = joined.select(F.col("text").alias("__wl_text"), *(F.col(_q(c)) for c in rest), "__wl_edits")
    cleaned = wide.mapInArrow(_apply, schema)
    return cleaned.select(*(F.col("__wl_text").alias("text") if c == "text" else F.col(_q(c)) for c in docs.columns))


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def repeated_passages(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, work: Workspace | None = None, hot: int = HOT) -> DataFrame:
    """The words to remove: (doc_id, at, n, hash of these words), by rows that may overlap.

    Rows with a null doc_id or text neither lose words nor count as earlier copies. Rows that
    share a doc_id share their places, so none of them is earlier than another at the same word.
    """
    if not 1 <= gram <= min_words <= 200:
        raise ValueError("1 <= gram <= min_words <= 200 must hold")
    work = work or Workspace(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = work.save(texts.mapInArrow(_emit_anchors(min_words, gram), _ANCHORS), "anchors")
    left, right = F.expr("cast((place >> 8) & 255 AS int)"), F.expr("cast(place & 255 AS int)")
    at, n = (F.expr("cast(place >> 16 AS int)") - left).alias("at"), (left + right).alias("n")
    settled = found.where("later").select("doc_id", at, n, F.col("seg").alias("hash"))
    found = found.where("NOT later").drop("later")
    by_anchor = Window.partitionBy("anchor")
    marked = (
        found.withColumn("low", F.min("seg").over(by_anchor))
        .withColumn("high", F.max("seg").over(by_anchor))
        .withColumn("rows", F.count("*").over(by_anchor))
        .withColumn("first_doc", F.first("doc_id").over(Window.partitionBy("anchor", "seg").orderBy("doc_id", "place")))
        .withColumn("first_place", F.first("place").over(Window.partitionBy("anchor", "seg").orderBy("doc_id", "place")))
    )
    first = (F.col("doc_id") == F.col("first_doc")) & (F.col("place") == F.col("first_place"))
    several: Column = F.col("low") != F.col("high")
    spots = work.save(marked.where(~first | several).select("anchor", "seg", "doc_id", at, n, first.alias("first"), (F.col("rows") > hot).cast("long").alias("hot")), "spots")
    wanted = (
        spots.where("first")
        .dropDuplicates(["anchor", "seg", "doc_id", "at"])
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.collect_list(F.struct("anchor", "seg", F.col("at").cast("long").alias("at"), F.col("n").cast("long").alias("n"), "hot")).alias("wanted"))
    )
    segments = texts.join(wanted, F.col("doc_id") == F.col("id")).select("text", "doc_id", "wanted").mapInArrow(_fetch_segments(min_words), _SEGMENTS)
    partial = segments.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "at").mapInArrow(_compare(min_words), _EDITS)
    whole = spots.where("NOT first").select("doc_id", "at", "n", F.col("seg").alias("hash"))
    return work.save(settled.unionByName(whole).unionByName(partial).distinct(), "edits")


def remove_repeats(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs, all rows and columns, whose texts have lost their later copies of passages.

    A text shorter than min_words is unchanged, a text that is a later copy as a whole becomes
    the empty string (or its leading white space). Null texts stay null. See repeated_passages.
    """
    return apply_edits(docs, repeated_passages(spark, docs, min_words, gram, hot=hot))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their later copies of passages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(spark, docs)


ORACLE = rf"""
WITH pieces AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x09-\x0D\x20]+[\x09-\x0D\x20]*') AS p FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
words AS (SELECT doc_id, list_transform(p, lambda x: rtrim(x, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ')) AS w FROM pieces),
grams AS (SELECT doc_id, i, md5(array_to_string(w[i:i+{MIN_WORDS - 1}], chr(10))) AS h
  FROM words, unnest(range(1, len(w) - {MIN_WORDS - 2})) AS t(i) WHERE len(w) >= {MIN_WORDS}),
ranked AS (SELECT doc_id, i, min((doc_id, i)) OVER (PARTITION BY h) AS first FROM grams),
gone AS (SELECT DISTINCT doc_id, i + j AS k FROM ranked, unnest(range(0, {MIN_WORDS})) AS t(j) WHERE (doc_id, i) <> first),
kept AS (SELECT p.doc_id, string_agg(p.x, '' ORDER BY p.k) AS rest FROM
  (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM pieces) p
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.k = p.k) GROUP BY p.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL WHEN d.doc_id IS NULL THEN d.text
    ELSE regexp_extract(d.text, '^[\x09-\x0D\x20]*') || coalesce(k.rest, '') END AS text, d.lang, d.source, d.n_chars
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
