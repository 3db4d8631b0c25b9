"""Operator 5: quality rules as a short-circuit cascade.

A rule is a condition that rejects a document. Each rule's cost (seconds a row) and selectivity
(share it rejects) are measured on a sample: inside one job every task times each rule on the
first rows of its partition, several times over, each time from the bare texts. The rules then
run in order of rejections per cost, the best first; a rule looks only at what those before it
left, and what a rule has derived from the texts (words, lines) serves those behind it. The
order decides the time only: a document is kept iff no rule rejects it.

Rules look at the whole text, count in integers, and spare short texts where a share would mean
little. The last rule, "marked words", is learned: the words that at least `MIN_TOXIC` of a
bounded sample of labelled documents hold, four in five of them or more labelled toxic; a text
with `MIN_MARKED` different ones is rejected. Nothing of it is written down here, so that other
labels give other words.
"""

from __future__ import annotations

import math
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm._text import PLAIN, Words, chunks, distinct, run_hashes, text_buffers

#: The sample is so many first rows of each of the first so many partitions.
SAMPLE_ROWS, SAMPLE_PARTS = 256, 16
#: Each rule is timed so often on it; the least time counts.
REPEATS = 3
#: Bound of the labelled documents that the marked words are learned from.
TRAIN_ROWS = 4000
MIN_TOXIC, MIN_MARKED = 4, 2
#: Different words are counted in blocks of so many and added up: of a text of a word repeated they are few at any length, of plain prose they grow with it.
BLOCK = 1000

_SYMBOLS = "#$%&*|{}<>=@^~_"


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars.encode())] = 1
    return out


_UPPER = "".join(map(chr, range(65, 91)))
_CLASSES = {
    "symbols": _table(_SYMBOLS),
    "upper": _table(_UPPER),
    "letters": _table(_UPPER + _UPPER.lower()),
    "marks": _table("!?"),
    "chars": np.array([(b & 0xC0) != 0x80 for b in range(256)], np.uint8),
    "solid": np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)], np.uint8),
}


class Texts:
    """Texts that are still in question; what rules derive from them is kept."""

    def __init__(self, column: pa.Array):
        self.column = column
        self.data, self.offsets = text_buffers(column)
        self.n = len(column)
        self._counts: dict[str, np.ndarray] = {}

    def count(self, kind: str) -> np.ndarray:
        """Bytes of a class in each text."""
        if kind not in self._counts:
            self._counts[kind] = self._sums(_CLASSES[kind][self.data])
        return self._counts[kind]

    def _sums(self, per_byte: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        rows = np.flatnonzero(np.diff(self.offsets))
        if len(rows):
            out[rows] = np.add.reduceat(per_byte, self.offsets[rows], dtype=np.int64)
        return out

    @cached_property
    def words(self) -> Words:
        return Words(self.data, self.offsets, lower=True)

    @cached_property
    def plain_words(self) -> Words:
        return Words(self.data, self.offsets, lower=True, of=PLAIN)

    @cached_property
    def n_words(self) -> np.ndarray:
        if "words" in self.__dict__:
            return self.words.counts
        solid = _CLASSES["solid"][self.data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] & 1
        heads = self.offsets[:-1]
        heads = heads[heads < len(solid)]
        begins[heads] = solid[heads]
        return self._sums(begins)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(lines, different lines) of each text."""
        ends = np.flatnonzero(self.data == 10)
        row = np.searchsorted(self.offsets, ends, side="right") - 1
        row, at = np.concatenate([row, np.arange(self.n)]), np.concatenate([ends, self.offsets[1:]])
        order = np.lexsort((at, row))
        row, at = row[order], at[order]
        start = np.empty_like(at)
        start[1:] = at[:-1] + 1
        first = np.searchsorted(row, np.arange(self.n))
        start[first] = self.offsets[:-1]
        different, _ = distinct(row, run_hashes(self.data, start, at))
        return np.bincount(row, minlength=self.n), np.bincount(different, minlength=self.n)

    def different_words(self) -> np.ndarray:
        w = self.words
        block = (np.arange(len(w.row)) - w.bounds[w.row]) // BLOCK
        most = int(block.max(initial=0)) + 1
        cell, _ = distinct(w.row * most + block, w.hashes)
        return np.bincount(cell // most, minlength=self.n)

    def stutters(self) -> np.ndarray:
        w = self.words
        again = (w.hashes[1:] == w.hashes[:-1]) & (w.row[1:] == w.row[:-1])
        return np.bincount(w.row[1:][again], minlength=self.n)

    def marked(self, hashes: np.ndarray) -> np.ndarray:
        """Different words of each text that are among the sorted hashes."""
        w = self.plain_words
        if not len(hashes):
            return np.zeros(self.n, np.int64)
        at = np.minimum(np.searchsorted(hashes, w.hashes), len(hashes) - 1)
        hit = hashes[at] == w.hashes
        return np.bincount(distinct(w.row[hit], w.hashes[hit])[0], minlength=self.n)


@dataclass(frozen=True)
class Rule:
    """name; test: which of the texts it rejects; duck: the same condition on `text` as DuckDB SQL."""

    name: str
    test: Callable[[Texts], np.ndarray]
    duck: str


_PLAIN_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_D_WORDS = r"regexp_extract_all(translate(text, '" + _UPPER + "', '" + _UPPER.lower() + r"'), '[^\x09-\x0D\x20]+')"
_D_PLAIN = r"regexp_extract_all(translate(text, '" + _UPPER + "', '" + _UPPER.lower() + r"'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_D_LINES = "string_split(text, chr(10))"


def _d_count(chars: str) -> str:
    return f"len(regexp_extract_all(text, '{chars}'))"


RULES: tuple[Rule, ...] = (
    Rule("empty", lambda t: t.count("solid") == 0, r"NOT regexp_matches(text, '[^\x09-\x0D\x20]')"),
    Rule("symbols", lambda t: (20 * t.count("symbols") > t.count("chars")) & (t.count("chars") >= 20), f"20 * (length(text) - length(translate(text, '{_SYMBOLS}', ''))) > length(text) AND length(text) >= 20"),
    Rule("shouting", lambda t: (10 * t.count("upper") > 6 * t.count("letters")) & (t.count("letters") >= 40), f"10 * {_d_count('[A-Z]')} > 6 * {_d_count('[A-Za-z]')} AND {_d_count('[A-Za-z]')} >= 40"),
    Rule("long words", lambda t: (t.count("chars") > 25 * t.n_words) & (t.n_words >= 20), f"length(text) > 25 * len({_D_WORDS}) AND len({_D_WORDS}) >= 20"),
    Rule("marks", lambda t: (10 * t.count("marks") > 3 * t.n_words) & (t.n_words >= 20), f"10 * {_d_count('[!?]')} > 3 * len({_D_WORDS}) AND len({_D_WORDS}) >= 20"),
    Rule(
        "few different words",
        lambda t: (5 * t.different_words() < t.words.counts) & (t.words.counts >= 50),
        f"[5 * list_sum([len(list_distinct(w[i + 1 : i + {BLOCK}])) for i in range(0, len(w), {BLOCK})]) < len(w) AND len(w) >= 50 for w in [{_D_WORDS}]][1]",
    ),
    Rule("stutter", lambda t: (10 * t.stutters() > 3 * t.words.counts) & (t.words.counts >= 20), f"[10 * len([i for i in range(2, len(w) + 1) if w[i] = w[i - 1]]) > 3 * len(w) AND len(w) >= 20 for w in [{_D_WORDS}]][1]"),
    Rule("repeated lines", lambda t: (5 * t.lines[1] < 2 * t.lines[0]) & (t.lines[0] >= 5), f"5 * len(list_distinct({_D_LINES})) < 2 * len({_D_LINES}) AND len({_D_LINES}) >= 5"),
)


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> list[str]:
    """The marked words, in order, of the documents of the `train_rows` labelled ids whose MD5 sums are the lowest.

    An id is toxic if any of its labels is; null ids and labels, and null texts, teach nothing.
    Rows of one id count each. Words are runs of characters other than ASCII punctuation and
    white space, without regard to ASCII case.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("__wl_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("__wl_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.md5(F.col("__wl_id").cast("string")), "__wl_id").limit(train_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("__wl_id"), F.col("text").cast("string").alias("text"))
    # the chosen ids are train_rows at most, so this side stays small at any size
    taught = texts.where("text IS NOT NULL").join(F.broadcast(chosen), "__wl_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad: Counter[bytes] = Counter()
        all_: Counter[bytes] = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(_PLAIN_WORD.findall(text.encode().lower()))
                all_.update(words)
                if toxic > 0:
                    bad.update(words)
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in all_], pa.string()), pa.array([bad[w] for w in all_], pa.int64()), pa.array(list(all_.values()), pa.int64())], names=["word", "a", "n"])

    found = taught.select("text", "toxic").mapInArrow(run, "word string, a long, n long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    return sorted(r["word"] for r in found.where(f"a >= {MIN_TOXIC} AND 5 * a >= 4 * n").select("word").collect())


def marked_words(words: list[str]) -> Rule:
    """The rule that rejects texts with MIN_MARKED different ones of the words."""
    raw = [w.encode() for w in words]
    stops = np.cumsum([len(b) for b in raw]) if raw else np.zeros(0, np.int64)
    heads = stops - np.array([len(b) for b in raw], np.int64) if raw else stops
    hashes = np.sort(run_hashes(np.frombuffer(b"".join(raw), np.uint8), heads, stops)) if raw else np.zeros(0, np.uint64)
    return Rule("marked words", lambda t: t.marked(hashes) >= MIN_MARKED, f"len(list_intersect(list_distinct({_D_PLAIN}), (SELECT coalesce(list(word), []) FROM marked))) >= {MIN_MARKED}")


def judge(column: pa.Array, rules: tuple[Rule, ...]) -> np.ndarray:
    """Which texts no rule rejects, by the cascade in the given order; null texts count as empty."""
    alive = np.arange(len(column))
    texts, here = Texts(column), np.ones(len(column), bool)
    for rule in rules:
        here &= ~rule.test(texts)
        left = int(here.sum())
        if not left:
            return np.zeros(len(column), bool)
        if 4 * left < 3 * texts.n:  # go on with the remaining texts alone
            alive = alive[here]
            texts, here = Texts(texts.column.filter(pa.array(here))), np.ones(left, bool)
    kept = np.zeros(len(column), bool)
    kept[alive[here]] = True
    return kept


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, parts: int = SAMPLE_PARTS) -> list[dict]:
    """For each rule: name, cost in seconds a row, rejected share, and gain = rejected / cost, on the first `rows` rows of the first `parts` partitions; zeros if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() >= parts:
            return
        taken, left = [], rows
        for batch in batches:
            taken.append(batch.slice(0, left))
            left -= taken[-1].num_rows
            if not left:
                break
        n = rows - left
        if not n:
            return
        column = pa.Table.from_batches(taken).column(0).combine_chunks()
        times, rejected = [], []
        for rule in rules:
            spent = []
            for _ in range(REPEATS):
                began = time.perf_counter()
                hit = rule.test(Texts(column))
                spent.append(time.perf_counter() - began)
            times.append(min(spent))
            rejected.append(int(hit.sum()))
        yield pa.RecordBatch.from_arrays([pa.array(list(range(len(rules)))), pa.array(times), pa.array([n] * len(rules)), pa.array(rejected)], names=["rule", "seconds", "n", "rejected"])

    timed = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "rule long, seconds double, n long, rejected long")
    found = {r["rule"]: r for r in timed.groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("n").alias("n"), F.sum("rejected").alias("rejected")).collect()}
    out = []
    for i, rule in enumerate(rules):
        r = found.get(i)
        cost, rejected = (r["seconds"] / r["n"], r["rejected"] / r["n"]) if r else (0.0, 0.0)
        out.append({"name": rule.name, "cost": cost, "rejected": rejected, "gain": rejected / max(cost, 1e-12)})
    return out


def order_rules(rules: tuple[Rule, ...], measured: list[dict]) -> list[Rule]:
    """Rules by rejections per cost, the highest first; equal ones by cost, then in the given order."""
    by_name = {m["name"]: m for m in measured}
    return sorted(rules, key=lambda r: (-by_name[r.name]["gain"], by_name[r.name]["cost"] if math.isfinite(by_name[r.name]["cost"]) else 0))


def keep_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs, all columns, that no rule rejects. Null, empty and blank texts are rejected by the rule "empty"; repeated rows are judged alike, nulls elsewhere don't matter."""
    ordered = tuple(order_rules(rules, measure(docs, rules)))
    fields = docs.schema.fields
    place = [f.name.lower() for f in fields].index("text")
    # columns travel under their places, so that no name can clash; a text that isn't a string goes along as one
    cols = [F.col("`" + f.name.replace("`", "``") + "`").alias(f"__wl_{i}") for i, f in enumerate(fields)]
    at = place
    if not isinstance(fields[place].dataType, T.StringType):
        cols.append(F.col("text").cast("string").alias(f"__wl_{len(fields)}"))
        at = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, f"__wl_{at}"):
            kept = judge(batch.column(at), ordered)
            if kept.any():
                yield batch.select(list(range(len(fields)))).filter(pa.array(kept))

    kept = docs.select(*cols).mapInArrow(run, T.StructType([T.StructField(f"__wl_{i}", f.dataType) for i, f in enumerate(fields)]))
    return kept.select(*(F.col(f"__wl_{i}").alias(f.name) for i, f in enumerate(fields)))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that no rule rejects, the marked words being learned from `labels`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return keep_quality(docs, rules_of(spark, sf_dir))


def rules_of(spark: SparkSession, sf_dir: str) -> tuple[Rule, ...]:
    """RULES and the marked words of the labelled documents in sf_dir."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return (*RULES, marked_words(learn(docs, labels)))


ORACLE = f"""
WITH known AS (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
chosen AS (SELECT * FROM known ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {TRAIN_ROWS}),
taught AS (SELECT toxic > 0 AS bad, unnest(list_distinct({_D_PLAIN})) AS word FROM documents JOIN chosen USING (doc_id) WHERE text IS NOT NULL),
marked AS (SELECT word FROM taught GROUP BY word HAVING count(*) FILTER (WHERE bad) >= {MIN_TOXIC} AND 5 * count(*) FILTER (WHERE bad) >= 4 * count(*))
SELECT doc_id, text, lang, source, n_chars FROM documents WHERE text IS NOT NULL AND """ + " AND ".join(f"NOT coalesce({r.duck}, false)" for r in (*RULES, marked_words([])))
