"""Operator 3: language identification by averaged hashed subword embeddings and a linear softmax.

A text is the bag of the hashed byte n-grams (2 to 4, and the whole word) of its words, each
lower-cased in ASCII and set in markers. The mean of their embeddings goes through a linear
layer and a softmax, trained by stochastic gradient descent in numpy on at most `train_rows`
labelled rows. A part of these rows isn't trained on: it sets the temperature that calibrates
the confidences (least log loss) and the confidence below which a text is rejected: the least one at which
accepted rows of that part are right in `precision` of cases, but not less than the confidence
that all but `spare` of the rightly identified ones reach.

In use the layers fold into one table of a logit for each bucket and language, and every
different word of a batch is scored once, so whole texts cost a few look-ups a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm._text import Words, chunks, run_hashes, text_buffers

#: Bound of the labelled rows that a model is fitted on, and of the files that they come from.
TRAIN_ROWS = 3000
TRAIN_FILES = 8
BUCKETS = 1 << 16
DIM = 16
PRECISION = 0.99
SPARE = 0.005
_ORDERS = (2, 3, 4)


@dataclass(frozen=True)
class Model:
    """languages; table: logits of each bucket; bias; temperature; threshold on the confidence."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def word_buckets(words: Words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each word's form, form of each feature, bucket of each feature); a form is a different word of the chunk."""
    _, first, form = np.unique(words.hashes, return_index=True, return_inverse=True)
    start, end = words.starts[first], words.ends[first]
    size = end - start + 2
    stop = np.cumsum(size)
    head = stop - size
    total = int(stop[-1]) if len(stop) else 0
    owner = np.repeat(np.arange(len(first)), size)
    inner = np.arange(total) - head[owner]
    letters = np.zeros(total, np.uint8)
    body = (inner > 0) & (inner < size[owner] - 1)
    raw = words.data[(start[owner] + inner - 1)[body]]
    letters[body] = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    letters[inner == 0], letters[inner == size[owner] - 1] = 2, 3
    at, to = [head], [stop]
    for n in _ORDERS:
        first_ = np.flatnonzero(inner + n <= size[owner])
        at.append(first_)
        to.append(first_ + n)
    at, to = np.concatenate(at), np.concatenate(to)
    feature = run_hashes(letters, at, to) % np.uint64(buckets) if len(at) else np.zeros(0, np.uint64)
    return form, owner[at] if len(at) else np.zeros(0, np.int64), feature.astype(np.int64)


def _bags(words: Words, n: int, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text."""
    form, owner, bucket = word_buckets(words, buckets)
    order = np.argsort(owner, kind="stable")
    bucket, per = bucket[order], np.bincount(owner, minlength=form.max(initial=-1) + 1)
    heads = np.cumsum(per) - per
    out = []
    for r in range(n):
        f, times = np.unique(form[words.bounds[r] : words.bounds[r + 1]], return_counts=True)
        size = per[f]
        stop = np.cumsum(size)
        at = np.repeat(heads[f] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)
        b, inverse = np.unique(bucket[at], return_inverse=True)
        out.append((b, np.bincount(inverse, weights=np.repeat(times, size), minlength=len(b))))
    return out


def _emit_bags(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            bags = _bags(Words(*text_buffers(batch.column(1)), lower=True), batch.num_rows, buckets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([b.astype(np.int32).tobytes() for b, _ in bags], pa.binary()), pa.array([c.astype(np.float32).tobytes() for _, c in bags], pa.binary())],
                names=["lang", "bucket", "count"],
            )

    return run


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], buckets: int = BUCKETS, dim: int = DIM, epochs: int = 6, rate: float = 2.0, batch: int = 32, precision: float = PRECISION, spare: float = SPARE, seed: int = 7) -> Model:
    """The model of these bags; a quarter of them, at least one, is held out for calibration. The same input gives the same model."""
    pairs = [(b, c / c.sum(), y) for (b, c), y in zip(bags, labels) if len(b)]
    languages = tuple(sorted({y for _, _, y in pairs}))
    if not languages:  # nothing to learn from: everything will be rejected
        return Model((), np.zeros((buckets, 0), np.float32), np.zeros(0, np.float32), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(pairs))
    held, rest = order[: max(1, len(order) // 4)], order[max(1, len(order) // 4) :]
    rest = rest if len(rest) else held
    number = {y: i for i, y in enumerate(languages)}
    embedding = rng.uniform(-1, 1, (buckets, dim)).astype(np.float32) / dim
    weight, bias = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    # classes of few rows weigh as much as those of many
    times = np.bincount([number[pairs[i][2]] for i in rest], minlength=len(languages))
    scale = (len(rest) / (len(languages) * np.maximum(times, 1))).astype(np.float32)

    def gather(members: np.ndarray) -> tuple[np.ndarray, ...]:
        which = [pairs[i] for i in members]
        row = np.repeat(np.arange(len(which)), [len(b) for b, _, _ in which])
        return row, np.concatenate([b for b, _, _ in which]), np.concatenate([c for _, c, _ in which]).astype(np.float32), np.array([number[y] for _, _, y in which])

    def mean(row: np.ndarray, bucket: np.ndarray, share: np.ndarray) -> np.ndarray:
        return np.add.reduceat(embedding[bucket] * share[:, None], np.searchsorted(row, np.arange(row[-1] + 1)))

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        mixed = rng.permutation(rest)
        for s in range(0, len(mixed), batch):
            row, bucket, share, y = gather(mixed[s : s + batch])
            hidden = mean(row, bucket, share)
            delta = _softmax(hidden @ weight + bias)
            delta[np.arange(len(y)), y] -= 1
            delta *= (scale[y] / len(y))[:, None]
            back = delta @ weight.T
            weight -= step * hidden.T @ delta
            bias -= step * delta.sum(axis=0)
            # a bucket has a small share of a text: its step is raised by the batch's size
            np.add.at(embedding, bucket, -(step * batch) * share[:, None] * back[row])
    logits = np.concatenate([mean(*gather(np.array([i]))[:3]) for i in held]) @ weight + bias
    y = np.array([number[pairs[i][2]] for i in held])
    grid = np.geomspace(0.05, 20, 121)
    losses = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    chance = _softmax(logits / temperature)
    confidence, right = chance.max(axis=1), chance.argmax(axis=1) == y
    down = np.argsort(-confidence, kind="stable")
    share = np.cumsum(right[down]) / np.arange(1, len(down) + 1)
    good = np.flatnonzero(share >= precision)
    threshold = float(confidence[down[good[-1]]]) if len(good) else 1.0
    usual = float(np.quantile(confidence[right], spare, method="lower")) if right.any() and len(languages) > 1 else 0.0
    return Model(languages, (embedding @ weight).astype(np.float32), bias, temperature, min(max(threshold, usual), 0.999))


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, buckets: int = BUCKETS, **options) -> Model:
    """A model of the labelled rows (text, lang) with the lowest hashes, `train_rows` at most; rows without text or language don't count.

    Copies share their hash, so that a table of few different texts may give fewer rows.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    keyed = rows.withColumn("__wl_h", F.xxhash64("text", "lang"))
    count = docs.where("lang IS NOT NULL").count()
    if count > 2 * train_rows:  # only low hashes are sorted; twice the bound is expected below this one
        keyed = keyed.where(F.col("__wl_h") < int(2**64 * 2 * train_rows / count) - 2**63)
    chosen = keyed.orderBy("__wl_h", "lang", "text").limit(train_rows).repartition(8, "__wl_h").select("lang", "text")
    found = chosen.mapInArrow(_emit_bags(buckets), "lang string, bucket binary, count binary").toArrow().to_pydict()
    bags = [(np.frombuffer(b, np.int32).astype(np.int64), np.frombuffer(c, np.float32)) for b, c in zip(found["bucket"], found["count"])]
    return fit(bags, found["lang"], buckets, **options)


def predict(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the likeliest language, its confidence, whether the text has words) of each text."""
    n, c = len(offsets) - 1, len(model.languages)
    if not c:
        return np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
    words = Words(data, offsets, lower=True)
    form, owner, bucket = word_buckets(words, len(model.table))
    forms = int(form.max(initial=-1)) + 1
    count = np.bincount(owner, minlength=forms)
    total = np.bincount(words.row, weights=count[form], minlength=n)
    logits = np.empty((n, c))
    for k in range(c):
        score = np.bincount(owner, weights=model.table[bucket, k], minlength=forms)
        logits[:, k] = np.bincount(words.row, weights=score[form], minlength=n) / np.maximum(total, 1) + model.bias[k]
    chance = _softmax(logits / model.temperature)
    return chance.argmax(axis=1), chance.max(axis=1), total > 0


NEW = ("predicted", "confidence", "accepted")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs without `text`, with predicted (the language or null where rejected), confidence and accepted; all rows are kept.

    Null texts and texts without words are rejected with confidence 0, and so is everything if no
    labelled text was there to learn from. Whole texts are read.
    Other columns stay; earlier ones of the new names are replaced.
    """
    rest = [F.col("`" + x.replace("`", "``") + "`") for x in docs.columns if x.lower() not in ("text", *NEW)]
    plain = docs.select(F.col("text").cast("string").alias("__wl_text"), *rest)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m.languages or (None,), dtype=object)
        for batch in chunks(batches, "__wl_text"):
            best, confidence, has = predict(*text_buffers(batch.column(0)), m)
            confidence = np.where(has, np.round(confidence, 4), 0.0)
            accepted = has & (confidence >= m.threshold)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(np.where(accepted, names[best], None), pa.string()), pa.array(confidence), pa.array(accepted)],
                names=[*batch.schema.names[1:], *NEW],
            )

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields[1:], *(T.StructField(n, t) for n, t in zip(NEW, kinds))]))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of rows from TRAIN_FILES of the table's files at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = sorted(docs.inputFiles())
    step = max(1, len(files) // TRAIN_FILES)
    model = train(spark.read.schema(docs.schema).parquet(*files[::step][:TRAIN_FILES]))
    return identify(docs.select("doc_id", "lang", "text"), model)
