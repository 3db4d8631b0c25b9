import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import pytest

from wordloom.operators import cooc, vocab
from wordloom.operators.cooc import PairParams


def draw(*parts):
    return int(hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def definition(docs, size, p):
    """Counts by the definition, one pair of positions after the other."""
    counts = Counter(x for ids in docs.values() for x in ids)
    threshold = p.subsample_factor * sum(counts.values())
    keep = {w: math.sqrt(threshold / n) for w, n in counts.items() if n > threshold}
    out = defaultdict(float)
    for doc, ids in docs.items():
        if p.delete_oov:
            ids = [x for x in ids if x < size]
        if p.subsample in ("prob", "dirty"):
            ids = [x if x not in keep or draw(p.seed, "keep", doc, i) / 2**32 < keep[x] else None for i, x in enumerate(ids)]
            if p.subsample == "dirty":
                ids = [x for x in ids if x is not None]
        for i, j in itertools.permutations(range(len(ids)), 2):
            d = abs(i - j)
            radius = 1 + draw(p.seed, "rad", doc, i) % p.window if p.dynamic_window == "prob" else p.window
            if d <= radius and ids[i] is not None and ids[j] is not None:
                out[ids[i], ids[j]] += 1 if p.dynamic_window == "prob" else p.weight(d)
    out = {k: v for k, v in out.items() if v >= (p.min_count or 0)}
    if p.subsample == "deter":
        out = {(w, c): n * keep.get(w, 1) * keep.get(c, 1) for (w, c), n in out.items()}
    return out


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    words = range(12)
    return {d: r.choices(words, [1 / (w + 1) for w in words], k=r.randint(1, 12)) for d in range(60)}


MODES = [(w, dyn, sub) for w in (1, 3) for dyn, sub in [(None, None), ("deter", "deter"), ("decay", None), ("prob", None), ("deter", "prob"), ("deter", "dirty"), ("prob", "dirty"), ("off", "prob")]]


@pytest.mark.parametrize("window,dyn,sub", MODES)
def test_against_definition(spark, corpus, window, dyn, sub):
    p = PairParams(window=window, dynamic_window=dyn, subsample=sub, subsample_factor=0.05, delete_oov=window == 3)
    ids = spark.createDataFrame(list(corpus.items()), "doc_id long, ids array<int>").repartition(3)
    got = {(r.w, r.c): r.n for r in cooc.count_pairs(ids, 10, p).collect()}
    want = definition(corpus, 10, p)
    assert got.keys() == want.keys()
    for k, n in want.items():
        assert got[k] == pytest.approx(n, rel=1e-9)


def test_clean_keeps_slots_and_dirty_closes_them(spark):
    docs = [(i, [0, 2, 1]) for i in range(200)] + [(200 + i, [2] * 10) for i in range(200)]
    ids = spark.createDataFrame(docs, "doc_id long, ids array<int>")
    found = {}
    for sub in ("prob", "dirty"):
        p = PairParams(window=1, dynamic_window=None, subsample=sub, subsample_factor=0.15)
        found[sub] = {(r.w, r.c): r.n for r in cooc.count_pairs(ids, 3, p).collect()}
    assert (0, 1) not in found["prob"] and found["dirty"][0, 1] > 0


def test_threshold_is_on_tokens(spark):
    ids = spark.createDataFrame([(i, [0, 1, 2, 3, 4]) for i in range(150)], "doc_id long, ids array<int>")
    total = lambda f: sum(r.n for r in cooc.count_pairs(ids, 5, PairParams(subsample_factor=f)).collect())
    assert total(0.02) == pytest.approx(total(0.5) * 0.1)


def test_modes_are_checked():
    for bad in ("x", 0, True):
        with pytest.raises(ValueError):
            PairParams(dynamic_window=bad)
        with pytest.raises(ValueError):
            PairParams(subsample=bad)


def test_vocabulary_cut_and_ids(spark):
    toks = spark.createDataFrame([(0, ["b", "a", "b"]), (1, ["c", "a"]), (2, ["d"])], "doc_id long, tokens array<string>")
    stats = {r.token: (r.df, r.tf, r.first_doc) for r in vocab.token_stats(toks).collect()}
    assert stats == {"a": (2, 2, 0), "b": (1, 2, 0), "c": (1, 1, 1), "d": (1, 1, 2)}
    words = vocab.build(toks, keep_n=3)
    assert [(r.id, r.token) for r in words.orderBy("id").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    kept = vocab.build(toks, keep_n=2, keep_tokens=["d"])
    assert {r.token for r in kept.collect()} == {"d", "a"}
    enc = {r.doc_id: r.ids for r in vocab.encode(toks, words, 3).collect()}
    assert enc == {0: [1, 0, 1], 1: [2, 0], 2: [3]}


def test_stream_equals_batch(spark, tmp_path, corpus):
    from wordloom.streaming import counts

    ids = spark.createDataFrame(list(corpus.items()), "doc_id long, ids array<int>")
    ids.repartition(3).write.parquet(str(tmp_path / "in"))
    for k, p in enumerate((PairParams(window=3, subsample=None), PairParams(subsample_factor=0.02, min_count=2), PairParams(dynamic_window="prob", delete_oov=False, subsample="off"))):
        stream = spark.readStream.schema(ids.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        counts.count_stream(stream, 12, p, str(tmp_path / f"out{k}"), str(tmp_path / f"ck{k}")).awaitTermination()
        got = {(r.w, r.c): r.n for r in counts.totals(spark, str(tmp_path / f"out{k}"), 12, p).collect()}
        assert got and got == pytest.approx({(r.w, r.c): r.n for r in cooc.count_pairs(ids, 12, p).collect()})
    with pytest.raises(ValueError):
        counts.totals(spark, str(tmp_path / "out0"), 12, PairParams(subsample="dirty"))
