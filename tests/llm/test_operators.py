"""Each operator against a brute-force version, and on rows that are easily mishandled."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import bpe, language_id, line_dedup, minhash, packing, quality_rules, sharding, suffix_dedup, topk_search, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, i int, hash long, bucket int, c string, rank int, words int"


def docs(spark, texts, ids=None):
    """A table of documents with extra columns whose names clash with the operators' own."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en" if k % 2 else None, None, None, 1, 2, 3, 4, "c", 5, 6) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


def words(r, n, size=400):
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


ODD = [None, "", "   \n ", "one", "x" * 200_000, "word " * 60_000, "same text here", "same text here", "éß 漢字 🎉\x00 end"]
ODD_IDS = [0, 1, 2, 3, 4, None, 6, 6, None]


@pytest.mark.parametrize("run", [
    suffix_dedup.remove_repeats, lambda s, d: line_dedup.dedup_lines(d), lambda s, d: quality_rules.keep_quality(d), minhash.drop_near_duplicates,
])
def test_filters_keep_columns_on_odd_rows(spark, run):
    for table in (docs(spark, ODD, ODD_IDS), docs(spark, [])):
        out = run(spark, table)
        assert out.columns == table.columns
        assert out.count() <= table.count()


def test_others_on_odd_rows(spark):
    for table in (docs(spark, ODD, ODD_IDS), docs(spark, [])):
        n = table.count()
        assert bpe.encode_column(table).where("round_trip IS NULL OR round_trip").count() == n
        assert language_id.identify(table, language_id.train(table)).count() == n
        assert sharding.assign(table).where("shard IS NOT NULL").count() == n
        assert packing.pack(spark, table, (8, 64), 64).agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0] == int(bpe.Codec(bpe.read_vocabulary(bpe.VOCABULARY)).encode([t or "" for t in (ODD if n else [])])[1].sum())
        pages = table.withColumnRenamed("text", "url").withColumn("score", F.lit(1))
        assert url_filter.score_urls(pages).where("NOT rejected").count() == n
        assert url_filter.keep_urls(pages).columns == pages.columns


# ---- 1


def brute_repeats(texts, k):
    seen, out = set(), {}
    grams = [[tuple(w[i : i + k]) for i in range(len(w) - k + 1)] for w in (re.findall(r"[^\t-\r ]+", t) for t in texts)]
    for d, (t, g) in enumerate(zip(texts, grams)):
        gone = set()
        for i, x in enumerate(g):
            if x in seen:
                gone.update(range(i, i + k))
            seen.add(x)
        pieces = re.findall(r"[^\t-\r ]+[\t-\r ]*", t)
        out[d] = re.match(r"[\t-\r ]*", t)[0] + "".join(p for j, p in enumerate(pieces) if j not in gone)
    return out


@pytest.mark.parametrize("seed,hot", [(0, 20_000), (1, 20_000), (2, 2), (3, 0)])
def test_suffix_dedup(spark, seed, hot):
    r = random.Random(seed)
    shared = [words(r, r.randint(10, 40)) for _ in range(6)]
    texts = [" ".join(r.choice([words(r, r.randint(1, 30)), r.choice(shared)]) for _ in range(r.randint(1, 6))) for _ in range(80)] + ["a " * 50, " a" * 40]
    want = brute_repeats(texts, 12)
    got = {x.doc_id: x.text for x in suffix_dedup.remove_repeats(spark, docs(spark, texts).repartition(5), 12, 6, hot).collect()}
    assert got == want


@pytest.mark.parametrize("hot", [20_000, 50])
def test_a_passage_in_every_document(spark, hot):
    r = random.Random(9)
    license = words(r, 30)
    short = words(r, 15)  # holds anchors, but no whole passage
    texts = [" ".join([words(r, r.randrange(20)), license, words(r, 8), short, words(r, r.randrange(20))]) for _ in range(400)]
    got = {x.doc_id: x.text for x in suffix_dedup.remove_repeats(spark, docs(spark, texts).repartition(6), 20, 10, hot).collect()}
    assert got == brute_repeats(texts, 20) and sum(license in t for t in got.values()) == 1


def test_passages_go_on_over_batches():
    import pyarrow as pa

    r = random.Random(2)
    rows = sorted((r.randrange(5), r.randrange(6), r.randrange(4)) for _ in range(200))
    table = pa.table({"anchor": [x[0] for x in rows], "doc_id": [x[1] for x in rows], "at": pa.array([x[2] for x in rows], pa.int32()), "words": pa.nulls(200, pa.binary())})
    out = [x for b in suffix_dedup._compare(3)(iter(table.to_batches(7))) for x in zip(b.column(3).to_pylist(), b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert sorted(out) == [x for x in rows if x[1:] != min(y[1:] for y in rows if y[0] == x[0])]


def test_groups_are_compared_in_bounded_memory():
    """About 1.2 million words in small groups and one of 2500 segments, over batches that cut groups."""
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(4)
    some = r.integers(0, 2**63, 3000).astype(np.uint64)
    rows = []
    for anchor, segments in enumerate([4] * 2500 + [2500] + [4] * 50):
        core = some[r.integers(0, 3000, 99)]
        for doc in range(segments):
            words = core.copy()
            words[r.integers(0, 99, 2)] = some[r.integers(0, 3000, 2)]
            rows.append((anchor, doc, int(r.integers(0, 3)) * 40, words.tobytes()))
    table = pa.table(list(map(list, zip(*rows))), pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("words", pa.binary())]))

    def edits(t, size):
        return [x for b in suffix_dedup._compare(50)(iter(t.to_batches(size))) for x in zip(*(c.to_pylist() for c in b.columns))]

    tracemalloc.start()
    for _ in suffix_dedup._compare(50)(iter(table.to_batches(997))):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    small = table.filter(pa.compute.less(table["anchor"], 40)).combine_chunks()
    large = table.filter(pa.compute.equal(table["anchor"], 2500)).combine_chunks()
    both = pa.concat_tables([small, large]).combine_chunks()
    alone = [x for k in range(40) for x in edits(small.slice(4 * k, 4), 4)] + edits(large, 2500)
    assert alone and sorted(edits(both, 997)) == sorted(alone)


def test_longest_previous_factors():
    r = np.random.default_rng(1)
    for _ in range(30):
        v = r.integers(0, 3, 40)
        ends = np.repeat([15, 40], [15, 25])
        got = suffix_dedup.longest_previous_factors(v, ends, np.arange(40), 8)
        for i in range(40):
            want = 0
            for j in range(i):
                n = 0
                while n < 8 and i + n < ends[i] and j + n < ends[j] and v[i + n] == v[j + n]:
                    n += 1
                want = max(want, n)
            assert got[i] == want


# ---- 2


def test_url_filter(spark):
    strict, soft = {"bad": 5, "very-bad": 9}, {"free": 1, "bets": 2, "win": 1}
    r = random.Random(0)
    urls = ["".join(r.choice(["bad", "free", "bets", "win", "very-", "-", "/", ".", "x", "1", "é", "FREE"]) for _ in range(r.randint(0, 8))) for _ in range(400)] + [None]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {x.page_id: (x.strict_hits, x.soft_hits, x.soft_terms, x.score, x.rejected) for x in url_filter.score_urls(table, strict, soft).collect()}
    for i, u in enumerate(urls):
        n = {t: len(re.findall(rf"(?<![a-z0-9])(?={t}(?![a-z0-9]))", (u or "").lower())) for t in strict | soft}
        s, f = sum(n[t] for t in strict), sum(n[t] for t in soft)
        kinds = sum(n[t] > 0 for t in soft)
        assert got[i] == (s, f, kinds, sum(n[t] * (strict | soft)[t] for t in n), s > 0 or kinds >= 2)


def test_keep_urls_keeps_values_of_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.com/casino", 5, True), (2, "http://a.com/x", 77, True), (3, None, None, None)], "page_id long, url string, score int, rejected boolean")
    assert sorted(map(tuple, url_filter.keep_urls(pages).collect()), key=str) == [(2, "http://a.com/x", 77, True), (3, None, None, None)]
    assert {x.page_id: (x.score > 0, x.rejected) for x in url_filter.score_urls(pages).collect()} == {1: (True, True), 2: (False, False), 3: (False, False)}


def test_vocabulary_from_tables(spark, tmp_path):
    rows = [("Bad", 3, True), ("bad", 9, False), ("meh", 2, False), (None, 1, True), ("meh", 4, None), ("", 1, True)]
    spark.createDataFrame(rows, "term string, weight int, strict boolean").write.parquet(str(tmp_path / "v"))
    assert url_filter.read_vocabulary(spark, str(tmp_path / "v")) == ({"bad": 3}, {"meh": 4})
    (tmp_path / "v.tsv").write_text("# terms\nbad\t3\tstrict\nmeh\t2\tsoft\nplain\n")
    assert url_filter.read_vocabulary(spark, str(tmp_path / "v.tsv")) == ({"bad": 3}, {"meh": 2, "plain": 1})
    with pytest.raises(ValueError):
        url_filter.read_vocabulary(spark, str(tmp_path / "v.tsv"), 2)


# ---- 3


def test_language_id(spark):
    r = random.Random(4)
    make = {"aa": "the of and ing tion sh", "bb": "der ung keit und sch ei", "cc": "que los ción ado es la"}
    texts, labels = [], []
    for _ in range(600):
        y = r.choice(list(make))
        texts.append(" ".join("".join(r.choices(make[y].split(), k=r.randint(1, 3))) for _ in range(r.randint(5, 60))))
        labels.append(y)
    table = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(zip(texts, labels))], "doc_id int, text string, lang string")
    model = language_id.train(table.where("doc_id < 400"))
    found = language_id.identify(table.where("doc_id >= 400"), model).collect()
    assert sum(x.predicted == x.lang for x in found) >= 0.95 * len(found)
    odd = spark.createDataFrame([(0, None), (1, ""), (2, "…")], "doc_id int, text string")
    assert not any(x.accepted for x in language_id.identify(odd, model).where("doc_id < 2").collect())


# ---- 4


@pytest.mark.parametrize("k,blocks,rows", [(3, 4, 40), (5, 1, 1000)])
def test_topk_search(spark, k, blocks, rows):
    r = np.random.default_rng(2)
    x = r.standard_normal((150, 10)).round(2)
    x[7] = x[8] = x[9]  # ties
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(None, [1.0] * 10), (500, None), (501, [float("nan")] * 10), (502, []), (503, [1.0, 2.0]), (0, data[0][1])]
    table = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>")
    got = {}
    for f in topk_search.search(spark, table, k, blocks, rows).collect():
        got.setdefault(f.query_id, {})[f.rank] = (f.neighbour_id, f.score)
    scores = (x @ x.T).round(6)
    for q in range(150):
        order = sorted((j for j in range(150) if j != q), key=lambda j: (-scores[q, j], j))[:k]
        assert [got[q][i + 1][0] for i in range(k)] == order
    assert set(got) == set(range(150))
    assert topk_search.search(spark, table.where("false")).count() == 0


def test_topk_of_some_queries_and_large_values(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.standard_normal((300, 8)), 1e30 * r.standard_normal((5, 8))])
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for f in topk_search.search(spark, table, 4, 2, 64, every=50).collect():
        got.setdefault(f.query_id, {})[f.rank] = f.neighbour_id
    assert set(got) == {0, 50, 100, 150, 200, 250, 300}
    for q, ranks in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        assert [ranks[i + 1] for i in range(4)] == np.argsort(-score, kind="stable")[:4].tolist()


def test_topk_reads_lists_only_down_to_the_threshold():
    r = np.random.default_rng(1)
    x = r.standard_normal((4000, 8)) * r.pareto(2.0, (4000, 1))
    ids, k = np.arange(4000), 5
    for blocks in (1, 2, 4):
        lists = topk_search._Lists(x, blocks)
        cut = topk_search.cutoffs(np.arange(20), ids, x, k, blocks)
        q, n, score = topk_search.search_cell(ids[:20], x[:20], cut, ids, lists, k)
        assert lists.read < 0.8 * 20 * 4000 * blocks
        for i in range(20):
            want = (x @ x[i]).round(6)
            want[i] = -np.inf
            assert np.allclose(np.sort(score[q == i])[::-1], np.sort(want)[::-1][:k])


# ---- 5


def by_sql(rule, texts):
    import duckdb

    return [duckdb.execute(f"SELECT coalesce({rule.duck}, false) FROM (SELECT ?::VARCHAR AS text)", [t]).fetchall()[0][0] for t in texts]


def test_quality_rules_by_definition(spark):
    good = "This is a plain text of several words that nobody would object to, and it goes on.\n" * 1
    bad = ["", None, "A B C! " * 30 + "##@@$$%%^^&&**" * 4, "SHOUTING ALL THE TIME WITHOUT ANY END " * 3, "what? no! why? so! " * 10, "x" * 800 + " y" * 20, "same\n" * 10, "go go go  stop\tstop stop no no no " * 3]
    table = docs(spark, [good, *bad, good])
    assert sorted(x.doc_id for x in quality_rules.keep_quality(table).collect()) == [0, len(bad) + 1]


def test_quality_rules_equal_their_sql():
    import pyarrow as pa

    r = random.Random(5)
    pieces = ["word", "Word", "é", "漢字", "!", "?", "#", "$", "\n", "\n\n", " ", "  ", "\t", "ABC", "x" * 30, "go go", "a b c", "\x00", "🎉"]
    texts = ["".join(r.choice(pieces) + r.choice(["", " "]) for _ in range(r.randrange(120))) for _ in range(400)] + [x for x in ODD if x is not None] + ["\n" * 9, "a\n" * 3 + "a"]
    texts += [(r.choice(pieces) + r.choice([" ", "\n"])) * r.randrange(1, 1200) for _ in range(60)]
    column = pa.array(texts)
    for rule in quality_rules.RULES:
        assert rule.test(quality_rules.Texts(column)).tolist() == by_sql(rule, texts), rule.name
    alone = np.ones(len(texts), bool)
    for rule in quality_rules.RULES:
        alone &= ~rule.test(quality_rules.Texts(column))
    for seed in range(4):  # any order keeps the same texts
        order = list(quality_rules.RULES)
        random.Random(seed).shuffle(order)
        assert (quality_rules.judge(column, tuple(order)) == alone).all()


def test_few_different_words_at_any_length(spark):
    import pyarrow as pa

    rule = next(r for r in quality_rules.RULES if r.name == "few different words")
    r = random.Random(3)
    prose = words(r, 30_000, 3000)  # a tenth of its words are different, most of those of any block are
    texts = ["word " * 49, "word " * 50, "word " * 1000, "word " * 1001, "word " * 60_000, "a b c d e f g h " * 300, prose, words(r, 1000, 3000), ""]
    got = rule.test(quality_rules.Texts(pa.array(texts))).tolist()
    assert got == [False, True, True, True, True, True, False, False, False]
    assert by_sql(rule, texts) == got
    assert [x.doc_id for x in quality_rules.keep_quality(docs(spark, [*texts, None])).orderBy("doc_id").collect()] == [6, 7]


def test_marked_words_are_learned(spark):
    texts = ["you Grumpf, you zork."] * 4 + ["a plain zork of a text"] * 2 + ["grumpf alone", None, "plain"]
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(9)] + [(None, 1), (3, None), (8, 0)], "doc_id long, toxic int")
    table = docs(spark, texts)
    assert quality_rules.learn(table, labels) == ["grumpf", "you"]  # zork: 4 of 6
    assert quality_rules.learn(table, labels, 2) == [] == quality_rules.learn(table, labels.where("false")) == quality_rules.learn(table.where("false"), labels)
    rule = quality_rules.marked_words(["grumpf", "you"])
    kept = quality_rules.keep_quality(table, (rule,))
    assert sorted(x.doc_id for x in kept.collect()) == [4, 5, 6, 7, 8]
    assert quality_rules.keep_quality(table, (quality_rules.marked_words([]),)).count() == 9


def test_quality_measure(spark):
    measured = quality_rules.measure(docs(spark, ["", "plain text", None, "word " * 60]))
    assert {m["name"]: m["rejected"] for m in measured}["empty"] == 0.5 and all(m["cost"] > 0 for m in measured)
    assert all(m["cost"] == m["rejected"] == 0 for m in quality_rules.measure(docs(spark, [])))


def test_quality_order():
    rules = quality_rules.RULES[:3]
    measured = [{"name": r.name, "cost": c, "gain": g} for r, c, g in zip(rules, (3, 1, 2), (1.0, 5.0, 5.0))]
    assert [r.name for r in quality_rules.order_rules(rules, measured)] == [rules[1].name, rules[2].name, rules[0].name]


# ---- 6


def test_line_dedup(spark):
    r = random.Random(5)
    texts = ["\n".join(r.choice(["a", "b", "c", "", "d"]) for _ in range(r.randint(1, 12))) for _ in range(60)]
    seen, want = set(), {}
    for d, t in enumerate(texts):
        lines, gone = t.split("\n"), set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if not any(x.strip() for x in w):
                continue
            if w in seen:
                gone.update((i, i + 1, i + 2))
            seen.add(w)
        want[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(docs(spark, texts).repartition(4)).collect()}
    assert got == want


def test_a_window_in_every_document_and_a_long_text(spark):
    texts = [f"own {i}\nx\ny\nz\nend {i}" for i in range(300)] + ["\n".join(["p", "q", "r"] * 40_000)]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(docs(spark, texts).repartition(4)).collect()}
    assert got[0] == texts[0] and all(got[i] == f"own {i}\nend {i}" for i in range(1, 300)) and got[300] == "p\nq\nr"


# ---- 7


def best_fit(lengths, tiers):
    """Room left in each window, one piece after the other."""
    left, out = sorted(lengths, reverse=True), {}
    for number in reversed(range(len(tiers))):
        capacity, below = tiers[number], tiers[number - 1] if number else 0
        rooms: list[int] = []

        def put(n):
            fits = [i for i, x in enumerate(rooms) if x >= n]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= n
            return bool(fits)

        for n in (n for n in left if n > below):
            if not put(n):
                rooms.append(capacity - n)
        left = [n for n in left if n <= below and not put(n)]
        out[capacity] = sorted(rooms)
    return out


def test_packing(spark):
    r = random.Random(6)
    sizes = [r.choice([r.randint(1, 8), r.randint(1, 64), r.randint(60, 200)]) for _ in range(300)]
    table = docs(spark, [" ".join(["w"] * n) for n in sizes]).repartition(3)
    rows = packing.pack(spark, table, (8, 20, 64), 128).collect()
    pieces = [p for n in sizes for p in [64] * (n // 64) + [n % 64] * (n % 64 > 0)]
    want = best_fit(pieces, (8, 20, 64))
    windows, seen = {}, Counter()
    for x in rows:
        windows.setdefault((x.tier, x.window, x.step_group), []).append((x.offset, x.offset + x.n_tokens))
        seen.update((x.doc_id, x.first_token + j) for j in range(x.n_tokens))
    assert seen == Counter((d, j) for d, n in enumerate(sizes) for j in range(n))
    rooms: dict = {}
    load: dict = {}
    for (tier, _, group), spans in windows.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= tier
        rooms.setdefault(tier, []).append(tier - spans[-1][1])
        load.setdefault((tier, group), []).append(spans[-1][1])
    assert {t: sorted(v) for t, v in rooms.items()} == {t: v for t, v in want.items() if v}
    for tier in rooms:
        counts = [len(v) for (t, _), v in load.items() if t == tier]
        assert max(counts) <= 128 // tier and max(counts) - min(counts) <= 1
        loads = [sum(v) for (t, _), v in load.items() if t == tier]
        assert max(loads) - min(loads) <= tier  # at most one window apart


def test_packed_windows_hold_all_tokens(spark):
    r = random.Random(8)
    table = docs(spark, [words(r, r.randrange(300)) for _ in range(40)] + [None, ""])
    placed = packing.pack(spark, table, (16, 64, 256), 512)
    placed.write.mode("overwrite").format("noop").save()
    at = {(x.doc_id, x.part): (x.tier, x.window, x.offset, x.first_token, x.n_tokens) for x in placed.collect()}
    made = {(x.tier, x.window): x for x in packing.windows(spark, table, placed).collect()}
    tokens = {x.doc_id: x.tokens for x in bpe.encode_column(table).collect()}
    assert sum(len(x.tokens) for x in made.values()) == sum(len(t or []) for t in tokens.values())
    for (doc, _), (tier, window, offset, first, n) in at.items():
        assert made[tier, window].tokens[offset : offset + n] == tokens[doc][first : first + n] and len(made[tier, window].tokens) <= tier


def test_bpe_of_words_is_that_of_whole_texts():
    import pyarrow as pa

    r = random.Random(1)
    parts = ["a", "don't", "'s", "42", "é", "漢", "\u00a0", "\u3000", "\n", " ", "  ", "\t", "\r\n", "!?", "x'll", "\x1c", "\u2028", "🎉", "_", "\x00", "\u0301", "\x85"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(5000)] + [None, "", " ", "\n\n", "x" * 5000]
    ranks = bpe.read_vocabulary(bpe.VOCABULARY)
    got, want = bpe.Codec(ranks).encode_texts(pa.array(texts)), bpe.Codec(ranks).encode([t or "" for t in texts])
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


# ---- 8


def test_minhash_groups(spark):
    r = random.Random(7)
    texts, group = [], []
    for g in range(40):
        w = words(r, 150, 5000).split()
        for _ in range(r.randint(1, 4)):
            v = list(w)
            for _ in range(r.randint(0, 4)):
                v[r.randrange(150)] = f"w{r.randrange(5000)}"
            texts.append(" ".join(v))
            group.append(g)
    first = {g: group.index(g) for g in set(group)}
    got = {x.doc_id: x.keep_doc_id for x in minhash.near_duplicates(spark, docs(spark, texts)).collect()}
    want = {i: first[g] for i, g in enumerate(group) if first[g] != i}
    assert len(set(got.items()) & set(want.items())) >= 0.95 * len(want) and set(got) <= set(want)


@pytest.mark.parametrize("block", [16384, 3])
def test_minhash_links_by_true_similarity(spark, block):
    r = random.Random(11)
    base = words(r, 120, 3000).split()
    texts = []
    for _ in range(60):  # one family, its members more or less changed, and strangers
        v = list(base)
        for _ in range(r.choice([0, 2, 5, 40])):
            v[r.randrange(120)] = f"w{r.randrange(3000)}"
        texts += [" ".join(v), words(r, 120, 3000)]
    shingles = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in map(str.split, texts)]
    pairs = [(a, b, len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])) for a in range(120) for b in range(a)]
    found = {x.doc_id: x.keep_doc_id for x in minhash.near_duplicates(spark, docs(spark, texts).repartition(5), block=block).collect()}
    group = [found.get(i, i) for i in range(120)]
    assert all(group[a] == group[b] for a, b, j in pairs if j >= 0.75)
    for i in found:  # nobody is in a group without a neighbour that is about as similar as the threshold asks
        assert max(j for a, b, j in pairs if i in (a, b) and group[a] == group[b]) >= 0.35


def test_superminhash_is_that_of_one_element_after_the_other():
    r = np.random.default_rng(3)
    for slots in (16, 128):
        sets = [r.integers(0, 1 << 62, n).astype(np.uint64) for n in (1, 3, 20, 300)]
        want = []
        for elements in sets:
            best = [0xFFFFFFFFFFFFFFFF] * slots
            for e in elements:
                base = int(minhash.mix(np.array([e ^ np.uint64(0x9E3779B97F4A7C15)]))[0])
                perm = list(range(slots))
                for level in range(slots):  # all ranks, without early stopping
                    draw = int(minhash.mix(np.array([(base + 0xD1342543DE82EF95 * (2 * level + 1)) % (1 << 64)], np.uint64))[0])
                    pick = level + ((draw >> 40) * (slots - level) >> 24)
                    perm[level], perm[pick] = perm[pick], perm[level]
                    value = level << 56 | int(minhash.mix(np.array([draw], np.uint64))[0]) >> 8
                    best[perm[level]] = min(best[perm[level]], value)
            want.append((minhash.mix(np.array(best, np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16))
        row = np.repeat(np.arange(4), [len(x) for x in sets])
        assert (minhash.superminhash(row, np.concatenate(sets), 4, slots) == np.array(want)).all()


def test_superminhash_estimates():
    r = np.random.default_rng(8)
    errors = []
    for _ in range(40):
        a = r.integers(0, 1 << 62, 300).astype(np.uint64)
        b = np.concatenate([a[:200], r.integers(0, 1 << 62, 100).astype(np.uint64)])
        s = minhash.superminhash(np.repeat([0, 1], 300), np.concatenate([a, b]), 2)
        errors.append((s[0] == s[1]).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long").where("a <> b").repartition(7)
    got = {x.doc_id: x.keep_doc_id for x in minhash.components(spark, edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


# ---- 9


def test_bpe_is_that_of_the_public_encoder(spark):
    import tiktoken

    ranks = bpe.read_vocabulary(bpe.VOCABULARY)
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(9)
    texts = ["".join(r.choice(["the", " ", "ing", "é", "漢", "🎉", "\n", "  ", "123", "'s", "a" * 90, "zqx"]) for _ in range(r.randint(0, 60))) for _ in range(200)] + ["b" * 3000]
    rows = bpe.encode_column(docs(spark, texts)).collect()
    assert all(x.tokens == enc.encode_ordinary(texts[x.doc_id]) and x.round_trip for x in rows)
    back = bpe.decode_column(bpe.encode_column(docs(spark, [*texts, None])).drop("text")).collect()
    assert {x.doc_id: x.text for x in back} == dict(enumerate([*texts, None]))


# ---- 10


def test_sharding_moves_only_what_must(spark):
    keys = spark.range(20000).withColumnRenamed("id", "doc_id")
    before = {x.doc_id: (x.region, x.rack, x.shard) for x in sharding.assign(keys).collect()}
    total = sum(w for r in sharding.TOPOLOGY.values() for k in r.values() for w in k.values())
    share = Counter(before.values())
    for region, racks in sharding.TOPOLOGY.items():
        for rack, shards in racks.items():
            for s, w in shards.items():
                assert share[region, rack, s] / 20000 == pytest.approx(w / total, abs=0.012)
    changed = {**sharding.TOPOLOGY, "west": {**sharding.TOPOLOGY["west"], "w1": {"s1": 8.0}}}
    after = {x.doc_id: (x.region, x.rack, x.shard) for x in sharding.assign(keys, topology=changed).collect()}
    moved = [(before[k], after[k]) for k in before if before[k] != after[k]]
    assert moved and all(b[0] == "west" and (a[0] != "west" or b[1] == "w1") for a, b in moved)
