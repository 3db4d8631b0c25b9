import pytest

from wordloom.operators import builders, evaluate, experiments
from wordloom.operators.evaluate import Embedding
from wordloom.sources import gold

VECTORS = {"athens": (1, 0, 0), "greece": (1, 0, 1), "baghdad": (0, 1, 0), "iraq": (0, 1, 1), "distractor": (0, 1, -1)}


@pytest.fixture(scope="module")
def words(spark):
    rows = [(i, t, [x / sum(y * y for y in v) ** 0.5 for x in v]) for i, (t, v) in enumerate(VECTORS.items())]
    df = spark.createDataFrame(rows, "id int, token string, vec array<double>")
    return df.select("id", "token"), Embedding(df.select("id", "vec"), 3)


def report(df):
    return {r.name: r for r in df.collect()}


def test_similarity(spark, words):
    vocab, emb = words
    rows = [("d", 0, 1, "athens", "greece", 9.0), ("d", 0, 2, "athens", "baghdad", 1.0), ("d", 0, 3, "greece", "iraq", 5.0), ("d", 0, 4, "athens", "nowhere", 5.0)]
    r = report(evaluate.eval_similarity(emb, spark.createDataFrame(rows, gold.SCHEMAS["ws"]), vocab))["d"]
    assert (r.score, r.oov, r.fullscore) == pytest.approx((1.0, 0.25, 0.75))


def test_analogies(spark, words):
    vocab, emb = words
    rows = [("d", 0, 1, "athens", "greece", "baghdad", "iraq"), ("d", 0, 2, "athens", "greece", "iraq", "distractor"), ("d", 0, 3, "athens", "greece", "x", "iraq"), ("d", 0, 4, "athens", "greece", "iraq", "athens")]
    for objective in ("add", "mul"):
        r = report(evaluate.eval_analogies(emb, spark.createDataFrame(rows, gold.SCHEMAS["analogy"]), vocab, objective=objective))["d"]
        assert (r.score, r.oov) == pytest.approx((0.5, 0.5))


def test_synonyms_tie_is_a_miss(spark, words):
    vocab, emb = words
    rows = [("d", 0, 1, "athens", "greece", ["baghdad", "iraq"]), ("d", 0, 2, "athens", "baghdad", ["iraq", "distractor"]), ("d", 0, 3, "athens", "athens", ["iraq", "greece"]), ("d", 0, 4, "athens", "x", ["iraq", "greece"])]
    r = report(evaluate.eval_synonyms(emb, spark.createDataFrame(rows, gold.SCHEMAS["synonym"]), vocab))["d"]
    assert (r.score, r.oov) == pytest.approx((0.5, 0.5))


def test_categories(spark, words):
    vocab, emb = words
    rows = [("d", 0, 1, "athens", "g"), ("d", 0, 2, "greece", "g"), ("d", 0, 3, "baghdad", "i"), ("d", 0, 4, "iraq", "i"), ("e", 1, 1, "athens", "g"), ("e", 1, 2, "greece", "g")]
    found = report(evaluate.eval_categories(emb, spark.createDataFrame(rows, gold.SCHEMAS["category"]), vocab))
    assert set(found) == {"d"} and found["d"].score == 1 and found["d"].baseline == pytest.approx(1 / 3)


def test_first_claim_and_summary(spark, words):
    vocab, emb = words
    a = [("a", 0, 1, "athens", "greece", 1.0), ("a", 0, 2, "athens", "baghdad", 9.0)]
    b = [("b", 1, 1, "greece", "athens", 9.0), ("b", 1, 2, "baghdad", "athens", 1.0)]
    found = evaluate.eval_similarity(emb, spark.createDataFrame(a + b, gold.SCHEMAS["ws"]), vocab)
    assert {n: (r.score, r.weight) for n, r in report(found).items()} == {"a": (-1.0, 2), "b": (1.0, 0)}
    s = evaluate.summary(found).first()
    assert (s.micro, s.macro) == (-1, -1)
    none = evaluate.summary(found.where("false")).first()
    assert none.micro != none.micro


def test_readers(spark, tmp_path):
    folder = tmp_path / "en" / "ws"
    folder.mkdir(parents=True)
    gold.write_tsv(folder / "one.tsv", ("word1", "word2", "score"), [("a", "b", 1.5)], {"source": "own"})
    (folder / "two.txt").write_text("# x\na b 2\nshort\n: part\nc d 3\n")
    rows = gold.read_gold(spark, "en", "ws", tmp_path).collect()
    assert [(r.name, r.ord, r.word1, r.score) for r in rows] == [("en_one", 0, "a", 1.5), ("en_two", 1, "a", 2.0), ("en_two", 1, "c", 3.0)]
    for text in ("word1\tword2\n", "word1\tword2\tscore\na\tb\n", "word1\tword2\tscore\na\t\t1\n", "word1\tword2\tscore\na\tb\tnan\n", "word1\tword2\tscore\n#\n", "# only\n"):
        (folder / "one.tsv").write_text(text)
        with pytest.raises(gold.MalformedDatasetError):
            gold.read_gold(spark, "en", "ws", tmp_path)
    (folder / "two.tsv").write_text("")
    with pytest.raises(gold.DuplicateDatasetError):
        gold.discover("en", "ws", tmp_path)


def test_builders(spark):
    rows = spark.createDataFrame([(1, "flu", "influenza"), (2, "mi", "infarction"), (3, "cva", "stroke"), (4, "flu", "flu"), (5, "high bp", "hypertension")], "line int, term string, synonym string")
    made = builders.build_synonym(rows, 3, 0).orderBy("line").collect()
    assert [r.line for r in made] == [1, 2, 3]
    for r in made:
        assert len(set(r.distractors)) == 3 and r.answer not in r.distractors and r.target not in r.distractors
    cat = spark.createDataFrame([(1, "a", "x"), (2, "A", "x"), (3, "b", "x"), (4, "b", "y"), (5, "c d", "x")], "line int, word string, category string")
    assert [r.line for r in builders.build_category(cat).collect()] == [1]
    ws = spark.createDataFrame([(1, "a", "b", 1.0), (2, "B", "a", 1.0), (3, "c", "C", 1.0), (4, "d e", "f", 1.0)], "line int, word1 string, word2 string, score double")
    assert {r.line: r.problem for r in builders.curate(ws).collect()} == {1: None, 2: "duplicate", 3: "self_pair", 4: "multitoken"}
    quads = builders.compile_quadruples(spark.createDataFrame([(i, f"l{i}", f"r{i}") for i in range(6)], "line int, left string, right string"), 2, 1).collect()
    assert len(quads) == 12 and all(q.a != q.b for q in quads)


def test_experiments(spark):
    t = spark.createDataFrame([("svd", 2.0, 0.5), ("svd", 3.0, 0.7), ("pmi", None, 0.1)], "method string, pair_args__window double, micro_results double")
    assert experiments.results(t, {"method": "svd", "pair_args": {"window": 2.0}}).count() == 1
    assert experiments.results(t, {"method": "none"}).count() == 0
    assert experiments.results(t, order="micro_results desc", limit=1).first().micro_results == 0.7
    for bad in ({"x; drop": 1}, {"a b": 1}):
        with pytest.raises(ValueError):
            experiments.results(t, bad)
    with pytest.raises(ValueError):
        experiments.results(t, order="1; drop table x")
    new = spark.createDataFrame([("pmi", None, 0.9), ("new", 1.0, 0.2)], t.schema)
    assert experiments.insert_ignore(t, new, ["method", "pair_args__window"]).count() == 4
