import pytest

from wordloom.operators import builders
from wordloom.operators.cooc import PairParams
from wordloom.plans import workspace
from wordloom.plans.workspace import Workspace
from wordloom.sources import corpus, gold, store


def test_canonical_keys():
    name = workspace.entry_name
    assert name({"dim": 500.0}) == name({"dim": 500}) and name({"a": {2, 1}}) == name({"a": {1, 2}})
    assert len({name({"x": v}) for v in (True, None, 1, "1", 2)}) == 5
    with pytest.raises(TypeError):
        name({"x": object()})


def test_end_to_end(spark, tmp_path):
    texts = ["the cat sat on the mat", "the dog sat on the rug", "a cat and a dog", ""] * 5
    docs = corpus.from_sents(spark, texts)
    path = str(tmp_path / "w")
    w = Workspace(spark, path, docs)
    with pytest.raises(ValueError):
        Workspace(spark, path, docs)
    with pytest.raises(ValueError):
        Workspace(spark, path, overwrite=True)
    assert spark.read.parquet(f"{path}/size").first().documents == 20
    w = Workspace(spark, path)
    pairs = PairParams(subsample=None)
    cells = w.pair_counts(pairs)
    assert cells.count() > 0 and w.pair_counts(pairs).inputFiles() == cells.inputFiles()
    emb = w.svd(dim=5, pairs=pairs)
    assert emb.dim == 5 and w.keyed_vectors(emb).count() <= w.size
    assert w.most_similar(emb, ["cat"], 3).count() == 3
    assert w.most_similar(w.pmi(pairs=pairs), ["cat"], 3).count() <= 3
    folder = tmp_path / "gold" / "en" / "ws"
    folder.mkdir(parents=True)
    gold.write_tsv(folder / "g.tsv", ("word1", "word2", "score"), [("cat", "dog", 9), ("cat", "the", 2), ("sat", "mat", 5), ("x", "y", 1)])
    report, _ = w.evaluate(emb, "ws", str(tmp_path / "gold"))
    assert report.first().oov == 0.25
    for _ in range(2):
        w.record("svd", {"dim": 5, "impl": "scipy", "pair_args": {"window": 2}}, report)
    assert w.results().count() == 1
    assert w.results({"pair_args": {"window": 2.0}}).count() == 1
    store.write_word2vec(w.keyed_vectors(emb), str(tmp_path / "vec"))
    assert spark.read.text(str(tmp_path / "vec")).count() > 0


def test_runs_are_evaluated_and_recorded(spark, tmp_path):
    texts = ["the cat sat on the mat", "the dog sat on the rug", "a cat and a dog"] * 5
    folder = tmp_path / "gold" / "en" / "ws"
    folder.mkdir(parents=True)
    gold.write_tsv(folder / "g.tsv", ("word1", "word2", "score"), [("cat", "dog", 9), ("cat", "the", 2), ("sat", "mat", 5)])
    w = Workspace(spark, str(tmp_path / "w"), corpus.from_sents(spark, texts), gold_dir=str(tmp_path / "gold"))
    pairs = PairParams(subsample=None, window=3)
    emb, report, summary = w.svd(dim=4, pairs=pairs)
    assert emb.dim == 4 and report.first().name == "en_g" and summary.count() == 1
    named, *_ = w.pmi(pairs=pairs, keyed_vectors=True)
    assert named.columns == ["token", "c", "x"]
    assert w.svd(dim=4, pairs=pairs, keyed_vectors=True, evaluate=False).columns == ["token", "vec"]
    w.svd(dim=4, pairs=pairs)
    runs = w.results()
    assert {r.method for r in runs.collect()} == {"pmi", "svd"} and runs.count() == 2
    assert w.results({"pair_args": {"window": 3.0}, "dim": 4.0}).count() == 1
    with pytest.raises(ValueError):
        w.results(order="micro_results; drop")


def test_foreign_files_and_unreadable_tables(spark, tmp_path):
    path = tmp_path / "w"
    (path / "pair_counts").mkdir(parents=True)
    (path / "notes.txt").write_text("mine")
    docs = corpus.from_sents(spark, ["one two one", "two three"])
    with pytest.raises(ValueError):
        Workspace(spark, str(path), docs)
    w = Workspace(spark, str(path), docs, overwrite=True)
    assert (path / "notes.txt").read_text() == "mine"
    pairs = PairParams(subsample=None)
    want = sorted(map(tuple, w.pair_counts(pairs).collect()))
    for f in (path / "pair_counts").glob("*/*.parquet"):
        f.write_bytes(b"broken")
    assert sorted(map(tuple, w.pair_counts(pairs).collect())) == want
    Workspace(spark, str(path), docs, overwrite=True)
    assert (path / "notes.txt").exists()


def test_given_vocabulary_and_sampled_files(spark, tmp_path):
    given = spark.createDataFrame([(0, "two"), (1, "one")], "id int, token string")
    w = Workspace(spark, str(tmp_path / "v"), corpus.from_sents(spark, ["one two six"]), vocabulary=given)
    assert w.ids.first().ids == [1, 0, 2]
    base = tmp_path / "texts"
    base.mkdir()
    for k in range(6):
        (base / f"f {k}.txt").write_text(f"common word{k}\nword{k} again{k}\n")
    f = Workspace.from_folder(spark, str(tmp_path / "f"), str(base), 0.5)
    taken = {r.file for r in corpus.from_text_files(spark, str(base), 0.5).where("in_vocab").collect()}
    assert 0 < len(taken) < 6
    want = {"common"} | {f"{w}{n[2]}" for n in taken for w in ("word", "again")}
    assert {r.token for r in f.vocab.collect()} == want and f.ids.count() == 12
    top = Workspace.from_folder(spark, str(tmp_path / "t"), str(base), per_file=1)
    assert {r.token for r in top.vocab.collect()} <= {"common", *(f"word{k}" for k in range(6))}


def test_lines_of_files_that_are_split(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"line {k}\n" for k in range(5000)) + "last\r\nend\u2028more\n\nx")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = [r.text for r in corpus.from_file(spark, str(tmp_path / "big.txt")).orderBy("doc_id").collect()]
        rows = corpus.from_text_files(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = (tmp_path / "big.txt").read_bytes().decode()
    assert got == whole.splitlines() and [r.text for r in rows] == whole.split("\n")


def test_linter_of_all_kinds(spark, tmp_path):
    synonyms = [("d", 1, "a", "b", ["c", "d"]), ("d", 2, "A", "b", ["d", "c"]), ("d", 3, "a", "a", ["x y", "z"]), ("d", 4, "p", "q", ["q", "r"])]
    rows = spark.createDataFrame(synonyms, "name string, line int, target string, answer string, distractors array<string>")
    got = {(r.line, r.problem) for r in builders.lint(rows, "synonym").collect()}
    assert got == {(2, "duplicate"), (3, "self_pair"), (3, "not_distinct"), (3, "multitoken_distractor"), (4, "not_distinct")}
    rows = spark.createDataFrame([("d", 1, "a", "x"), ("d", 2, "A", "y"), ("d", 3, "b c", " ")], "name string, line int, word string, category string")
    assert {(r.line, r.problem) for r in builders.lint(rows, "category").collect()} == {(1, "two_categories"), (2, "two_categories"), (2, "duplicate"), (3, "multitoken"), (3, "no_category")}
    (tmp_path / "a.tsv").write_text("# k: v\nword1\tword2\tscore\na\tb\t1\n# late\na\t\tnan\n")
    assert gold.lint_tsv(tmp_path / "a.tsv", "ws") == [(4, "comment"), (4, "width"), (5, "empty"), (5, "score")]
    (tmp_path / "b.tsv").write_text("x\ty\n")
    assert gold.lint_tsv(tmp_path / "b.tsv", "ws") == [(1, "header")]


def test_readers_of_pairs(tmp_path):
    (tmp_path / "g.tsv").write_text("# c\na\tb\n\n c \t d \n")
    assert gold.read_pairs(tmp_path / "g.tsv") == [(2, "a", "b"), (4, "c", "d")]
    (tmp_path / "b.tsv").write_text("# c\na\tb\tc\n")
    assert gold.read_base_pairs(tmp_path / "b.tsv") == [(2, "a", "b")]
    for read in (gold.read_pairs, gold.read_base_pairs):
        (tmp_path / "x.tsv").write_text("alone\n")
        with pytest.raises(gold.MalformedDatasetError):
            read(tmp_path / "x.tsv")


def test_case_folding(spark):
    from pyspark.sql import functions as F

    from wordloom.functions.text import folded_key

    rows = spark.createDataFrame([("Straße",), ("STRASSE",), ("E\u0301A",), (None,)], "t string")
    assert [r[0] for r in rows.select(folded_key(F.col("t"))).collect()] == ["strasse", "strasse", "éa", None]


def test_empty_corpus_raises(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"), corpus.from_sents(spark, [""]))
    with pytest.raises(ValueError):
        w.pair_counts()


def test_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one two\nthree\n")
    (tmp_path / "b.txt").write_text("four")
    lines = corpus.from_text_files(spark, str(tmp_path))
    got = [(r.doc_id, r.text) for r in corpus.numbered(lines).orderBy("doc_id").collect()]
    assert got == [(0, "one two"), (1, "three"), (2, ""), (3, "four")]
    assert [r.text for r in corpus.from_file(spark, str(tmp_path / "a.txt")).orderBy("doc_id").collect()] == ["one two", "three"]
    assert {r.in_vocab for r in corpus.from_text_files(spark, str(tmp_path), 0.5, portable=False).select("in_vocab").collect()} <= {True, False}
