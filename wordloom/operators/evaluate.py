"""Intrinsic evaluation of embeddings on gold tables.

A gold table has `name`, `ord` (the place of its dataset in file-name order), `line` and the
word columns of its kind. A row is scored only if each of its words is exactly one token of the
vocabulary; the others count as out of vocabulary. Embeddings are dense (id, vec) or sparse
(w, c, x).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import vectors as V
from wordloom.functions.text import Tokenizer, to_item, tokenizer
from wordloom.operators import ppmi, search
from wordloom.operators.vocab import BROADCAST_ROWS
from wordloom.sources import shared

#: Word columns of each kind of gold table.
KINDS: dict[str, tuple[str, ...]] = {
    "ws": ("word1", "word2"),
    "analogy": ("a", "a_prime", "b", "b_prime"),
    "synonym": ("target", "answer", "distractors"),
    "category": ("word",),
}


@dataclass(frozen=True)
class Embedding:
    """A table of vectors with the number of dimensions if dense; digits: ties are decided on scores rounded so far."""

    table: DataFrame
    dim: int | None = None
    digits: int | None = None

    @property
    def dense(self) -> bool:
        return "vec" in self.table.columns


def penalize_oov(score: Column, oov: Column) -> Column:
    """score - |score| * oov."""
    return score - F.abs(score) * oov


def _words(kind: str) -> tuple[str, ...]:
    if kind not in KINDS:
        raise ValueError(f"kind is {kind!r}; it can be {sorted(KINDS)}")
    return KINDS[kind]


def lookup(gold: DataFrame, kind: str, vocab: DataFrame, tokenize: str | Tokenizer = "v2", size: int | None = None) -> DataFrame:
    """gold with the ids of its words: a column <word>_id for each word column (a list for distractors), null where out of vocabulary."""
    cut = tokenizer(tokenize)
    ids = vocab.select(F.col("token").alias("__t"), F.col("id").alias("__i"))
    small = size is not None and size <= BROADCAST_ROWS
    out = gold
    for name in _words(kind):
        side = F.broadcast(ids) if small else ids
        if name == "distractors":
            long = out.select("name", "line", F.posexplode("distractors").alias("__p", "__w")).withColumn("__k", to_item(cut(F.col("__w"))))
            found = long.join(side, F.col("__k") == F.col("__t"), "left").groupBy("name", "line").agg(
                F.transform(F.array_sort(F.collect_list(F.struct("__p", "__i"))), lambda x: x["__i"]).alias("distractors_id")
            )
            out = out.join(found, ["name", "line"], "left")
        else:
            keyed = out.withColumn("__k", to_item(cut(F.col(name))))
            out = keyed.join(side, F.col("__k") == F.col("__t"), "left").withColumn(f"{name}_id", F.col("__i")).drop("__k", "__t", "__i")
    return out


def _covered(kind: str) -> Column:
    ok = F.lit(True)
    for name in _words(kind):
        ok = ok & F.col(f"{name}_id").isNotNull()
        if name == "distractors":
            ok = ok & ~F.exists("distractors_id", lambda x: x.isNull())
    return ok


def coverage(gold: DataFrame, kind: str, vocab: DataFrame, tokenize: str | Tokenizer = "v2", size: int | None = None) -> DataFrame:
    """(name, kind, rows, covered, coverage) of each dataset."""
    found = lookup(gold, kind, vocab, tokenize, size).withColumn("ok", _covered(kind))
    counts = found.groupBy("name").agg(F.count("*").alias("rows"), F.count_if("ok").alias("covered"))
    return counts.select("name", F.lit(kind).alias("kind"), "rows", "covered", (F.col("covered") / F.col("rows")).alias("coverage"))


def similarities(embedding: Embedding, pairs: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the column `similarity`; a word without a vector has similarity 0."""
    if not embedding.dense:
        return ppmi.similarity(embedding.table, pairs)
    table = embedding.table
    joined = pairs.join(table.select(F.col("id").alias("a"), F.col("vec").alias("va")), "a", "left").join(table.select(F.col("id").alias("b"), F.col("vec").alias("vb")), "b", "left")
    return joined.withColumn("similarity", F.coalesce(V.dot(F.col("va"), F.col("vb"), embedding.dim), F.lit(0.0))).drop("va", "vb")


def average_rank(value: Column | str, *group: str) -> Column:
    """Rank of a value in its group, ties sharing their mean rank."""
    column = F.col(value) if isinstance(value, str) else value
    by = Window.partitionBy(*group)
    return F.rank().over(by.orderBy(column)) + (F.count("*").over(Window.partitionBy(*group, column)) - 1) / 2


def spearman(rows: DataFrame, x: str, y: str, *group: str) -> DataFrame:
    """(group..., score): rank correlation of two columns, in [-1, 1], null where one of them is constant."""
    ranked = rows.select(*group, average_rank(x, *group).alias("rx"), average_rank(y, *group).alias("ry"))
    corr = F.corr("rx", "ry")
    return ranked.groupBy(*group).agg(F.when(~F.isnan(corr), corr).alias("score"))


def first_claims(rows: DataFrame, *key: str) -> DataFrame:
    """(name, weight): different keys of each dataset that no earlier dataset has."""
    single = rows.select("name", "ord", *key).distinct()
    first = single.withColumn("__first", F.min("ord").over(Window.partitionBy(*key)))
    return first.groupBy("name").agg(F.count_if(F.col("ord") == F.col("__first")).alias("weight"))


def _report(totals: DataFrame, scored: DataFrame, weights: DataFrame, *more: str) -> DataFrame:
    """(name, score, oov, fullscore, weight): datasets without a scored row are left out. scored: (name, score, n)."""
    joined = scored.join(totals, "name").join(weights, "name")
    oov = (F.col("rows") - F.col("n")) / F.col("rows")
    return joined.withColumn("oov", oov).select("name", "score", "oov", penalize_oov(F.col("score"), F.col("oov")).alias("fullscore"), "weight", *more)


def _totals(gold: DataFrame) -> DataFrame:
    return gold.groupBy("name").agg(F.count("*").alias("rows"))


def eval_similarity(embedding: Embedding, gold: DataFrame, vocab: DataFrame, tokenize: str | Tokenizer = "v2", size: int | None = None) -> DataFrame:
    """Rank correlation of similarities with the gold scores (name, ord, line, word1, word2, score)."""
    found = lookup(gold, "ws", vocab, tokenize, size).where(_covered("ws")).select("name", "ord", "line", F.col("word1_id").alias("a"), F.col("word2_id").alias("b"), F.col("score").cast("double").alias("gold"))
    scored = similarities(embedding, found)
    if embedding.digits is not None:
        scored = scored.withColumn("similarity", F.round("similarity", embedding.digits))
    counts = scored.groupBy("name").agg(F.count("*").alias("n"))
    weights = first_claims(found.select("name", "ord", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")), "low", "high")
    return _report(_totals(gold), spearman(scored, "similarity", "gold", "name").join(counts, "name"), weights)


def eval_analogies(embedding: Embedding, gold: DataFrame, vocab: DataFrame, tokenize: str | Tokenizer = "v2", objective: str = "add", size: int | None = None) -> DataFrame:
    """Accuracy of the best guess for a_prime - a + b among all words but these three; rows whose answer is one of them aren't scored."""
    search.check_objective(objective)
    ids = [f"{n}_id" for n in KINDS["analogy"]]
    found = lookup(gold, "analogy", vocab, tokenize, size).where(_covered("analogy")).where("NOT (b_prime_id = a_id OR b_prime_id = a_prime_id OR b_prime_id = b_id)")
    asked = found.select("name", "ord", *ids, (F.col("ord").cast("long") * F.lit(1 << 32) + F.col("line")).alias("q"))
    parts = asked.select("q", F.explode(F.expr("array(struct(a_prime_id AS word, 1 AS sign), struct(b_id AS word, 1 AS sign), struct(a_id AS word, -1 AS sign))")).alias("p")).select("q", "p.word", "p.sign")
    guesses = search.most_similar_vectors(embedding.table, parts, 4, objective, embedding.dim, embedding.digits)
    others = search.without(guesses, parts.select("q", F.col("word").alias("id")))
    best = others.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("rank"))).where("r = 1").select("q", F.col("id").alias("guess"))
    judged = asked.join(best, "q", "left").withColumn("hit", F.coalesce((F.col("guess") == F.col("b_prime_id")).cast("double"), F.lit(0.0)))
    scored = judged.groupBy("name").agg(F.avg("hit").alias("score"), F.count("*").alias("n"))
    return _report(_totals(gold), scored, first_claims(asked, *ids))


def eval_synonyms(embedding: Embedding, gold: DataFrame, vocab: DataFrame, tokenize: str | Tokenizer = "v2", size: int | None = None) -> DataFrame:
    """Share of questions whose answer is strictly more similar to the target than every distractor."""
    found = lookup(gold, "synonym", vocab, tokenize, size).where(_covered("synonym"))
    options = found.withColumn("options", F.concat(F.array("answer_id"), F.col("distractors_id")))
    fair = options.where("NOT array_contains(options, target_id) AND size(array_distinct(options)) = size(options)")
    pairs = fair.select("name", "ord", "line", F.col("target_id").alias("a"), F.posexplode("options").alias("p", "b"))
    near = similarities(embedding, pairs)
    score = F.round("similarity", embedding.digits) if embedding.digits is not None else F.col("similarity")
    judged = near.groupBy("name", "line").agg((F.max(F.when(F.col("p") == 0, score)) > F.max(F.when(F.col("p") > 0, score))).cast("double").alias("hit"))
    scored = judged.groupBy("name").agg(F.avg("hit").alias("score"), F.count("*").alias("n"))
    return _report(_totals(gold), scored, first_claims(fair, "target_id", "options"))


def _nearest(embedding: Embedding, entries: DataFrame) -> DataFrame:
    """(name, id, category, n, other_category): of each entry (name, id, place, category, n) the most similar other one of its dataset, ties by place."""
    other = entries.select("name", F.col("id").alias("other"), F.col("place").alias("other_place"), F.col("category").alias("other_category"))
    score = F.round("similarity", embedding.digits) if embedding.digits is not None else F.col("similarity")
    if embedding.dense:
        table = embedding.table
        dim = embedding.dim or (table.select(F.size("vec")).first() or [1])[0]
        entries = shared.save(entries.select("name", "id", "place", "category", "n"), "entries")
        held = entries.join(table.select("id", "vec"), "id", "left").withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0), dim)))
        found = None
        for (name,) in entries.select("name").distinct().collect():
            own = held.where(F.col("name") == name)
            asked = own.select(F.col("place").alias("q"), F.lit(1).alias("sign"), F.col("vec").alias("qvec"))
            part = search.dense_best(own.select(F.col("place").alias("id"), "vec"), asked, 1, dim, include_self=False, digits=embedding.digits)
            part = part.select(F.lit(name).alias("name"), F.col("q").alias("place"), F.col("id").alias("other_place"), F.col("score").alias("similarity"))
            found = part if found is None else found.unionByName(part)
        if found is None:
            return entries.select("name", "id", "category", "n", F.col("category").alias("other_category"))
        ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("name", "place").orderBy(score.desc(), "other_place"))).where("r = 1")
        return ranked.join(entries, ["name", "place"]).join(other.select("name", "other_place", "other_category"), ["name", "other_place"])
    pairs = entries.join(other, "name").where("id <> other")
    near = similarities(embedding, pairs.select("*", F.col("id").alias("a"), F.col("other").alias("b")))
    return near.withColumn("r", F.row_number().over(Window.partitionBy("name", "id").orderBy(score.desc(), "other_place"))).where("r = 1")


def eval_categories(embedding: Embedding, gold: DataFrame, vocab: DataFrame, tokenize: str | Tokenizer = "v2", size: int | None = None) -> DataFrame:
    """Share of words whose nearest other word of the dataset is of their category, with the chance level `baseline`.

    A word that is listed twice keeps its first place and its last category. Datasets with fewer
    than two words or categories are left out.
    """
    found = lookup(gold, "category", vocab, tokenize, size).where("word_id IS NOT NULL")
    entries = found.groupBy("name", "ord", F.col("word_id").alias("id")).agg(F.min("line").alias("place"), F.max_by("category", "line").alias("category"))
    enough = entries.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("category").alias("k")).where("n >= 2 AND k >= 2")
    entries = entries.join(enough.select("name", "n"), "name")
    ranked = _nearest(embedding, entries)
    purity = ranked.groupBy("name").agg(F.avg((F.col("category") == F.col("other_category")).cast("double")).alias("score"), F.max("n").alias("n"))
    sizes = entries.groupBy("name", "category", "n").agg(F.count("*").alias("s"))
    base = sizes.groupBy("name").agg((F.sum(F.col("s") * (F.col("s") - 1)) / F.max(F.col("n") * (F.col("n") - 1))).alias("baseline"))
    return _report(_totals(gold), purity.join(base, "name"), first_claims(entries, "id"), "baseline")


def summary(report: DataFrame) -> DataFrame:
    """One row (micro, macro): means of the scores of datasets that add anything, weighed by what they add and not; NaN if there are none."""
    pooled = report.where("weight > 0")
    nan = F.lit(float("nan"))
    return pooled.agg(
        F.coalesce(F.sum(F.col("weight") * F.col("score")) / F.sum("weight"), nan).alias("micro"),
        F.coalesce(F.avg("score"), nan).alias("macro"),
    )
