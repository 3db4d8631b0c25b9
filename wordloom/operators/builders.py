"""Builders and checks of gold tables, and measures of an approximate factorization.

Random choices are draws on a key, so they depend on the seed and the contents only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.draws import draw
from wordloom.functions.text import folded_key, single_token
from wordloom.operators.evaluate import spearman


def build_synonym(rows: DataFrame, n_distractors: int = 3, seed: int = 0) -> DataFrame:
    """(line, target, answer, distractors) of a glossary (line, term, synonym).

    Distractors are single-token words of the glossary that are no known synonym of the target,
    in either direction, drawn by the seed. Left out are pairs of one word, words of several
    tokens, targets with too few distractors, and later questions of the same words.
    """
    keyed = rows.withColumn("t", folded_key(F.col("term"))).withColumn("s", folded_key(F.col("synonym")))
    surfaces = keyed.select(F.explode(F.expr("array(struct(t AS k, line, 0 AS side, term AS word), struct(s AS k, line, 1 AS side, synonym AS word))")).alias("x")).select("x.*")
    surface = surfaces.groupBy("k").agg(F.min_by("word", F.struct("line", "side")).alias("word"))
    pool = surface.where(single_token(F.col("word")))
    known = keyed.select(F.explode(F.expr("array(struct(t AS x, s AS y), struct(s AS x, t AS y), struct(t AS x, t AS y))")).alias("p")).select("p.x", "p.y").distinct()
    asked = keyed.where((F.col("t") != F.col("s")) & single_token(F.col("term")) & single_token(F.col("synonym")))
    options = asked.crossJoin(pool.select("k", "word")).join(known.select(F.col("x").alias("t"), F.col("y").alias("k")), ["t", "k"], "left_anti")
    order = Window.partitionBy("line").orderBy(draw(seed, "distractor", F.col("t"), F.col("s"), F.col("k")), "k")
    drawn = options.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n_distractors)
    made = drawn.groupBy("line", "t", "s", "term", "synonym").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "k", "word"))), lambda x: x).alias("d")).where(F.size("d") == n_distractors)
    key = F.concat(F.col("t"), F.lit("\t"), F.array_join(F.array_sort(F.concat(F.array("s"), F.transform("d", lambda x: x["k"]))), "\t"))
    first = made.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("line"))).where("r = 1")
    return first.select("line", F.col("term").alias("target"), F.col("synonym").alias("answer"), F.transform("d", lambda x: x["word"]).alias("distractors"))


def build_category(rows: DataFrame) -> DataFrame:
    """(line, word, category) of a taxonomy, without words of several tokens or several categories, and each word once."""
    key = folded_key(F.col("word"))
    single = rows.where(single_token(F.col("word"))).withColumn("k", key)
    by = Window.partitionBy("k")
    marked = single.withColumn("low", F.min("category").over(by)).withColumn("high", F.max("category").over(by)).withColumn("r", F.row_number().over(by.orderBy("line")))
    return marked.where("low = high AND r = 1").select("line", "word", "category")


def curate(rows: DataFrame) -> DataFrame:
    """Rows (line, word1, word2, score) with `problem`: multitoken, self_pair, duplicate (of an earlier unordered pair), or null for those that stay."""
    a, b = folded_key(F.col("word1")), folded_key(F.col("word2"))
    first = F.when(~(single_token(F.col("word1")) & single_token(F.col("word2"))), "multitoken").when(a == b, "self_pair")
    marked = rows.withColumn("problem", first).withColumn("low", F.least(a, b)).withColumn("high", F.greatest(a, b))
    rank = F.row_number().over(Window.partitionBy("low", "high", F.col("problem").isNull()).orderBy("line"))
    return marked.withColumn("problem", F.when(F.col("problem").isNull() & (rank > 1), "duplicate").otherwise(F.col("problem"))).drop("low", "high")


def compile_quadruples(pairs: DataFrame, cap: int = 5, seed: int = 0) -> DataFrame:
    """(line, a, a_prime, b, b_prime): each base pair (line, left, right) with `cap` others at most, drawn by the seed."""
    a = pairs.select("line", F.col("left").alias("a"), F.col("right").alias("a_prime"))
    b = pairs.select(F.col("line").alias("other"), F.col("left").alias("b"), F.col("right").alias("b_prime"))
    joined = a.crossJoin(b).where("line <> other")
    order = Window.partitionBy("line").orderBy(draw(seed, "partner", F.col("line"), F.col("other")), "other")
    return joined.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cap).select("line", "a", "a_prime", "b", "b_prime")


def check_base_pairs(pairs: DataFrame) -> DataFrame:
    """(line, problem) of base pairs (line, left, right): several tokens, a repeated side, or two equal sides."""
    ok = single_token(F.col("left")) & single_token(F.col("right"))
    marked = (
        pairs.withColumn("nl", F.count("*").over(Window.partitionBy("left")))
        .withColumn("nr", F.count("*").over(Window.partitionBy("right")))
        .withColumn("problem", F.when(~ok, "multitoken").when(F.col("left") == F.col("right"), "self_pair").when((F.col("nl") > 1) | (F.col("nr") > 1), "repeated"))
    )
    return marked.where("problem IS NOT NULL").select("line", "problem")


def lint(rows: DataFrame, kind: str) -> DataFrame:
    """(name, line, problem) of gold rows that break a rule of their kind; a row may break several.

    All kinds: entries are single tokens (the category's name and a synonym row's options may be
    phrases only where they tokenize to one), rows don't repeat. ws: no word with itself, finite
    scores. analogy: four different words, the answer none of the question. synonym: an answer
    that isn't the target, options that differ. category: no word in two categories of a table.
    """
    columns = {"ws": ["word1", "word2"], "analogy": ["a", "a_prime", "b", "b_prime"], "synonym": ["target", "answer"], "category": ["word"]}
    if kind not in columns:
        raise ValueError(f"kind is {kind!r}; it can be {sorted(columns)}")
    words = columns[kind]
    low = [F.lower(F.col(w)) for w in words]
    single = F.lit(True)
    for w in words:
        single = single & single_token(F.col(w))
    options = F.transform("distractors", F.lower) if kind == "synonym" else None
    key: list[Column] = low
    if kind == "ws":
        key = [F.least(*low), F.greatest(*low)]
    elif kind == "synonym":
        key = [low[0], F.array_sort(F.array_append(options, low[1]))]
    rows = rows.withColumn("__repeated", F.row_number().over(Window.partitionBy("name", *key).orderBy("line")) > 1)
    tests = [F.when(~single, "multitoken"), F.when(F.col("__repeated"), "duplicate")]
    if kind == "ws":
        score = F.expr("try_cast(score AS double)")
        tests += [F.when(low[0] == low[1], "self_pair"), F.when(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), "score")]
    elif kind == "analogy":
        tests += [F.when(F.size(F.array_distinct(F.array(*low))) < 4, "not_distinct"), F.when((low[3] == low[0]) | (low[3] == low[1]) | (low[3] == low[2]), "answer_in_question")]
    elif kind == "synonym":
        every = F.concat(F.array(*low), options)
        tests += [
            F.when(low[0] == low[1], "self_pair"),
            F.when(F.size(F.array_distinct(every)) < F.size(every), "not_distinct"),
            F.when(F.exists("distractors", lambda d: ~single_token(d)), "multitoken_distractor"),
        ]
    else:
        rows = rows.withColumn("__kinds", F.size(F.collect_set("category").over(Window.partitionBy("name", F.lower("word")))))
        tests += [F.when(F.col("__kinds") > 1, "two_categories"), F.when(F.trim("category") == "", "no_category")]
    return rows.select("name", "line", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("problem"))


def overlap(exact: DataFrame, other: DataFrame) -> DataFrame:
    """(q, overlap): the share of the neighbours (q, id) of `exact` that `other` has too."""
    a = exact.groupBy("q").agg(F.collect_set("id").alias("x"))
    b = other.groupBy("q").agg(F.collect_set("id").alias("y"))
    return a.join(b, "q", "left").select("q", (F.coalesce(F.size(F.array_intersect("x", "y")), F.lit(0)) / F.size("x")).alias("overlap"))


def value_error(exact: list[float], other: list[float]) -> float:
    """The largest relative error of singular values."""
    return max((abs(b - a) / max(a, 1e-30) for a, b in zip(exact, other)), default=0.0)


def cosine_agreement(pairs: DataFrame) -> DataFrame:
    """One row (score): rank correlation of two similarities (exact, other) over sampled pairs."""
    return spearman(pairs.withColumn("all", F.lit(1)), "exact", "other", "all").select("score")
