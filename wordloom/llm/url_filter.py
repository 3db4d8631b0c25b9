"""Operator 2: URL filter by a weighted vocabulary, counted with an Aho-Corasick automaton.

A term counts where it stands in the lower-cased URL with neither an ASCII letter nor an ASCII
digit directly before or behind it. A URL is rejected if it holds a strict term once, or
`soft_limit` different soft terms; repeats of one soft term don't add up. Each hit adds the
term's weight to the URL's score, which ranks URLs and doesn't decide.

Only the id and the URL are read; each Python worker builds the automaton once a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOFT_LIMIT = 2

#: weight -> terms
_STRICT = {
    9: "bestiality gangbang hardcoresex hardporn hentai porn pornhub porno pornstar redtube xnxx xvideos xxx xxxvideo youporn",
    8: "bdsm blowjob camgirl camgirls cumshot deepthroat fetish milf nudes sexcam sexchat sexdating spam-farm upskirt",
    7: "cialis escorts escortservice levitra nembutal tramadol viagra xanax-online",
    6: "adultdating adultfriend crackz hookup-site keygen serialz sex sexe sexo stripper striptease",
    5: "adult casino casinos escort nulled onlinecasino pirated slotgame sportsbook warez",
    4: "baccarat blackjack payday-loan paydayloan poker roulette torrentz",
}
_SOFT = {
    3: "betting bookmaker erotic erotica gambling jackpot lottery nude sexy slots",
    2: "bet bets cheapest crack cracked dating diet-pills hookup lingerie loan loans naked payday pharmacy pill pills prize replica replicas serial spam torrent torrents weightloss winner",
    1: "ads affiliate babes bonus buy-now cheap click clickbait clicks coupon coupons deal deals discount discounts earn-money farm free freebie girls giveaway hot mp3 promo singles track traffic win xtra",
}

#: term -> weight, of a general vocabulary of adult, gambling, pharmacy, piracy and spam terms; a table of one's own can be read by read_vocabulary
STRICT: dict[str, int] = {t: w for w, terms in _STRICT.items() for t in terms.split()}
SOFT: dict[str, int] = {t: w for w, terms in _SOFT.items() for t in terms.split()}

#: Most terms of a vocabulary that is read; the automaton goes to every task.
MAX_TERMS = 200_000

HITS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("strict_hits", "soft_hits", "soft_terms", "score")])


def _word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def count_terms(url: str, automaton: ahocorasick.Automaton) -> tuple[int, int, int, int]:
    """(strict hits, soft hits, different soft terms, score) of one URL."""
    url = url.lower()
    strict = soft = score = 0
    terms = set()
    last = len(url) - 1
    for end, (term, weight, is_strict) in automaton.iter(url):
        start = end - len(term)
        if (start >= 0 and _word(url[start])) or (end < last and _word(url[end + 1])):
            continue
        score += weight
        if is_strict:
            strict += 1
        else:
            soft += 1
            terms.add(term)
    return strict, soft, len(terms), score


def build(strict: dict[str, int], soft: dict[str, int]) -> ahocorasick.Automaton:
    """The automaton of both vocabularies; a term in both is strict."""
    automaton = ahocorasick.Automaton()
    for words, is_strict in ((soft, False), (strict, True)):
        for term, weight in words.items():
            if not term or term != term.lower():
                raise ValueError(f"terms are lower case and not empty: {term!r}")
            automaton.add_word(term, (term, weight, is_strict))
    automaton.make_automaton()
    return automaton


def read_vocabulary(spark: SparkSession, path: str, max_terms: int = MAX_TERMS) -> tuple[dict[str, int], dict[str, int]]:
    """(strict, soft) of a table (term string, weight int, strict boolean) in Parquet, or of lines `term TAB weight TAB strict|soft`.

    Null and repeated terms: rows without a term are skipped, and of several the strict and
    heavier one counts. Terms are lower-cased. More than max_terms raise: every task holds them all.
    """
    if path.rstrip("/").endswith((".txt", ".tsv")):
        parts = F.split("value", "\t")
        table = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(value, '#')").select(
            F.trim(parts[0]).alias("term"), F.try_element_at(parts, F.lit(2)).cast("int").alias("weight"), (F.trim(F.try_element_at(parts, F.lit(3))) == "strict").alias("strict")
        )
    else:
        table = spark.read.parquet(path)
    rows = table.select(F.lower(F.trim("term")).alias("term"), F.coalesce("weight", F.lit(1)).alias("weight"), F.coalesce("strict", F.lit(False)).alias("strict")).where("term <> ''")
    best = rows.groupBy("term").agg(F.max(F.struct("strict", "weight")).alias("m")).select("term", "m.*").limit(max_terms + 1).collect()
    if len(best) > max_terms:
        raise ValueError(f"the vocabulary has more than {max_terms} terms")
    strict = {r.term: int(r.weight) for r in best if r.strict}
    return strict, {r.term: int(r.weight) for r in best if not r.strict}


def _counted(pages: DataFrame, strict: dict[str, int], soft: dict[str, int]) -> DataFrame:
    """The columns of pages under the names __wl_<place>, and the hits."""
    build(strict, soft)
    if not strict and not soft:
        raise ValueError("the vocabulary is empty")
    cols = [F.col("`" + f.name.replace("`", "``") + "`").alias(f"__wl_{i}") for i, f in enumerate(pages.schema.fields)]
    plain = pages.select(F.col("url").cast("string").alias("__wl_url"), *cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build(strict, soft)
        for batch in batches:
            found = [count_terms(u or "", automaton) for u in batch.column(0).to_pylist()]
            hits = [pa.array([f[i] for f in found], pa.int32()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *hits], names=[*batch.schema.names[1:], *HITS.fieldNames()])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields[1:], *HITS.fields]))


def _rejected(soft_limit: int) -> Column:
    return (F.col("strict_hits") > 0) | (F.col("soft_terms") >= soft_limit)


def score_urls(pages: DataFrame, strict: dict[str, int] = STRICT, soft: dict[str, int] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """pages with the columns strict_hits, soft_hits, soft_terms, score and rejected (earlier ones of these names are replaced).

    A null or empty URL has no hits and isn't rejected. Repeated rows are judged alike. All rows
    are kept.
    """
    new = [*HITS.fieldNames(), "rejected"]
    rest = [F.col(f"__wl_{i}").alias(c) for i, c in enumerate(pages.columns) if c.lower() not in new]
    return _counted(pages, strict, soft).select(*rest, *HITS.fieldNames(), _rejected(soft_limit).alias("rejected"))


def keep_urls(pages: DataFrame, strict: dict[str, int] = STRICT, soft: dict[str, int] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """The rows of pages, all columns as they are, whose URL isn't rejected; see score_urls."""
    kept = _counted(pages, strict, soft).where(~_rejected(soft_limit))
    return kept.select(*(F.col(f"__wl_{i}").alias(c) for i, c in enumerate(pages.columns)))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits and the judgement of every page's URL."""
    return score_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def oracle(strict: dict[str, int] = STRICT, soft: dict[str, int] = SOFT, soft_limit: int = SOFT_LIMIT) -> str:
    """Every start of every term in every URL, tested by substrings."""
    rows = ", ".join(f"('{t}', {w}, {t in strict})" for t, w in {**soft, **strict}.items())
    return f"""WITH terms(term, w, strict) AS (VALUES {rows}),
    u AS (SELECT DISTINCT url, lower(coalesce(url, '')) AS l FROM pages),
    hits AS (SELECT u.url, t.*, len(list_filter(range(1, len(l) - len(term) + 2), lambda i: substr(l, i, len(term)) = term
        AND (i = 1 OR NOT regexp_matches(substr(l, i - 1, 1), '[a-z0-9]')) AND NOT regexp_matches(substr(l, i + len(term), 1), '[a-z0-9]'))) AS n
      FROM u, terms t WHERE contains(l, term)),
    s AS (SELECT url, sum(CASE WHEN strict THEN n ELSE 0 END)::INT AS strict_hits, sum(CASE WHEN strict THEN 0 ELSE n END)::INT AS soft_hits,
        (count(*) FILTER (WHERE n > 0 AND NOT strict))::INT AS soft_terms, sum(n * w)::INT AS score FROM hits GROUP BY url)
    SELECT p.page_id, p.url, coalesce(strict_hits, 0)::INT AS strict_hits, coalesce(soft_hits, 0)::INT AS soft_hits,
      coalesce(soft_terms, 0)::INT AS soft_terms, coalesce(score, 0)::INT AS score,
      coalesce(strict_hits, 0) > 0 OR coalesce(soft_terms, 0) >= {soft_limit} AS rejected
    FROM pages p LEFT JOIN s ON s.url IS NOT DISTINCT FROM p.url"""


ORACLE = oracle()
