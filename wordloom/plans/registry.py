"""Queries of the engine by name, each with the SQL that must give the same rows.

A query takes (spark, sf_dir) and runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.functions import vectors as V
from wordloom.operators import builders, cooc, evaluate, experiments, factor, ppmi, search, vocab
from wordloom.operators.cooc import PairParams
from wordloom.plans import base
from wordloom.plans import oracles as O
from wordloom.plans.base import rounded, table
from wordloom.sources import corpus, shared

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

#: Vocabulary sizes: of counting queries, and of those that compare all rows with all others; both the default of base.encode.
KEEP_N, SMALL_N = 50_000, 50_000
DIM = 64


def _query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name] = f
        if oracle:
            _oracles[name] = oracle
        return f

    return add


def _long(spark: SparkSession, sf_dir: str, tokens) -> DataFrame:
    docs = base.documents(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))


# ---- text

_LONG = "SELECT doc_id, pos::INT AS pos, token FROM long"
_query("tokenize_v1", O.query(O.tok(O.V1), select=_LONG))(lambda s, d: _long(s, d, X.tokens_v1))
_query("tokenize_v2", O.query(O.tok(O.V2.replace("coalesce(text, '')", "nfc_normalize(text)")), select=_LONG))(lambda s, d: _long(s, d, X.tokens_v2))
_query("tokenize_v2_digits", O.query(O.tok(rf"regexp_extract_all(regexp_replace(lower(translate(text, '’‐‑‒–—', '''-----')), '\p{{Nd}}', '0', 'g'), '{O.COMPOUND}')"), select=_LONG))(
    lambda s, d: _long(s, d, lambda c: X.tokens_v2(c, normalize_digits=True, compose=False))
)
_query("tokenize_v2_cased", O.query(O.tok(O.V2.replace("lower(translate", "(translate")), select=_LONG))(lambda s, d: _long(s, d, lambda c: X.tokens_v2(c, lower=False, compose=False)))


@_query("simple_preproc", r"SELECT doc_id, regexp_replace(lower(text), '\p{Nd}', '0', 'g') AS text FROM documents")
def _simple_preproc(spark, sf_dir):
    return base.documents(spark, sf_dir).select("doc_id", X.lower_digits(F.col("text")).alias("text"))


@_query("strip_tags", "SELECT page_id, regexp_replace(html, '<([^>]+)>', '', 'g') AS text FROM pages")
def _strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


@_query("strip_non_alphanum", r"SELECT page_id, regexp_replace(html, '[^\p{L}\p{N}_]', ' ', 'g') AS text FROM pages")
def _strip_non_alphanum(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.strip_non_alphanum(F.col("html")).alias("text"))


@_query("to_item", O.query(O.tok(O.V2, "(SELECT item_id AS doc_id, text FROM (SELECT item_id, unnest(string_split(text, ' ')) AS text FROM benchmark))"), select="SELECT doc_id AS item_id, CASE WHEN len(tokens) = 1 THEN tokens[1] END AS item FROM tok"))
def _to_item(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", " ", -1)).alias("w"))
    return words.select("item_id", X.to_item(X.composed_tokens_v2(F.col("w"))).alias("item"))


@_query("sentences_tokens")
def _sentences_tokens(spark, sf_dir):
    docs = base.documents(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(X.sentence_tokens(F.col("text"))).alias("sentence", "tokens"))


@_query("lines_scan", r"SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS line_no, unnest(l) AS text FROM (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS l FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0B\f\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS p FROM documents))")
def _lines_scan(spark, sf_dir):
    return corpus.split_lines(base.documents(spark, sf_dir))


@_query("split_docs", "SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def _split_docs(spark, sf_dir):
    return corpus.split_newlines(base.documents(spark, sf_dir))


@_query("file_sample", "SELECT source, count(*) AS documents, ('0x' || substr(md5('1312-' || source), 1, 8))::BIGINT / 4294967296.0 <= 0.5 AS in_vocab FROM documents GROUP BY source")
def _file_sample(spark, sf_dir):
    per = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"))
    return per.withColumn("in_vocab", corpus.sample_files("source", 0.5))


# ---- vocabulary


@_query("vocab_df_tf", O.query(O.tok(), O.STATS, select="SELECT * FROM stats"))
def _vocab_df_tf(spark, sf_dir):
    return vocab.token_stats(base.texts(spark, sf_dir))


@_query("vocab_top_n", O.query(O.tok(), O.STATS, O.vocab(KEEP_N), select="SELECT token, df FROM vocab"))
def _vocab_top_n(spark, sf_dir):
    return vocab.cut(vocab.token_stats(base.texts(spark, sf_dir)), 1 << 62, keep_n=KEEP_N).select("token", "df")


@_query("vocab_ids", O.query(O.tok(), O.STATS, O.vocab(5000), select="SELECT id, token, df, tf FROM vocab"))
def _vocab_ids(spark, sf_dir):
    return vocab.build(base.texts(spark, sf_dir), keep_n=5000)


@_query("vocab_no_below_above", O.query(O.tok(), O.STATS, O.vocab(1000, "df BETWEEN 3 AND (SELECT floor(0.3 * count(*)) FROM documents)"), select="SELECT id, token, df, tf FROM vocab"))
def _vocab_no_below_above(spark, sf_dir):
    return vocab.build(base.texts(spark, sf_dir), no_below=3, no_above=0.3, keep_n=1000)


_KEPT = ("the", "der", "que")


@_query("vocab_keep_tokens", O.query(O.tok(), O.STATS, O.vocab(200, f"df BETWEEN 20 AND 60 OR token IN {_KEPT}", f"CASE WHEN token IN {_KEPT} THEN (SELECT count(*) FROM documents) ELSE df END"), select="SELECT id, token, df, tf FROM vocab"))
def _vocab_keep_tokens(spark, sf_dir):
    toks = base.texts(spark, sf_dir)
    n = toks.docs.count()
    return vocab.build(toks, no_below=20, no_above=(60.5 / n), keep_n=200, keep_tokens=_KEPT, num_docs=n)


@_query(
    "vocab_merge",
    "WITH " + O.tok("regexp_extract_all(lower(translate(text, '’‐‑‒–—', '''-----')), '" + O.COMPOUND + "')") + """,
    st AS (SELECT source AS file, token, count(DISTINCT doc_id) AS df, count(*) AS tf, min(doc_id) AS first_doc FROM long JOIN documents USING (doc_id) GROUP BY 1, 2)
    SELECT token, sum(df)::BIGINT AS df, sum(tf)::BIGINT AS tf, min((file, first_doc))[1] AS file, min((file, first_doc))[2] AS first_doc FROM st GROUP BY token""",
)
def _vocab_merge(spark, sf_dir):
    docs = vocab.spread(table(spark, sf_dir, "documents").select(F.col("source").alias("file"), "doc_id", "text"))
    stats = vocab.token_stats(vocab.Texts(docs), "file")
    return vocab.merge(stats)


@_query("encode_unk", O.query(O.encoded(KEEP_N), select="SELECT doc_id, pos::INT AS pos, id FROM ids"))
def _encode_unk(spark, sf_dir):
    toks = base.texts(spark, sf_dir)
    words, size = base.settled(vocab.build(toks, keep_n=KEEP_N), KEEP_N)
    return vocab.encode_long(toks, words, size)


@_query("token_counts_unk", O.query(O.encoded(KEEP_N), select="SELECT id, count(*) AS n FROM ids GROUP BY id"))
def _token_counts_unk(spark, sf_dir):
    return vocab.token_counts(base.encode(base.texts(spark, sf_dir), KEEP_N).ids)


@_query("corpus_size", O.query(O.tok(), select="SELECT count(*) AS documents, sum(len(tokens))::BIGINT AS tokens FROM tok"))
def _corpus_size(spark, sf_dir):
    return vocab.corpus_size(base.tokens(spark, sf_dir))


# ---- pairs


def _pairs(name: str, params: PairParams, *ctes: str) -> None:
    oracle = O.query(O.encoded(KEEP_N), *ctes, select="SELECT w, c, round(n, 6) AS n FROM cells")

    @_query(name, oracle)
    def run(spark, sf_dir, params=params):
        enc = base.encode(base.texts(spark, sf_dir), KEEP_N)
        return rounded(cooc.count_pairs(enc.ids, enc.size, params), "n")  # read once, so not written before


_F = 5e-3  # a subsampling factor that takes effect on small corpora
_pairs("pairs_flat_w2", PairParams(dynamic_window=None, subsample=None), O.slots(), O.pairs(2, None), O.PLAIN)
_pairs("pairs_deter_w2", PairParams(subsample=None), O.slots(), O.pairs(2), O.PLAIN)
_pairs("pairs_deter_w5", PairParams(window=5, subsample=None), O.slots(), O.pairs(5), O.PLAIN)
_pairs("pairs_decay_w5", PairParams(window=5, dynamic_window="decay", subsample=None), O.slots(), O.pairs(5, "decay"), O.PLAIN)
_pairs("pairs_keep_oov", PairParams(delete_oov=False, subsample=None), O.slots(False), O.pairs(2), O.PLAIN)
_pairs("pairs_dynprob", PairParams(window=5, dynamic_window="prob", subsample=None), O.slots(), O.pairs(5, "prob"), O.PLAIN)
_pairs("pairs_sub_clean", PairParams(subsample="prob", subsample_factor=_F), O.slots(True, "prob", _F), O.pairs(2), O.PLAIN)
_pairs("pairs_sub_dirty", PairParams(subsample="dirty", subsample_factor=_F), O.slots(True, "dirty", _F), O.pairs(2), O.PLAIN)
_pairs("pairs_both_random", PairParams(dynamic_window="prob", subsample="dirty", subsample_factor=_F), O.slots(True, "dirty", _F), O.pairs(2, "prob"), O.PLAIN)
_pairs("pairs_sub_deter", PairParams(), O.slots(), O.pairs(2), O.scaled())
_pairs("pairs_min_count", PairParams(min_count=5), O.slots(), O.pairs(2), O.scaled(least=5))


@_query("subsample_keep", O.query(O.encoded(KEEP_N), O.KEEP.format(factor=_F), select="SELECT id, round(p, 9) AS p FROM keep"))
def _subsample_keep(spark, sf_dir):
    counts = vocab.token_counts(base.encode(base.texts(spark, sf_dir), KEEP_N).ids)
    return rounded(cooc.keep_factors(counts, _F), "p", digits=9)


@_query("pair_sparsity", O.query(O.encoded(KEEP_N), O.slots(), O.pairs(2), select="SELECT count(*) AS cells, round(count(*) / pow(v + 1, 2), 9) AS share FROM raw, size GROUP BY v"))
def _pair_sparsity(spark, sf_dir):
    enc = base.encode(base.texts(spark, sf_dir), KEEP_N)
    return rounded(cooc.sparsity(base.cells(enc, PairParams(subsample=None)), enc.size), "share", digits=9)


@_query(
    "pairs_baskets",
    "WITH ids AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, l_partkey AS id FROM lineitem), size AS (SELECT max(p_partkey) + 1 AS v FROM part), " + O.slots().replace("ORDER BY pos", "ORDER BY pos, id") + ", " + O.pairs(2) + " SELECT w::INT AS w, c::INT AS c, round(n, 6) AS n FROM raw",
)
def _pairs_baskets(spark, sf_dir):
    """Parts that stand near each other in an order: any table of sequences is a corpus."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").cast("int").alias("id"))
    size = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] + 1
    ids = lines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    return rounded(cooc.count_pairs(ids, size, PairParams(subsample=None)), "n")


# ---- PMI


def _counted(spark, sf_dir, keep_n=KEEP_N):
    enc = base.encode(base.texts(spark, sf_dir), keep_n)
    return enc, base.cells(enc, PairParams())


@_query("pmi_marginals", O.query(O.matrix(KEEP_N), select="SELECT id, round(sum_w, 6) AS sum_w, round(sum_c, 6) AS sum_c FROM (SELECT w AS id, sum_w FROM rs) JOIN (SELECT c AS id, sum_c FROM cs) USING (id)"))
def _pmi_marginals(spark, sf_dir):
    rows, columns = ppmi.marginals(_counted(spark, sf_dir)[1])
    return rounded(rows.withColumnRenamed("w", "id").join(columns.withColumnRenamed("c", "id"), "id"), "sum_w", "sum_c")


def _epmi(name: str, cds: float) -> None:
    @_query(name, O.query(O.matrix(KEEP_N, cds=cds), select="SELECT w, c, round(epmi, 3) AS epmi FROM pmi"))
    def run(spark, sf_dir):
        enc, counts = _counted(spark, sf_dir)
        return rounded(ppmi.exp_pmi(counts, enc.size, cds), "epmi", digits=3)  # of hundreds of thousands: finer digits are beyond what sums in another order agree in


_epmi("epmi", 0.75)
_epmi("epmi_cds1", 1)


def _sppmi(name: str, neg: float, normalize: bool) -> None:
    @_query(name, O.query(O.matrix(KEEP_N, neg=neg), select=f"SELECT w, c, round(x, 6) AS x FROM {'un' if normalize else 'sp'}"))
    def run(spark, sf_dir):
        return rounded(base.sppmi(base.encode(base.texts(spark, sf_dir), KEEP_N), PairParams(), neg=neg, normalize=normalize), "x")


_sppmi("sppmi_neg1", 1, False)
_sppmi("sppmi_neg5", 5, False)
_sppmi("sppmi_norm", 1, True)


# ---- sparse search: every word is a query


def _small(spark, sf_dir):
    enc = base.encode(base.texts(spark, sf_dir), SMALL_N)
    return enc, shared.save(base.sppmi(enc, PairParams()), "matrix")


_DOT = "dots AS (SELECT a.w AS q, b.w AS id, sum(a.x * b.x) AS score FROM un a JOIN un b USING (c) GROUP BY 1, 2)"


@_query("sparse_represent", O.query(O.matrix(SMALL_N), select="SELECT w, c, round(x, 6) AS x FROM un"))
def _sparse_represent(spark, sf_dir):
    return rounded(_small(spark, sf_dir)[1], "x")


@_query(
    "sparse_similarity",
    O.query(O.matrix(SMALL_N), _DOT, "p AS (SELECT a.id AS a, (a.id * 7 + 3) % v AS b FROM vocab a, size)", select="SELECT a, b::INT AS b, round(coalesce(score, 0), 6) AS similarity FROM p LEFT JOIN dots ON q = a AND dots.id = b"),
)
def _sparse_similarity(spark, sf_dir):
    enc, matrix = _small(spark, sf_dir)
    pairs = enc.vocab.select(F.col("id").alias("a"), ((F.col("id") * 7 + 3) % enc.size).cast("int").alias("b"))
    return rounded(ppmi.similarity(matrix, pairs), "similarity").select("a", "b", "similarity")


@_query(
    "sparse_most_similar",
    O.query(O.matrix(SMALL_N), _DOT, "r AS (SELECT q, id, round(score, 6) AS score, (row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, id DESC))::INT AS rank FROM dots)", select="SELECT * FROM r WHERE rank <= 10"),
)
def _sparse_most_similar(spark, sf_dir):
    enc, matrix = _small(spark, sf_dir)
    words = matrix.select(F.col("w").alias("q")).distinct().withColumn("word", F.col("q"))
    return rounded(search.sparse_most_similar(matrix, words, 10, 6), "score").select("q", "id", "score", "rank")


def _triples(ids: DataFrame, size: int) -> DataFrame:
    """A query for each id: the next two positive, itself negative."""
    part = F.expr(f"array(struct(cast((q + 1) % {size} AS int) AS word, 1 AS sign), struct(cast((q + 2) % {size} AS int) AS word, 1 AS sign), struct(q AS word, -1 AS sign))")
    return ids.select("q", F.explode(part).alias("p")).select("q", F.col("p.word").cast("int").alias("word"), "p.sign")


_PARTS = "parts AS (SELECT id AS q, (id + 1) % {n} AS word, 1 AS sign FROM {t}, {s} UNION ALL SELECT id, (id + 2) % {n}, 1 FROM {t}, {s} UNION ALL SELECT id, id, -1 FROM {t})"
_RANK = "r AS (SELECT q, id, round(score, 6) AS score, (row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, id))::INT AS rank FROM sc)"
_TOP = "SELECT q, id, score, rank FROM r WHERE rank <= 10"


@_query("sparse_cosadd")  # its SQL takes minutes on whole tables; tests hold it against brute force
def _sparse_cosadd(spark, sf_dir):
    enc, matrix = _small(spark, sf_dir)
    asked = _triples(enc.vocab.select(F.col("id").alias("q")), enc.size)
    return rounded(search.sparse_add(matrix, asked, 10, 6), "score").select("q", "id", "score", "rank")


@_query("sparse_cosmul")
def _sparse_cosmul(spark, sf_dir):
    enc, matrix = _small(spark, sf_dir)
    asked = _triples(enc.vocab.select(F.col("id").alias("q")), enc.size)
    return rounded(search.sparse_mul(matrix, asked, 10, 6), "score").select("q", "id", "score", "rank")


# ---- dense search over `embeddings`: every row is a query


def _vectors(spark, sf_dir) -> DataFrame:
    rows = vocab.spread(table(spark, sf_dir, "embeddings"))
    return rows.select(F.col("vec_id").cast("int").alias("id"), V.doubles(F.col("embedding")).alias("vec"), "label")


@_query("dense_norm", O.query(O.VEC, select="SELECT id::INT AS id, (generate_subscripts(vec, 1) - 1)::INT AS i, round(unnest(vec) / sqrt(list_dot_product(vec, vec)), 6) + 0.0 AS x FROM v"))
def _dense_norm(spark, sf_dir):
    unit = _vectors(spark, sf_dir).select("id", V.unit(F.col("vec"), V.norm(F.col("vec"), DIM)).alias("vec"))
    return rounded(unit.select("id", F.posexplode("vec").alias("i", "x")), "x")


@_query("dense_similarity", O.query(O.VEC, select="SELECT a.id::INT AS a, b.id::INT AS b, round(list_dot_product(a.vec, b.vec), 6) + 0.0 AS similarity FROM v a, v b, n WHERE b.id = (a.id * 7 + 3) % n"))
def _dense_similarity(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    pairs = vectors.select(F.col("id").alias("a"), ((F.col("id") * 7 + 3) % vectors.count()).cast("int").alias("b"))
    return rounded(evaluate.similarities(evaluate.Embedding(vectors, DIM), pairs), "similarity").select("a", "b", "similarity")


@_query(
    "dense_most_similar",
    O.query(O.VEC, "r AS (SELECT a.id AS q, b.id, round(list_dot_product(a.vec, b.vec), 6) + 0.0 AS score FROM v a, v b)", "k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id DESC) AS rank FROM r)", select="SELECT q::INT AS q, id::INT AS id, score, rank::INT AS rank FROM k WHERE rank <= 10"),
)
def _dense_most_similar(spark, sf_dir):
    vectors = _vectors(spark, sf_dir).select("id", "vec")
    asked = vectors.select(F.col("id").alias("q"), F.col("vec").alias("qvec"))
    return rounded(search.dense_most_similar(vectors, asked, 10, DIM, digits=6), "score").select("q", "id", "score", "rank")


_DPARTS = _PARTS.format(n="n", t="v", s="n")


@_query(
    "cosadd",
    O.query(
        O.VEC,
        "qs AS (SELECT a.id AS q, [b.vec[i] + c.vec[i] - a.vec[i] for i in range(1, 65)] AS s FROM v a, v b, v c, n WHERE b.id = (a.id + 1) % n AND c.id = (a.id + 2) % n)",
        "sc AS (SELECT q, id, list_dot_product(vec, s) / sqrt(list_dot_product(s, s)) AS score FROM qs, v)",
        _RANK,
        select=_TOP.replace("q,", "q::INT AS q,", 1).replace(" id,", " id::INT AS id,", 1),
    ),
)
def _cosadd(spark, sf_dir):
    vectors = _vectors(spark, sf_dir).select("id", "vec")
    asked = _triples(vectors.select(F.col("id").alias("q")), vectors.count())
    return rounded(search.dense_add(vectors, asked, DIM, 10, digits=6), "score").select("q", "id", "score", "rank")


@_query(
    "cosmul",
    O.query(
        O.VEC,
        "sc AS (SELECT a.id AS q, x.id, (list_dot_product(b.vec, x.vec) + 1) / 2 * (list_dot_product(c.vec, x.vec) + 1) / 2 / ((list_dot_product(a.vec, x.vec) + 1) / 2 + 0.01) AS score FROM v a, v b, v c, n, v x WHERE b.id = (a.id + 1) % n AND c.id = (a.id + 2) % n)",
        _RANK,
        select=_TOP.replace("q,", "q::INT AS q,", 1).replace(" id,", " id::INT AS id,", 1),
    ),
)
def _cosmul(spark, sf_dir):
    vectors = _vectors(spark, sf_dir).select("id", "vec")
    asked = _triples(vectors.select(F.col("id").alias("q")), vectors.count())
    return rounded(search.dense_mul(vectors, asked, DIM, 10, digits=6), "score").select("q", "id", "score", "rank")


@_query(
    "nn_in_set",
    O.query(O.VEC, "p AS (SELECT a.label, a.id AS q, b.id, round(list_dot_product(a.vec, b.vec), 6) AS score FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id)", "k AS (SELECT *, row_number() OVER (PARTITION BY label, q ORDER BY score DESC, id) AS r FROM p)", select="SELECT label, q::INT AS id, id::INT AS other, score + 0.0 AS score FROM k WHERE r = 1"),
)
def _nn_in_set(spark, sf_dir):
    return rounded(search.nearest_in_set(_vectors(spark, sf_dir), DIM, "label", 6), "score")


@_query(
    "keyed_vectors_similar",
    O.query(O.VEC, "p AS (SELECT a.id AS q, b.id, round(list_dot_product(a.vec, b.vec), 6) + 0.0 AS score FROM v a JOIN v b ON a.id <> b.id)", "k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM p)", select="SELECT 'w' || q AS token, 'w' || id AS neighbour, score, rank::INT AS rank FROM k WHERE rank <= 5"),
)
def _keyed_vectors_similar(spark, sf_dir):
    vectors = _vectors(spark, sf_dir).select("id", "vec")
    asked = vectors.select(F.col("id").alias("q"), F.col("vec").alias("qvec"))
    found = search.dense_most_similar(vectors, asked, 5, DIM, include_self=False, digits=6)
    words = vectors.select("id", F.concat(F.lit("w"), F.col("id")).alias("token"))
    named = search.named(found, words).withColumnRenamed("token", "neighbour")
    return rounded(named, "score").select(F.concat(F.lit("w"), F.col("q")).alias("token"), "neighbour", "score", "rank")


# ---- evaluation: gold tables over the ids of `embeddings`, some of whose words are unknown


def _word_vocab(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", F.concat(F.lit("w"), F.col("id")).alias("token"))


def _gold(spark, sf_dir, *selects: str) -> tuple[DataFrame, DataFrame]:
    """The vectors, and the union of the selects (SQL common to both engines) over e(i, n, label)."""
    vectors = _vectors(spark, sf_dir)
    rows = vectors.select(F.col("id").alias("i"), "label").crossJoin(F.broadcast(vectors.agg(F.count("*").alias("n"))))
    out = None
    for s in selects:
        columns, where = s.split(" WHERE ") if " WHERE " in s else (s, "true")
        part = rows.where(where).selectExpr(*[c.strip() for c in columns.split(";")])
        out = part if out is None else out.unionByName(part)
    return vectors, out


def _gold_sql(*selects: str) -> str:
    parts = []
    for s in selects:
        columns, where = s.split(" WHERE ") if " WHERE " in s else (s, "true")
        parts.append(f"SELECT {columns.replace(';', ',')} FROM e WHERE {where}")
    return "e AS (SELECT vec_id AS i, label, n FROM embeddings, n), gold AS (" + " UNION ALL ".join(parts) + ")"


_WS = (
    "'a' AS name; 0 AS ord; i AS line; concat('w', i) AS word1; CASE WHEN i % 10 = 7 THEN 'x' ELSE concat('w', (i * 7 + 3) % n) END AS word2; (i * 37) % 101 AS score",
    "'b' AS name; 1 AS ord; i AS line; concat('w', (i * 7 + 3) % n) AS word1; concat('w', i) AS word2; (i * 11) % 53 AS score WHERE i % 2 = 0",
    "'b' AS name; 1 AS ord; i + n AS line; concat('w', (i * 11 + 5) % n) AS word1; concat('w', i) AS word2; (i * 13) % 53 AS score WHERE i % 3 = 0",
)
_WS_SQL = """f AS (SELECT name, ord, a.id AS a, b.id AS b, score AS gold FROM gold JOIN v a ON 'w' || a.id = word1 JOIN v b ON 'w' || b.id = word2),
sims AS (SELECT f.*, round(list_dot_product(x.vec, y.vec), 6) AS sim FROM f JOIN v x ON x.id = a JOIN v y ON y.id = b),
rk AS (SELECT name, rank() OVER (PARTITION BY name ORDER BY sim) + (count(*) OVER (PARTITION BY name, sim) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY name ORDER BY gold) + (count(*) OVER (PARTITION BY name, gold) - 1) / 2.0 AS ry FROM sims),
sp AS (SELECT name, corr(rx, ry) AS score, count(*) AS n FROM rk GROUP BY name),
tot AS (SELECT name, count(*) AS total FROM gold GROUP BY name),
keys AS (SELECT DISTINCT name, ord, least(a, b) AS k1, greatest(a, b) AS k2 FROM f),
cl AS (SELECT name, count(*) FILTER (WHERE ord = first) AS weight FROM (SELECT *, min(ord) OVER (PARTITION BY k1, k2) AS first FROM keys) GROUP BY name),
rep AS (SELECT sp.name, score, (total - n) / total AS oov, score - abs(score) * ((total - n) / total) AS fullscore, weight FROM sp JOIN tot USING (name) JOIN cl USING (name))"""
_REPORT = "SELECT name, round(score, 6) AS score, round(oov, 6) AS oov, round(fullscore, 6) AS fullscore, weight FROM rep"


def _similarity_report(spark, sf_dir):
    vectors, gold = _gold(spark, sf_dir, *_WS)
    return evaluate.eval_similarity(evaluate.Embedding(vectors.select("id", "vec"), DIM, 6), gold, _word_vocab(vectors), "v2-composed")


@_query("eval_similarity_spearman", O.query(O.VEC, _gold_sql(*_WS), _WS_SQL, select=_REPORT))
def _eval_similarity(spark, sf_dir):
    return rounded(_similarity_report(spark, sf_dir), "score", "oov", "fullscore")


@_query("eval_micro_macro", O.query(O.VEC, _gold_sql(*_WS), _WS_SQL, select="SELECT round(sum(weight * score) / sum(weight), 6) AS micro, round(avg(score), 6) AS macro FROM rep WHERE weight > 0"))
def _eval_micro_macro(spark, sf_dir):
    return rounded(evaluate.summary(_similarity_report(spark, sf_dir)), "micro", "macro")


_AN = (
    "'a' AS name; 0 AS ord; i AS line; concat('w', i) AS a; concat('w', (i + 1) % n) AS a_prime; concat('w', (i + 2) % n) AS b; concat('w', (i * 3 + 1) % n) AS b_prime WHERE i % 4 <> 1",
    "'b' AS name; 1 AS ord; i AS line; concat('w', i) AS a; concat('w', (i + 1) % n) AS a_prime; CASE WHEN i % 9 = 2 THEN 'x' ELSE concat('w', (i + 2) % n) END AS b; concat('w', (i * 3 + 1) % n) AS b_prime",
)


def _analogy_sql(score: str) -> str:
    return f"""f AS (SELECT name, ord, line, a.id AS a, a2.id AS a2, b.id AS b, b2.id AS b2 FROM gold g JOIN v a ON 'w' || a.id = g.a JOIN v a2 ON 'w' || a2.id = g.a_prime
      JOIN v b ON 'w' || b.id = g.b JOIN v b2 ON 'w' || b2.id = g.b_prime WHERE b2.id NOT IN (a.id, a2.id, b.id)),
    sc AS (SELECT f.*, x.id AS guess, {score} AS s FROM f JOIN v va ON va.id = a JOIN v va2 ON va2.id = a2 JOIN v vb ON vb.id = b, v x WHERE x.id NOT IN (a, a2, b)),
    best AS (SELECT *, row_number() OVER (PARTITION BY name, line ORDER BY round(s, 6) DESC, guess) AS r FROM sc),
    sp AS (SELECT name, avg(CASE WHEN guess = b2 THEN 1.0 ELSE 0.0 END) AS score, count(*) AS n FROM best WHERE r = 1 GROUP BY name),
    tot AS (SELECT name, count(*) AS total FROM gold GROUP BY name),
    keys AS (SELECT DISTINCT name, ord, a, a2, b, b2 FROM f),
    cl AS (SELECT name, count(*) FILTER (WHERE ord = first) AS weight FROM (SELECT *, min(ord) OVER (PARTITION BY a, a2, b, b2) AS first FROM keys) GROUP BY name),
    rep AS (SELECT sp.name, score, (total - n) / total AS oov, score - abs(score) * ((total - n) / total) AS fullscore, weight FROM sp JOIN tot USING (name) JOIN cl USING (name))"""


_ADD = "(list_dot_product(x.vec, va2.vec) + list_dot_product(x.vec, vb.vec) - list_dot_product(x.vec, va.vec)) / sqrt(list_dot_product([va2.vec[i] + vb.vec[i] - va.vec[i] for i in range(1, 65)], [va2.vec[i] + vb.vec[i] - va.vec[i] for i in range(1, 65)]))"
_MUL = "(list_dot_product(x.vec, va2.vec) + 1) / 2 * (list_dot_product(x.vec, vb.vec) + 1) / 2 / ((list_dot_product(x.vec, va.vec) + 1) / 2 + 0.01)"


def _eval_analogy(name: str, objective: str, score: str) -> None:
    @_query(name, O.query(O.VEC, _gold_sql(*_AN), _analogy_sql(score), select=_REPORT))
    def run(spark, sf_dir):
        vectors, gold = _gold(spark, sf_dir, *_AN)
        report = evaluate.eval_analogies(evaluate.Embedding(vectors.select("id", "vec"), DIM, 6), gold, _word_vocab(vectors), "v2-composed", objective)
        return rounded(report, "score", "oov", "fullscore")


_eval_analogy("eval_analogy", "add", _ADD)
_eval_analogy("eval_analogy_mul", "mul", _MUL)

_SYN = (
    "'a' AS name; 0 AS ord; i AS line; concat('w', i) AS target; concat('w', (i * 3 + 1) % n) AS answer; concat('w', (i * 5 + 2) % n) AS d1; concat('w', (i * 7 + 3) % n) AS d2",
    "'b' AS name; 1 AS ord; i AS line; concat('w', i) AS target; concat('w', (i * 3 + 1) % n) AS answer; concat('w', (i * 5 + 2) % n) AS d1; CASE WHEN i % 5 = 0 THEN 'x' ELSE concat('w', (i * 11 + 4) % n) END AS d2 WHERE i % 2 = 1",
)


@_query(
    "eval_synonym",
    O.query(
        O.VEC,
        _gold_sql(*_SYN),
        """f AS (SELECT name, ord, line, t.id AS t, a.id AS a, x.id AS x, y.id AS y, round(list_dot_product(t.vec, a.vec), 6) > greatest(round(list_dot_product(t.vec, x.vec), 6), round(list_dot_product(t.vec, y.vec), 6)) AS hit
          FROM gold g JOIN v t ON 'w' || t.id = g.target JOIN v a ON 'w' || a.id = g.answer JOIN v x ON 'w' || x.id = g.d1 JOIN v y ON 'w' || y.id = g.d2
          WHERE t.id NOT IN (a.id, x.id, y.id) AND a.id <> x.id AND a.id <> y.id AND x.id <> y.id),
        sp AS (SELECT name, avg(hit::INT) AS score, count(*) AS n FROM f GROUP BY name), tot AS (SELECT name, count(*) AS total FROM gold GROUP BY name),
        keys AS (SELECT DISTINCT name, ord, t, a, x, y FROM f),
        cl AS (SELECT name, count(*) FILTER (WHERE ord = first) AS weight FROM (SELECT *, min(ord) OVER (PARTITION BY t, a, x, y) AS first FROM keys) GROUP BY name),
        rep AS (SELECT sp.name, score, (total - n) / total AS oov, score - abs(score) * ((total - n) / total) AS fullscore, weight FROM sp JOIN tot USING (name) JOIN cl USING (name))""",
        select=_REPORT,
    ),
)
def _eval_synonym(spark, sf_dir):
    vectors, gold = _gold(spark, sf_dir, *_SYN)
    gold = gold.select("name", "ord", "line", "target", "answer", F.array("d1", "d2").alias("distractors"))
    return rounded(evaluate.eval_synonyms(evaluate.Embedding(vectors.select("id", "vec"), DIM, 6), gold, _word_vocab(vectors), "v2-composed"), "score", "oov", "fullscore")


_CAT = (
    "'a' AS name; 0 AS ord; i AS line; concat('w', i) AS word; concat('c', label) AS category",
    "'a' AS name; 0 AS ord; i + n AS line; concat('x', i) AS word; concat('c', label) AS category WHERE i % 6 = 0",
    "'b' AS name; 1 AS ord; i AS line; concat('w', i) AS word; concat('c', label) AS category WHERE i % 3 = 0",
)


@_query(
    "eval_category_purity",
    O.query(
        O.VEC,
        _gold_sql(*_CAT),
        """f AS (SELECT name, ord, v.id, min(line) AS place, arg_max(category, line) AS category FROM gold JOIN v ON 'w' || v.id = word GROUP BY ALL),
        sz AS (SELECT name, count(*) AS n FROM f GROUP BY name),
        p AS (SELECT a.name, a.id, a.category, b.category AS other, row_number() OVER (PARTITION BY a.name, a.id ORDER BY round(list_dot_product(x.vec, y.vec), 6) DESC, b.place) AS r
          FROM f a JOIN f b ON a.name = b.name AND a.id <> b.id JOIN v x ON x.id = a.id JOIN v y ON y.id = b.id),
        sp AS (SELECT name, avg((category = other)::INT) AS score FROM p WHERE r = 1 GROUP BY name),
        ba AS (SELECT name, sum(s * (s - 1)) / max(n * (n - 1)) AS baseline FROM (SELECT name, category, count(*) AS s FROM f GROUP BY 1, 2) JOIN sz USING (name) GROUP BY name),
        tot AS (SELECT name, count(*) AS total FROM gold GROUP BY name),
        cl AS (SELECT name, count(*) FILTER (WHERE ord = first) AS weight FROM (SELECT *, min(ord) OVER (PARTITION BY id) AS first FROM f) GROUP BY name),
        rep AS (SELECT name, score, (total - n) / total AS oov, score - abs(score) * ((total - n) / total) AS fullscore, weight, baseline FROM sp JOIN sz USING (name) JOIN ba USING (name) JOIN tot USING (name) JOIN cl USING (name))""",
        select=_REPORT.replace("weight FROM", "weight, round(baseline, 6) AS baseline FROM"),
    ),
)
def _eval_category(spark, sf_dir):
    vectors, gold = _gold(spark, sf_dir, *_CAT)
    report = evaluate.eval_categories(evaluate.Embedding(vectors.select("id", "vec"), DIM, 6), gold, _word_vocab(vectors), "v2-composed")
    return rounded(report, "score", "oov", "fullscore", "baseline")


@_query(
    "coverage",
    O.query(
        O.tok(),
        O.STATS,
        O.vocab(KEEP_N),
        f"b AS (SELECT 'item' || item_id AS name, unnest({O.V2}) AS word FROM benchmark)",
        select="SELECT name, 'category' AS kind, count(*) AS rows, count(id) AS covered, round(count(id) / count(*), 6) AS coverage FROM b LEFT JOIN vocab ON token = word GROUP BY name",
    ),
)
def _coverage(spark, sf_dir):
    words, size = base.settled(vocab.build(base.texts(spark, sf_dir), keep_n=KEEP_N), KEEP_N)
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item"), F.col("item_id")).alias("name"), F.posexplode(X.composed_tokens_v2(F.col("text"))).alias("line", "word"))
    return rounded(evaluate.coverage(items, "category", words, "v2-composed", size), "coverage")


# ---- experiments

_RUNS = [
    ("svd", "scipy", 100.0, 2.0, 0.31, 0.35),
    ("svd", "scipy", 300.0, 2.0, 0.42, 0.38),
    ("svd", "scikit", 300.0, 5.0, 0.42, 0.41),
    ("pmi", None, None, 2.0, 0.28, 0.22),
    ("pmi", None, None, 5.0, 0.25, 0.27),
]
_MORE = [("svd", "scipy", 300.0, 2.0, 0.99, 0.99), ("pmi", None, None, 5.0, 0.5, 0.5), ("pmi", None, None, 9.0, 0.2, 0.1)]
_RUN_SCHEMA = "method string, impl string, dim double, pair_args__window double, micro_results double, macro_results double"


def _values(rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in r) + ")" for r in rows)
    return f"(VALUES {body}) t(method, impl, dim, pair_args__window, micro_results, macro_results)"


@_query("results_filter", f"SELECT DISTINCT * FROM {_values(_RUNS)} WHERE method = 'svd' AND pair_args__window = 2 ORDER BY micro_results DESC LIMIT 100")
def _results_filter(spark, sf_dir):
    return experiments.results(spark.createDataFrame(_RUNS, _RUN_SCHEMA), {"method": "svd", "pair_args": {"window": 2.0}})


@_query("results_insert_ignore", f"SELECT * FROM {_values(_RUNS)} UNION ALL SELECT * FROM {_values(_MORE[2:])}")
def _results_insert_ignore(spark, sf_dir):
    have, new = spark.createDataFrame(_RUNS, _RUN_SCHEMA), spark.createDataFrame(_MORE, _RUN_SCHEMA)
    return experiments.insert_ignore(have, new, ["method", "impl", "dim", "pair_args__window"])


# ---- builders



def _single(word: str) -> str:
    return f"len(regexp_extract_all(lower({word}), '{O.COMPOUND}')) = 1"



@_query(
    "build_synonym",
    f"""WITH g AS (SELECT n_nationkey AS line, n_name AS term, r_name AS synonym, lower(n_name) AS t, lower(r_name) AS s FROM nation JOIN region ON n_regionkey = r_regionkey),
    w AS (SELECT t AS k, line, 0 AS side, term AS word FROM g UNION ALL SELECT s, line, 1, synonym FROM g),
    pool AS (SELECT k, arg_min(word, (line, side)) AS word FROM w GROUP BY k HAVING {_single('arg_min(word, (line, side))')}),
    known AS (SELECT t AS x, s AS y FROM g UNION SELECT s, t FROM g UNION SELECT t, t FROM g),
    o AS (SELECT g.*, pool.k, pool.word, row_number() OVER (PARTITION BY line ORDER BY {O.duck_draw(0, 'distractor', 't', 's', 'pool.k')}, pool.k) AS r
      FROM g, pool WHERE t <> s AND {_single('term')} AND {_single('synonym')} AND NOT EXISTS (SELECT 1 FROM known WHERE x = t AND y = pool.k)),
    q AS (SELECT line, t, s, term, synonym, list(word ORDER BY r) AS d, list_sort(list_concat([s], list(k ORDER BY r))) AS ks FROM o WHERE r <= 3 GROUP BY line, t, s, term, synonym HAVING count(*) = 3),
    u AS (SELECT *, row_number() OVER (PARTITION BY t, ks ORDER BY line) AS n FROM q)
    SELECT line, term AS target, synonym AS answer, d[1] AS d1, d[2] AS d2, d[3] AS d3 FROM u WHERE n = 1""",
)
def _build_synonym(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("line"), F.col("n_name").alias("term"), F.col("r_name").alias("synonym"))
    made = builders.build_synonym(rows, 3, 0)
    return made.select("line", "target", "answer", *(F.col("distractors")[i].alias(f"d{i + 1}") for i in range(3)))


@_query(
    "build_category",
    "WITH " + O.tok().replace("tok AS (SELECT doc_id,", "tok AS (SELECT lang AS doc_id,", 1) + """,
    r AS (SELECT (row_number() OVER (ORDER BY token, doc_id))::INT AS line, token AS word, doc_id AS category FROM (SELECT DISTINCT token, doc_id FROM long)),
    f AS (SELECT *, replace(word, 'ß', 'ss') AS k FROM r),
    m AS (SELECT *, min(category) OVER (PARTITION BY k) AS a, max(category) OVER (PARTITION BY k) AS b, row_number() OVER (PARTITION BY k ORDER BY line) AS n FROM f)
    SELECT line, word, category FROM m WHERE a = b AND n = 1""",
)
def _build_category(spark, sf_dir):
    from pyspark.sql import Window

    docs = vocab.spread(table(spark, sf_dir, "documents").select("lang", "text"))
    words = docs.select(F.explode(X.composed_tokens_v2(F.col("text"))).alias("word"), F.col("lang").alias("category")).distinct()
    return builders.build_category(words.withColumn("line", F.row_number().over(Window.orderBy("word", "category"))))


_NEXT = f"t AS (SELECT item_id, {O.V2} AS a FROM benchmark), r AS (SELECT 'item' || item_id AS name, item_id * 100000 + i AS line, a[i] AS word1, a[i + 1] AS word2, i % 10 AS score FROM t, unnest(range(1, len(a))) x(i))"


def _next_words(spark, sf_dir) -> DataFrame:
    """Each two words that follow each other in a benchmark item."""
    items = table(spark, sf_dir, "benchmark").select("item_id", X.composed_tokens_v2(F.col("text")).alias("a"))
    long = items.select("item_id", "a", F.explode(F.expr("sequence(1, size(a) - 1)")).alias("i")).where("size(a) > 1")
    return long.select(F.concat(F.lit("item"), F.col("item_id")).alias("name"), (F.col("item_id") * 100000 + F.col("i")).alias("line"), F.expr("a[i - 1]").alias("word1"), F.expr("a[i]").alias("word2"), (F.col("i") % 10).alias("score"))


@_query(
    "curate_pairs",
    "WITH " + _NEXT + """, m AS (SELECT *, CASE WHEN word1 = word2 THEN 'self_pair' END AS p FROM r),
    k AS (SELECT *, row_number() OVER (PARTITION BY least(word1, word2), greatest(word1, word2), p IS NULL ORDER BY line) AS n FROM m)
    SELECT line, word1, word2, score, coalesce(p, CASE WHEN n > 1 THEN 'duplicate' END) AS problem FROM k""",
)
def _curate_pairs(spark, sf_dir):
    return builders.curate(_next_words(spark, sf_dir).drop("name"))


@_query(
    "lint_pairs",
    "WITH " + _NEXT + """, k AS (SELECT *, row_number() OVER (PARTITION BY name, least(word1, word2), greatest(word1, word2) ORDER BY line) AS n FROM r)
    SELECT name, line, 'self_pair' AS problem FROM k WHERE word1 = word2 UNION ALL SELECT name, line, 'duplicate' FROM k WHERE n > 1""",
)
def _lint_pairs(spark, sf_dir):
    return builders.lint(_next_words(spark, sf_dir), "ws")


@_query(
    "compile_quads",
    f"""WITH p AS (SELECT n_nationkey AS line, n_name AS l, 'capital' || n_nationkey AS r FROM nation),
    j AS (SELECT a.line, a.l AS a, a.r AS a_prime, b.l AS b, b.r AS b_prime, row_number() OVER (PARTITION BY a.line ORDER BY {O.duck_draw(0, 'partner', 'a.line', 'b.line')}, b.line) AS n FROM p a JOIN p b ON a.line <> b.line)
    SELECT line, a, a_prime, b, b_prime FROM j WHERE n <= 5""",
)
def _compile_quads(spark, sf_dir):
    pairs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("line"), F.col("n_name").alias("left"), F.concat(F.lit("capital"), F.col("n_nationkey")).alias("right"))
    return builders.compile_quadruples(pairs, 5, 0)


@_query(
    "check_base_pairs",
    f"""WITH p AS (SELECT n_nationkey AS line, n_name AS l, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey),
    m AS (SELECT line, CASE WHEN NOT ({_single('l')} AND {_single('r')}) THEN 'multitoken' WHEN l = r THEN 'self_pair'
      WHEN count(*) OVER (PARTITION BY l) > 1 OR count(*) OVER (PARTITION BY r) > 1 THEN 'repeated' END AS problem FROM p)
    SELECT line, problem FROM m WHERE problem IS NOT NULL""",
)
def _check_base_pairs(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    pairs = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("line"), F.col("n_name").alias("left"), F.col("r_name").alias("right"))
    return builders.check_base_pairs(pairs)


@_query(
    "neighbour_overlap",
    O.query(
        O.VEC,
        "f AS (SELECT id, vec, vec[1:32] AS half FROM v)",
        "a AS (SELECT x.id AS q, y.id, row_number() OVER (PARTITION BY x.id ORDER BY round(list_dot_product(x.vec, y.vec), 6) DESC, y.id) AS r FROM f x JOIN f y ON x.id <> y.id)",
        "b AS (SELECT x.id AS q, y.id, row_number() OVER (PARTITION BY x.id ORDER BY round(list_dot_product(x.half, y.half), 6) DESC, y.id) AS r FROM f x JOIN f y ON x.id <> y.id)",
        select="SELECT a.q::INT AS q, count(b.id) / 10 AS overlap FROM a LEFT JOIN b ON a.q = b.q AND a.id = b.id AND b.r <= 10 WHERE a.r <= 10 GROUP BY a.q",
    ),
)
def _neighbour_overlap(spark, sf_dir):
    full = _vectors(spark, sf_dir).select("id", "vec")
    half = full.select("id", F.slice("vec", 1, 32).alias("vec"))
    near = [search.dense_most_similar(v, v.select(F.col("id").alias("q"), F.col("vec").alias("qvec")), 10, dim, include_self=False, digits=6) for v, dim in ((full, 64), (half, 32))]
    return builders.overlap(*near)


# ---- factorization: no SQL


def _factors(spark, sf_dir, dim: int = 50, impl: str = "scipy"):
    enc = base.encode(base.texts(spark, sf_dir), SMALL_N)
    return enc, factor.svd(base.sppmi(enc, PairParams(), normalize=False), enc.size + 1, dim, impl)


@_query("svd_singular_values")
def _svd_singular_values(spark, sf_dir):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(_factors(spark, sf_dir)[1].s)], "i int, s double")


@_query("svd_randomized_values")
def _svd_randomized_values(spark, sf_dir):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(_factors(spark, sf_dir, impl="scikit")[1].s)], "i int, s double")


@_query("svd_embed")
def _svd_embed(spark, sf_dir):
    return factor.embed(_factors(spark, sf_dir)[1], eig=0.5)


@_query("svd_neighbours")
def _svd_neighbours(spark, sf_dir):
    enc, factors = _factors(spark, sf_dir)
    vectors = factor.embed(factors)
    asked = vectors.select(F.col("id").alias("q"), F.col("vec").alias("qvec"))
    found = search.dense_most_similar(vectors, asked, 5, len(factors.s), include_self=False)
    return search.named(found, enc.vocab)


# ---- flagship


@_query(
    "flagship_neighbours",
    O.query(
        O.matrix(KEEP_N),
        _DOT,
        "r AS (SELECT q, id, round(score, 6) AS score, (row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, id DESC))::INT AS rank FROM dots)",
        select="SELECT a.token, b.token AS neighbour, score, rank FROM r JOIN vocab a ON a.id = q JOIN vocab b ON b.id = r.id WHERE rank <= 10",
    ),
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest words of every word of the vocabulary, from raw documents."""
    enc = base.encode(base.texts(spark, sf_dir), KEEP_N)
    matrix = shared.save(base.sppmi(enc, PairParams()), "matrix")
    words = enc.vocab.select(F.col("id").alias("q"), F.col("id").alias("word"))
    found = search.sparse_most_similar(matrix, words, 10, 6)
    a, b = (enc.vocab.select(F.col("id").alias(i), F.col("token").alias(t)) for i, t in (("q", "token"), ("id", "neighbour")))
    return rounded(found.join(F.broadcast(a), "q").join(F.broadcast(b), "id"), "score").select("token", "neighbour", "score", "rank")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
