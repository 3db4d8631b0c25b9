"""The SQL that the queries of `registry` are held against, assembled from common table expressions."""

from __future__ import annotations

import math

from wordloom.functions.draws import duck_draw

WORD = r"[\p{L}\p{N}_]+"
COMPOUND = r"[\p{L}\p{N}_]+(?:[''\-][\p{L}\p{N}_]+)*"
V2 = f"regexp_extract_all(lower(translate(coalesce(text, ''), '’‐‑‒–—', '''-----')), '{COMPOUND}')"
V1 = rf"regexp_extract_all(regexp_replace(regexp_replace(lower(coalesce(text, '')), '\p{{Nd}}', '0', 'g'), '<([^>]+)>', '', 'g'), '{WORD}')"


def tok(expr: str = V2, source: str = "documents") -> str:
    return f"tok AS (SELECT doc_id, {expr} AS tokens FROM {source}), long AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM tok)"


STATS = "stats AS (SELECT token, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS tf, min(doc_id) AS first_doc FROM long GROUP BY token)"


def vocab(keep_n: int, where: str = "true", rank: str = "df") -> str:
    return (
        f"vocab AS (SELECT (row_number() OVER (ORDER BY first_doc, token) - 1)::INT AS id, token, df, tf FROM "
        f"(SELECT * FROM stats WHERE {where} ORDER BY {rank} DESC, first_doc, token LIMIT {keep_n}))"
    )


IDS = "size AS (SELECT count(*)::INT AS v FROM vocab), ids AS (SELECT doc_id, pos, coalesce(id, v)::INT AS id FROM long LEFT JOIN vocab USING (token), size)"


def encoded(keep_n: int) -> str:
    return ", ".join([tok(), STATS, vocab(keep_n), IDS])


KEEP = """cnt AS (SELECT id, count(*) AS n FROM ids GROUP BY id), total AS (SELECT {factor} * sum(n) AS t FROM cnt),
keep AS (SELECT id, sqrt(t / n) AS p FROM cnt, total WHERE n > t)"""


def slots(delete_oov: bool = True, subsample: str | None = None, factor: float = 1e-5, seed: int = 1312) -> str:
    """kept(doc_id, p, id): tokens as the window sees them; blanked slots have a null id."""
    where = "id < v" if delete_oov else "true"
    first = f"base AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS p FROM ids, size WHERE {where})"
    if subsample in ("prob", "dirty"):
        drawn = f"drawn AS (SELECT doc_id, b.p, CASE WHEN k.p IS NULL OR {duck_draw(seed, 'keep', 'doc_id', 'b.p')} / 4294967296.0 < k.p THEN b.id END AS id FROM base b LEFT JOIN keep k ON k.id = b.id)"
        if subsample == "dirty":
            last = "kept AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS p FROM drawn WHERE id IS NOT NULL)"
        else:
            last = "kept AS (SELECT doc_id, id, p FROM drawn)"
        return ", ".join([KEEP.format(factor=factor), first, drawn, last])
    return first + ", kept AS (SELECT doc_id, id, p FROM base)"


def pairs(window: int, mode: str | None = "deter", rate: float = 0.25, seed: int = 1312) -> str:
    """raw(w, c, n)."""
    right = f"nxt AS (SELECT a.doc_id, a.p, b.p AS q, a.id AS w, b.id AS c, d FROM kept a, range(1, {window + 1}) t(d), kept b WHERE b.doc_id = a.doc_id AND b.p = a.p + d AND a.id IS NOT NULL AND b.id IS NOT NULL)"
    if mode == "prob":
        radius = f"1 + {duck_draw(seed, 'rad', 'doc_id', 'p')} % {window}"
        near = f"kr AS MATERIALIZED (SELECT doc_id, p, id, {radius} AS r FROM kept), nr AS MATERIALIZED (SELECT a.id AS w, b.id AS c, d, a.r AS ra, b.r AS rb FROM (SELECT *, unnest(range(1, {window + 1})) AS d FROM kr) a JOIN kr b ON b.doc_id = a.doc_id AND b.p = a.p + d)"
        both = "both_ AS (SELECT w, c FROM nr WHERE d <= ra UNION ALL SELECT c, w FROM nr WHERE d <= rb)"
        return f"{near}, {both}, raw AS (SELECT w, c, count(*)::DOUBLE AS n FROM both_ WHERE w IS NOT NULL AND c IS NOT NULL GROUP BY w, c)"
    weight = {"deter": lambda d: (window + 1 - d) / window, "decay": lambda d: math.exp(-rate * (d - 1))}.get(mode or "", lambda d: 1.0)
    total = " + ".join(f"count(*) FILTER (WHERE d = {d}) * {weight(d)!r}::DOUBLE" for d in range(1, window + 1))
    both = "both_ AS (SELECT w, c, d FROM nxt UNION ALL SELECT c, w, d FROM nxt)"
    return f"{right}, {both}, raw AS (SELECT w, c, {total} AS n FROM both_ GROUP BY w, c)"


def scaled(factor: float = 1e-5, least: float = 0) -> str:
    """cells(w, c, n): pruned, then scaled by the keep factors."""
    return KEEP.format(factor=factor) + f""", cells AS (SELECT w, c, n * coalesce(a.p, 1) * coalesce(b.p, 1) AS n FROM raw
    LEFT JOIN keep a ON a.id = w LEFT JOIN keep b ON b.id = c WHERE n >= {least})"""


PLAIN = "cells AS (SELECT w, c, n FROM raw)"


def pmi(cds: float = 0.75) -> str:
    return f"""rs AS (SELECT w, sum(n) AS sum_w FROM cells GROUP BY w), cs AS (SELECT c, pow(sum(n), {cds}) AS sum_c FROM cells GROUP BY c),
    tot AS (SELECT sum(sum_c) AS total FROM cs),
    pmi AS (SELECT w, c, n * total / (sum_w * sum_c) AS epmi FROM cells JOIN rs USING (w) JOIN cs USING (c), tot)"""


def shifted(neg: float = 1) -> str:
    return f"""sp AS (SELECT w, c, ln(epmi) - ln({neg}) AS x FROM pmi WHERE epmi > 0 AND ln(epmi) - ln({neg}) > 0),
    un AS (SELECT w, c, x / sqrt(sum(x * x) OVER (PARTITION BY w)) AS x FROM sp)"""


def matrix(keep_n: int, window: int = 2, cds: float = 0.75, neg: float = 1) -> str:
    return ", ".join([encoded(keep_n), slots(), pairs(window), scaled(), pmi(cds), shifted(neg)])


def query(*ctes: str, select: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + select


VEC = "n AS (SELECT count(*) AS n FROM embeddings), v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)"
