"""Operator 6: removal of repeated lines by overlapping three-line windows.

Every three consecutive lines of a text (parts between line feeds) are one window, known by a
128-bit hash. A window that also starts at an earlier place, places being ordered by (doc_id,
line number), is a later occurrence; the lines that such windows cover are removed, overlapping
windows together. Windows of three blank lines are not counted. The texts are never shuffled
for the search, only hashes; they meet their removed line numbers in one join by doc_id.

A window that a large share of all documents has is spread: its occurrences are compared inside
`SALTS` groups of documents first, where all but the first are later ones for sure, and only the
groups' first ones, at most `SALTS` a window, are compared with each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm._store import Workspace

WIDTH = 3
SALTS = 64

_LINES = "split(text, '\\n', -1)"


def _windows(docs: DataFrame) -> DataFrame:
    """(doc_id, sum, i, a, b): the hash (a, b) of the window that begins at line i of the text with that sum."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    lines = texts.select("doc_id", F.xxhash64("text").alias("sum"), F.expr(_LINES).alias("lines")).where(f"size(lines) >= {WIDTH}")
    hashed = lines.select(
        "doc_id",
        "sum",
        F.expr("transform(lines, x -> struct(xxhash64(x) AS a, xxhash64(1, x) AS b, trim(x) = '' AS blank))").alias("h"),
    )
    runs = hashed.select(
        "doc_id",
        "sum",
        F.posexplode(
            F.expr(
                f"transform(slice(h, 1, size(h) - {WIDTH - 1}), (x, i) -> "
                "IF(x.blank AND h[i + 1].blank AND h[i + 2].blank, NULL, "
                "struct(xxhash64(x.a, h[i + 1].a, h[i + 2].a) AS a, xxhash64(x.b, h[i + 1].b, h[i + 2].b) AS b)))"
            )
        ).alias("i", "w"),
    )
    return runs.where("w IS NOT NULL").select("doc_id", "sum", "i", "w.a", "w.b")


def later_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, sum, starts): the first lines of the windows of each text that occurred at an earlier place."""


    def marked(rows: DataFrame, *key: str) -> DataFrame:
        first = F.first(F.struct("doc_id", "i")).over(Window.partitionBy(*key).orderBy("doc_id", "i"))
        return rows.withColumn("first", first).withColumn("later", F.expr("NOT (doc_id = first.doc_id AND i = first.i)")).drop("first")

    salted = _windows(docs).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    local = Workspace(docs.sparkSession).save(marked(salted, "a", "b", "salt").drop("salt"), "windows")
    among = marked(local.where("NOT later").drop("later"), "a", "b")
    later = local.where("later").unionByName(among).where("later")
    return later.groupBy("doc_id", "sum").agg(F.collect_set("i").alias("starts"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs, all rows and columns, whose texts have lost the lines of later windows.

    The kept lines are joined by line feeds again. Rows with a null doc_id or text, and texts of
    fewer than three lines, are unchanged and count for nothing. Rows that share doc_id share
    their places; equal ones are one text. A text all of whose lines go becomes empty.
    """
    found = later_windows(docs).select(F.col("doc_id").alias("__wl_id"), F.col("sum").alias("__wl_sum"), F.col("starts").alias("__wl_starts"))
    joined = docs.join(found, (F.col("doc_id").cast("long") == F.col("__wl_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__wl_sum")), "left")
    # the lines are bound to a variable, else they would be split again for each; array_except goes by hashes, so a long text takes linear time
    covered = f"flatten(transform(__wl_starts, s -> sequence(s, s + {WIDTH - 1})))"
    rest = f"transform(array({_LINES}), l -> transform(array_except(sequence(0, size(l) - 1), {covered}), k -> l[k]))[0]"
    kept = F.expr(f"IF(__wl_starts IS NULL, text, array_join({rest}, '\\n'))")
    return joined.withColumn("text", kept).select(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines of later windows."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT doc_id, i, a[i] || chr(10) || a[i + 1] || chr(10) || a[i + 2] AS x
  FROM l, unnest(range(1, len(a) - 1)) AS t(i) WHERE NOT (trim(a[i]) = '' AND trim(a[i + 1]) = '' AND trim(a[i + 2]) = '')),
r AS (SELECT doc_id, i, min((doc_id, i)) OVER (PARTITION BY x) AS first FROM w),
gone AS (SELECT DISTINCT doc_id, i + j AS k FROM r, unnest(range(0, 3)) AS t(j) WHERE (doc_id, i) <> first),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY k) AS rest
  FROM (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS k FROM l) p
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.k = p.k) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL WHEN d.doc_id IS NULL THEN d.text ELSE coalesce(k.rest, '') END AS text,
  d.lang, d.source, d.n_chars
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
