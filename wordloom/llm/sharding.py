"""Operator 10: hierarchical weighted hash tree.

A topology is a tree: region -> rack -> shard -> weight; an inner node weighs as much as its
shards together. A key descends from the root: at each node every child draws -ln(u) / weight,
u being a uniform number hashed from the key and the child's path, and the least draw wins. A
child wins in proportion to its weight, and a change of weights moves keys only to or from the
subtrees whose weights changed: all other draws stay as they are.

The draws are MD5 hashes, so they can be repeated in any engine. The tree is a literal in the
plan: assignment is a projection, without shuffle or join, at any number of rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Topology = dict[str, dict[str, dict[str, float]]]

TOPOLOGY: Topology = {
    "east": {"e1": {"s1": 1.0, "s2": 1.0, "s3": 2.0}, "e2": {"s1": 2.0, "s2": 2.0}},
    "north": {"n1": {"s1": 1.0, "s2": 1.0}, "n2": {"s1": 3.0, "s2": 1.0, "s3": 1.0}},
    "west": {"w1": {"s1": 4.0}, "w2": {"s1": 1.0, "s2": 1.0, "s3": 1.0, "s4": 1.0}, "w3": {"s1": 0.5, "s2": 0.5}},
}


def edges(topology: Topology) -> list[tuple[str, str, str, float]]:
    """(level, parent's path, name, weight) of all nodes; nodes of no weight get no keys and are left out."""
    out = []
    for region, racks in topology.items():
        for rack, shards in racks.items():
            for shard, weight in shards.items():
                if weight < 0:
                    raise ValueError(f"negative weight: {region}/{rack}/{shard}")
                out.append(("shard", f"{region}/{rack}", shard, float(weight)))
            out.append(("rack", region, rack, float(sum(shards.values()))))
        out.append(("region", "", region, float(sum(sum(s.values()) for s in racks.values()))))
    out = [e for e in out if e[3] > 0]
    if not out:
        raise ValueError("the topology has no weight")
    return out


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _children(topology: Topology, level: str) -> str:
    by_parent: dict[str, list[str]] = {}
    for at, parent, name, weight in edges(topology):
        if at == level:
            by_parent.setdefault(parent, []).append(f"struct({_quoted(name)} AS name, {weight!r}D AS w)")
    return "map(" + ", ".join(f"{_quoted(p)}, array({', '.join(c)})" for p, c in by_parent.items()) + ")"


def _draw(topology: Topology, level: str, parent: str, key: str) -> str:
    """The child of `parent` (an SQL expression of its path) that wins the key."""
    u = f"(cast(conv(substr(md5(concat_ws('|', {key}, {parent}, c.name)), 1, 13), 16, 10) AS double) + 0.5D) / 4503599627370496D"
    return f"array_min(transform(element_at({_children(topology, level)}, {parent}), c -> struct(-ln({u}) / c.w AS cost, c.name AS name))).name"


def assign(df: DataFrame, key: str = "doc_id", topology: Topology = TOPOLOGY) -> DataFrame:
    """df with the columns region, rack and shard (of these names, earlier ones are replaced).

    Equal keys get the same shard; a null key counts as the text \\N and so is assigned too.
    """
    k = "__wl_key"
    out = df.withColumn(k, F.coalesce(F.col("`" + key.replace("`", "``") + "`").cast("string"), F.lit("\\N")))
    out = out.withColumn("region", F.expr(_draw(topology, "region", "''", k)))
    out = out.withColumn("rack", F.expr(_draw(topology, "rack", "region", k)))
    out = out.withColumn("shard", F.expr(_draw(topology, "shard", "concat(region, '/', rack)", k)))
    return out.drop(k)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign(docs.select("doc_id", "source", "n_chars"))


def oracle(topology: Topology = TOPOLOGY) -> str:
    nodes = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in e[:3]) + f", {e[3]!r}::DOUBLE)" for e in edges(topology))
    draw = "-ln((('0x' || substr(md5(concat_ws('|', k.key, {parent}, n.name)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / n.w"
    step = """{name} AS (SELECT key, {keep}arg_min(name, cost) AS {name} FROM (
      SELECT k.key, {keep_k}n.name, {draw} AS cost FROM {source} k JOIN nodes n ON n.level = '{name}' AND n.parent = {parent}) GROUP BY ALL)"""
    region = step.format(name="region", keep="", keep_k="", source="keys", parent="''", draw=draw.format(parent="''"))
    rack = step.format(name="rack", keep="region, ", keep_k="k.region, ", source="region", parent="k.region", draw=draw.format(parent="k.region"))
    shard = step.format(name="shard", keep="region, rack, ", keep_k="k.region, k.rack, ", source="rack", parent="k.region || '/' || k.rack", draw=draw.format(parent="k.region || '/' || k.rack"))
    return f"""WITH nodes(level, parent, name, w) AS (VALUES {nodes}),
    keys AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '\\N') AS key FROM documents),
    {region}, {rack}, {shard}
    SELECT d.doc_id, d.source, d.n_chars, s.region, s.rack, s.shard
    FROM documents d JOIN shard s ON s.key = coalesce(d.doc_id::VARCHAR, '\\N')"""


ORACLE = oracle()


def topology_from_json(text: str) -> Topology:
    """A topology from its JSON text."""
    return {str(r): {str(k): {str(s): float(w) for s, w in x.items()} for k, x in racks.items()} for r, racks in json.loads(text).items()}
