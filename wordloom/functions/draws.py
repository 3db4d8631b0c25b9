"""Pseudo-random numbers as functions of a key, the same under any partitioning and in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 2**32


def draw(seed: int | str, purpose: str, *key: Column) -> Column:
    """An integer in [0, 2**32) from an MD5 digest of the seed, the purpose and the key."""
    text = F.concat_ws("-", F.lit(str(seed)), F.lit(purpose), *(k.cast("string") for k in key))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(seed: int | str, purpose: str, *key: Column) -> Column:
    """A number in [0, 1)."""
    return draw(seed, purpose, *key) / F.lit(float(RANGE))


def duck_draw(seed: int | str, purpose: str, *key: str) -> str:
    """`draw` as DuckDB SQL."""
    parts = ", ".join(["'" + str(seed) + "'", "'" + purpose + "'", *(f"{k}::VARCHAR" for k in key)])
    return f"('0x' || substr(md5(concat_ws('-', {parts})), 1, 8))::BIGINT"
