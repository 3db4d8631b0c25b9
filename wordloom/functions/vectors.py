"""Arithmetic of dense vectors held in arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this length a product is spelled out, so that it runs in generated code.
UNROLL = 256


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column, dim: int | None = None) -> Column:
    """Inner product of two arrays of doubles; with `dim` known and small it is one flat expression."""
    if dim and dim <= UNROLL:
        total = a[0] * b[0]
        for i in range(1, dim):
            total = total + a[i] * b[i]
        return total
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column, dim: int | None = None) -> Column:
    return F.sqrt(dot(a, a, dim))


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def unit(a: Column, length: Column) -> Column:
    """a / length; a zero vector stays as it is. The length is bound to a variable, else it would be computed for every element."""
    scaled = F.transform(F.array(length), lambda n: F.transform(a, lambda x: x / n))[0]
    return F.when(length > 0, scaled).otherwise(a)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def weigh(u: Column, s: list[float], power: float) -> Column:
    """u * s**power, elementwise."""
    factors = F.array(*(F.lit(float(x) ** power) for x in s))
    return F.zip_with(u, factors, lambda x, y: x * y)
