"""Vector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def unit(a: Column) -> Column:
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x / size)).otherwise(a)


def padded(a: Column, size: int) -> Column:
    """Zeros up to a size, then unit length: a text query in a wider image space."""
    return unit(F.concat(a, F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(a), F.lit(0)))))
