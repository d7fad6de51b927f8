"""Vector expressions on array<float> columns, in double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where a side is null or empty, lengths differ or a norm is zero."""
    size = norm(a) * norm(b)
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(fits & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def usable(v: Column, dim: int) -> Column:
    """dim finite numbers that are not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def normalise(v: Column) -> Column:
    """Length one; null where the norm is zero."""
    size = norm(v)
    return F.when(size > 0, F.transform(doubles(v), lambda x: x / size))
