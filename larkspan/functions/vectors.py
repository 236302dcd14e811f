"""Expressions over vectors stored as ARRAY<FLOAT>; arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 where a norm is 0, an error where dimensions differ."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    value = F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors of different dimensions")).cast("double"))


def valid(a: Column, dimension: int | None = None) -> Column:
    """Not empty, of the dimension asked for, all elements finite."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = (F.size(a) > 0) & finite
    return F.coalesce(ok if dimension is None else ok & (F.size(a) == dimension), F.lit(False))
