"""Vector arithmetic on array columns, without Python (V01, V23 padding, M01)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where a norm is 0; null where a vector is null."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.when(size.isNotNull(), F.lit(0.0)))


def unit(a: Column | str) -> Column:
    """The vector over its norm; zeros stay zeros."""
    size = norm(a)
    return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(F.lit(0.0)))


def fit_length(a: Column | str, length: int) -> Column:
    """Truncate or pad with zeros."""
    return F.slice(F.concat(F.transform(a, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), length)), 1, length)


def clip_norm(a: Column | str, limit: float) -> Column:
    """Scale down to an L2 norm of at most ``limit``."""
    size = norm(a)
    factor = F.when(size > limit, F.lit(limit) / size).otherwise(F.lit(1.0))
    return F.transform(a, lambda x: x.cast("double") * factor)
