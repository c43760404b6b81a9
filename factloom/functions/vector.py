"""Vectors as arrays. For many pairs use operators.search, which multiplies blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for null, empty or zero vectors and for unequal widths; within [-1, 1]."""
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    n = norm(a) * norm(b)
    return F.when(fits & (n > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))).otherwise(0.0)


def usable(v: Column, dim: int) -> Column:
    """dim elements, all finite, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def midpoint(a: Column, b: Column) -> Column:
    """Unit vector halfway between two of one width, otherwise a."""
    return F.when(F.size(a) == F.size(b), unit(F.zip_with(a, b, lambda x, y: (x + y) / 2))).otherwise(a)
