"""Vector columns: arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """inner product; null entries make it null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalised(a: Column) -> Column:
    """the vector at length 1; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """cosine; null if either has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def mahalanobis(x: Column, mean: Column, inverse: Column) -> Column:
    """square root of max(d' S^-1 d, 0) for an inverse covariance (array of rows)."""
    d = F.zip_with(x, mean, lambda p, q: p - q)
    return F.sqrt(F.greatest(dot(d, F.transform(inverse, lambda row: dot(row, d))), F.lit(0.0)))
