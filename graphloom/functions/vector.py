"""Vector functions as column expressions over arrays of floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where either is a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n < 1e-8, 0.0).otherwise(dot(a, b) / n)


def normalised(a: Column | str) -> Column:
    """Of length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def distance_score(d: Column) -> Column:
    """Of a squared distance between unit vectors."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - d / 2))
