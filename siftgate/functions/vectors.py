"""Vectors as arrays; arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(F.array(F.when(n == 0, F.lit(1.0)).otherwise(n)), lambda k: F.transform(v, lambda x: x / k))[0]


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors, to six places."""
    return F.round(dot(a, b), 6)


def truncated(v: Column, k: int) -> Column:
    return unit(F.slice(v, 1, k))


def angle(cos: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))


def ball_distance(cos: Column, radius: float = 0.5) -> Column:
    """Distance in the unit ball of two points at ``radius`` from the centre with this cosine."""
    gap = 2 * radius * radius * (1 - cos)
    return F.acosh(1 + 2 * gap / F.lit((1 - radius * radius) ** 2))
