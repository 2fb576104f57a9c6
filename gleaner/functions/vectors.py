"""Vector expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles; null if the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is all zero."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def thresholded(score: Column, least: float) -> Column:
    """The score from ``least`` on, else null: a clause that doesn't match."""
    positive = F.greatest(score, F.lit(0.0))
    return F.when(positive >= least, positive)


def affinity(distance: Column) -> Column:
    return F.exp(-distance * distance)


def sigmoid(x: Column, flat: float = 4.0) -> Column:
    return 1 / (1 + F.exp(-x / flat))
