"""Vector maths over arrays, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def literal(vector: Sequence[float]) -> Column:
    """A query vector as a constant, so that a search is a projection and not a join."""
    return F.array(*[F.lit(float(x)) for x in vector])


def valid(vector: Column, size: int, tolerance: float = 1e-3) -> Column:
    """Whether a vector has the size, only finite numbers, and unit length within the tolerance."""
    finite = F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(vector) == size) & finite & (F.abs(norm(vector) - 1) <= tolerance)
