"""Vector expressions on array columns; floats become doubles before any arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once, not anew per element of an array that ``use`` goes through."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit(v: Column) -> Column:
    """The vector at length 1, null for a zero vector."""
    return bind(norm(v), lambda n: F.when(n > 0, F.transform(doubles(v), lambda x: x / n)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, kept within 0 and 2; null for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(a, b) / n)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def usable(v: Column, dimensions: int) -> Column:
    """Vectors of so many finite numbers that aren't all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dimensions) & fine & F.exists(v, lambda x: x != 0), F.lit(False))
