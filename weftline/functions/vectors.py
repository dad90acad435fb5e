"""Vector expressions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def positions(d: int, at: Column) -> Column:
    """Sine and cosine position codes of width d."""
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: _wave(at, i, d))


def _wave(at: Column, i: Column, d: int) -> Column:
    angle = at / F.pow(F.lit(10000.0), (i - i % 2) / F.lit(float(d)))
    return F.when(i % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))
