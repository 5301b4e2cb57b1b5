"""Vector functions on array columns, in double precision and without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NaN if either vector is zero, null if either is null."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(float("nan"))).otherwise(dot(a, b) / n)
