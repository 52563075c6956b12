"""Arithmetic on array<double> columns, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_vector(column: Column) -> Column:
    return column.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sqnorm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def sqdist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def scale(a: Column, h: float | Column) -> Column:
    """Each component divided by a bandwidth (a scalar, or an array of one for each)."""
    if isinstance(h, Column):
        return F.zip_with(a, h, lambda x, y: x / y)
    return F.transform(a, lambda x: x / F.lit(float(h)))


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
