"""Vectors as arrays of numbers: column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))))


def unit(v: Column) -> Column:
    """The vector of length 1; one of length 0 stays."""
    return F.when(norm(v) == 0, as_double(v)).otherwise(F.transform(as_double(v), lambda x: x / norm(v)))


def mean(v: Column) -> Column:
    return total(as_double(v)) / F.size(v)


def central_moment(v: Column, k: int) -> Column:
    m = mean(v)
    return total(F.transform(as_double(v), lambda x: F.pow(x - m, F.lit(k)))) / F.size(v)


def effective_dimensions(v: Column) -> Column:
    """Square of the sum of squares over the sum of fourth powers."""
    squares = F.transform(as_double(v), lambda x: x * x)
    fourth = total(F.transform(squares, lambda x: x * x))
    return F.when(fourth == 0, F.lit(0.0)).otherwise(total(squares) * total(squares) / fourth)


def quantised(v: Column, steps: int = 255) -> Column:
    """Values after rounding to `steps` equal steps between the vector's least and largest value."""
    low, high = F.array_min(as_double(v)), F.array_max(as_double(v))
    return F.when(high == low, as_double(v)).otherwise(F.transform(as_double(v), lambda x: F.round((x - low) / (high - low) * steps) / steps * (high - low) + low))
