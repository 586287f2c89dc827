"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def each(v: Column, number: Column, f) -> Column:
    """f(x, number) of every part; ``number`` is worked out once a vector, not once a part."""
    bound = F.array(F.struct(v.alias("v"), number.alias("n")))
    return F.transform(bound, lambda s: F.transform(s["v"], lambda x: f(x, s["n"])))[0]


def unit(v: Column) -> Column:
    """Length 1; a zero vector stays as it is."""
    return each(v, norm(v), lambda x, n: F.when(n > 0, x / n).otherwise(x))


def centred(v: Column) -> Column:
    """Less its mean, then of length 1, so that dot products are Pearson correlations."""
    less = each(v, total(v) / F.size(v), lambda x, mean: x - mean)
    return F.transform(F.array(less), unit)[0]


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)
