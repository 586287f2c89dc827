"""Scores, tiers, calibration and rounding as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """Half up on the decimal value to 8 places, so that engines agree at the tie digit."""
    return F.round(x.cast("decimal(18,8)"), digits).cast("double")


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logit(p: Column, eps: float = 1e-4) -> Column:
    inside = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(inside / (1 - inside))


def calibrated(p: Column, kind: Column, a: Column, b: Column) -> Column:
    """identity, temperature (divide the log odds by a) or platt (a times the log odds plus b)."""
    return F.when(kind == "temperature", sigmoid(logit(p) / a)).when(kind == "platt", sigmoid(a * logit(p) + b)).otherwise(p)


def fused(p: Column, terms: Column) -> Column:
    """Percent from a probability and evidence terms: structs score, neutral, weight, applicability."""
    shift = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + F.coalesce(t["weight"] * t["applicability"] * (t["score"] - t["neutral"]), F.lit(0.0)))
    return 100 * sigmoid(logit(p) + shift)


def tier(score: Column, floors: dict[str, float], lowest: str) -> Column:
    """The first tier, by falling floor, that a score reaches."""
    ranked = sorted(floors.items(), key=lambda it: -it[1])
    return reduce(lambda acc, it: acc.when(score >= it[1], it[0]), ranked[1:], F.when(score >= ranked[0][1], ranked[0][0])).otherwise(lowest)


def tier_rank(name: Column, order: tuple[str, ...]) -> Column:
    """Place of a tier in ``order``, the gravest first; unknown ones come last."""
    return reduce(lambda acc, it: acc.when(name == it[1], it[0]), list(enumerate(order))[1:], F.when(name == order[0], 0)).otherwise(len(order))


def saturating(x: Column, scale: float) -> Column:
    return 1 - F.exp(-x / scale)


def eased(x: Column, full: float, none: float) -> Column:
    """1 up to ``full``, 0 from ``none``, linear between."""
    return clip01((F.lit(none) - x) / (none - full))


def decayed(sensitivity: Column, distance: Column, length: float) -> Column:
    return sensitivity * F.exp(-distance / length)


def any_of(terms: Column) -> Column:
    """1 less the product of 1 less each term of an array: the chance that any holds."""
    return 1 - F.aggregate(terms, F.lit(1.0), lambda acc, t: acc * (1 - F.coalesce(t, F.lit(0.0))))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the score interval of a share; null without trials."""
    p = k / n
    middle, spread, whole = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.when(n > 0, F.greatest((middle - spread) / whole, F.lit(0.0))), F.when(n > 0, F.least((middle + spread) / whole, F.lit(1.0)))


def log_loss(z: Column, label: Column) -> Column:
    """Of log odds against a 0/1 label, without overflow."""
    return F.greatest(z, F.lit(0.0)) - z * label + F.log1p(F.exp(-F.abs(z)))
