"""Beta-distributed credibility of sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.score import clamp
from factloom.functions.temporal import hours_between

# Credibility that a label settles; quantiles of the normal distribution.
LABELS = {"moderator": 1.0, "admin": 1.0, "flagged": 0.05, "troll": 0.05}
Z = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}


def mean(a: Column, b: Column) -> Column:
    return F.when(a + b == 0, 0.5).otherwise(a / (a + b))


def variance(a: Column, b: Column) -> Column:
    n = a + b
    return F.when(n == 0, 0.25).otherwise(a * b / (n * n * (n + 1)))


def effective(labels: Column, a: Column, b: Column) -> Column:
    """The first label that settles it, otherwise the mean."""
    value = lambda x: F.when(x.isin("moderator", "admin"), 1.0).when(x.isin("flagged", "troll"), 0.05)
    settled = F.filter(F.transform(labels, value), lambda v: v.isNotNull())
    return F.coalesce(F.try_element_at(settled, F.lit(1)), mean(a, b))


def interval(labels: Column, a: Column, b: Column, asserted: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Normal approximation, half as wide again for fewer than ten claims."""
    z = F.when(asserted < 10, Z.get(level, 1.96) * 1.5).otherwise(Z.get(level, 1.96))
    m, d = effective(labels, a, b), z * F.sqrt(variance(a, b))
    return F.greatest(F.lit(0.0), m - d), F.least(F.lit(1.0), m + d)


def decayed(a: Column, b: Column, updated: Column, t: Column, per_hour: float = 0.001) -> tuple[Column, Column]:
    """Parameters that have moved towards (1, 1) since the last update."""
    f = F.exp(-per_hour * F.greatest(F.lit(0.0), hours_between(updated, t)))
    return 1 + (a - 1) * f, 1 + (b - 1) * f


def observation_weight(confidence: Column, agreeing: Column, factual: Column) -> Column:
    w = 0.5 + confidence
    w = w * F.when(agreeing > 1, 1 + 0.2 * F.least(agreeing - 1, F.lit(5))).otherwise(1.0)
    return clamp(w * F.when(factual, 1.3).otherwise(1.0), 0.1, 10.0)


def shifted(a: Column, b: Column, delta: Column) -> tuple[Column, Column]:
    """A change of credibility: ten observations a unit, on either side, never below 1."""
    up = F.when(delta > 0, a + 10 * delta).otherwise(a)
    down = F.when(delta < 0, b - 10 * delta).otherwise(b)
    return F.greatest(F.lit(1.0), up), F.greatest(F.lit(1.0), down)
