"""Spaced repetition: one review, its priority, and the fold over many reviews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.temporal import hours_between

#: State before the first review.
START = {"easiness": 2.5, "interval_days": 0, "repetitions": 0}


def _easiness(e: Column, q: Column) -> Column:
    miss = 5 - q
    return F.greatest(F.lit(1.3), e + 0.1 - miss * (0.08 + miss * 0.02))


def review(state: Column, quality: Column) -> Column:
    """State struct (easiness, interval_days, repetitions) after a review of quality 0 to 5."""
    q = F.greatest(F.lit(0), F.least(F.lit(5), quality)).cast("int")
    e = _easiness(state["easiness"], q.cast("double"))
    n = F.when(q < 3, 0).otherwise(state["repetitions"] + 1).cast("int")
    grown = F.floor(state["interval_days"] * e + 0.5)
    days = F.when(n <= 1, 1).when(n == 2, 6).otherwise(grown).cast("int")
    return F.struct(e.alias("easiness"), days.alias("interval_days"), n.alias("repetitions"))


def fold(qualities: Column) -> Column:
    """State after an array of reviews, in order."""
    start = F.struct(F.lit(2.5).alias("easiness"), F.lit(0).alias("interval_days"), F.lit(0).alias("repetitions"))
    return F.aggregate(qualities, start, review)


def priority(next_review: Column, easiness: Column, repetitions: Column, now: Column) -> Column:
    late = F.greatest(F.lit(0.0), hours_between(next_review, now) / 24)
    p = 0.6 * F.least(F.lit(1.0), (late + 1) / 30) + 0.4 * (2.5 - easiness) / 1.2
    p = 0.7 * p + 0.3 * (1 - F.least(F.lit(1.0), repetitions / 10))
    return F.when(now < next_review, 0.0).otherwise(F.least(F.lit(1.0), p))
