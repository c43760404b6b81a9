"""Predicates over validity in time. Intervals are closed; a null end is open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours_between(a: Column, b: Column) -> Column:
    """Hours from a to b, as double."""
    us = lambda x: F.unix_micros(x.cast("timestamp"))
    return (us(b) - us(a)) / 3_600_000_000.0


def valid_at(t: Column, valid_from: str = "valid_from", valid_until: str = "valid_until", closed: bool = True) -> Column:
    """valid_from <= t and (open end or t <= valid_until); closed=False leaves the end itself out."""
    end = F.col(valid_until)
    return (F.col(valid_from) <= t) & (end.isNull() | ((t <= end) if closed else (t < end)))


def edge_active(t: Column, alias: str = "") -> Column:
    """Valid at t and not yet invalidated at t."""
    p = f"{alias}." if alias else ""
    gone = F.col(f"{p}invalidated_at")
    return valid_at(t, f"{p}valid_from", f"{p}valid_until") & (gone.isNull() | (t < gone))


def overlap(a_from: Column, a_until: Column, b_from: Column, b_until: Column) -> Column:
    """Whether two closed intervals meet."""
    return (b_until.isNull() | (a_from <= b_until)) & (a_until.isNull() | (b_from <= a_until))


def expiry_class(valid_until: Column, now: Column) -> Column:
    """expired, imminent (under 24 hours), approaching (under 7 days) or null."""
    left = hours_between(now, valid_until)
    return F.when(left < 0, "expired").when(left < 24, "imminent").when(left < 168, "approaching")
