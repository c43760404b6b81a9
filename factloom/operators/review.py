"""Trust and retry analytics over feedback and receipts (data processing only; workflow states are left to callers)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Status codes worth another try.
RETRYABLE = [408, 425, 429, 500, 502, 503, 504]


def backoff_seconds(attempts: Column) -> Column:
    """A minute, doubled with each attempt, an hour at most."""
    return F.least(F.lit(3600.0), 60 * F.pow(F.lit(2.0), F.least(attempts, F.lit(20)) - 1))


def status_family(code: Column) -> Column:
    return F.when(code > 0, F.concat(F.floor(code / 100).cast("string"), F.lit("xx"))).otherwise("network_error")


def retry_candidates(receipts: DataFrame) -> DataFrame:
    """(key, attempts, last_ts, status) of keys whose receipts since their last success are failures. receipts: key, ts, event, ok, status."""
    last = receipts.groupBy("key").agg(F.max(F.when(F.col("ok"), F.struct("ts", "event"))).alias("good"))
    r = receipts.join(last, "key").where(~F.col("ok") & (F.col("good").isNull() | (F.struct("ts", "event") > F.col("good"))))
    return r.groupBy("key").agg(F.count("*").alias("attempts"), F.max("ts").alias("last_ts"), F.max_by("status", F.struct("ts", "event")).alias("status"))


def retry_recommendations(candidates: DataFrame, now: Column) -> DataFrame:
    """Candidates with delay, due time and whether they are ready."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    due = us(F.col("last_ts")) + (backoff_seconds(F.col("attempts")) * 1_000_000).cast("bigint")
    retryable = F.col("status").isin(*RETRYABLE) | (F.col("status") == 0)
    return candidates.withColumns({"delay": backoff_seconds(F.col("attempts")), "family": status_family(F.col("status")), "ready": (us(now) >= due) & retryable})


def retry_fatigue(recommended: DataFrame, target: str = "family") -> DataFrame:
    """Per target: candidates, ready and waiting ones, attempts, and when and with which status and key the latest failure was."""
    g = recommended.groupBy(target).agg(F.count("*").alias("candidates"), F.sum(F.col("ready").cast("bigint")).alias("ready"), F.sum("attempts").alias("attempts"), F.max(F.struct("last_ts", "key", "status")).alias("x"))
    return g.select(target, "candidates", "ready", (F.col("candidates") - F.col("ready")).alias("waiting"), "attempts", "x.last_ts", F.col("x.key").alias("last_key"), F.col("x.status").alias("last_status"))


def trust_anomalies(history: DataFrame, refuted: DataFrame, drop: float, low: float, many: int) -> DataFrame:
    """(source, first, last, refutations, priority, kind): sources whose credibility fell, is low, or that were refuted often.

    history: source, ts, event, credibility; refuted: source, n."""
    order = F.struct("ts", "event")
    g = history.groupBy("source").agg(F.min_by("credibility", order).alias("first"), F.max_by("credibility", order).alias("last")).join(refuted, "source", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    d = F.col("first") - F.col("last")
    p1, p2, p3 = F.when(d >= drop, 0.65 + d), F.when(F.col("last") <= low, 0.75 + low - F.col("last")), F.when(F.col("n") >= many, 0.8 + 0.05 * F.col("n"))
    kind = F.when(p1.isNotNull(), "drop").when(p2.isNotNull(), "low_trust").when(p3.isNotNull(), "repeated")
    out = g.withColumn("priority", F.round(F.greatest(p1, p2, p3), 6)).withColumn("kind", kind).where("kind is not null")
    return out.select("source", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), F.col("n").alias("refutations"), "priority", "kind")
