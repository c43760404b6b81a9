"""Queries that run streams over the event table until it is drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.epistemic import _SRC
from factloom.streaming import jobs


def _bursts(spark: SparkSession, d: str) -> DataFrame:
    """Hours with more than one event of a user, of windows that the watermark has closed."""
    return jobs.run(jobs.rate_bursts(jobs.events(spark, f"{d}/events.parquet"), "user_id", 3600, 1))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return jobs.run(jobs.sessions(jobs.events(spark, f"{d}/events.parquet"), "user_id", "2 hours"))


def _once(spark: SparkSession, d: str) -> DataFrame:
    return jobs.run(jobs.once(jobs.events(spark, f"{d}/events.parquet"), "event_id").select("event_id", "event_type"))


def _trust(spark: SparkSession, d: str) -> DataFrame:
    e = jobs.events(spark, f"{d}/events.parquet")
    kind = F.when(F.col("event_type") == "purchase", "validated").when(F.col("event_type") == "error", "refuted").otherwise("other")
    s = e.select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"), kind.alias("outcome")).where("outcome <> 'other'")
    return jobs.run(jobs.live_trust(s), "update", ["source"], ["seen"])


QUERIES = {"stream_rate_burst": _bursts, "stream_sessions": _sessions, "stream_event_since": _once, "stream_live_trust": _trust}
_CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"
SQL = {
    "stream_rate_burst": f"SELECT user_id, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1 AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_CLOSED}",
    "stream_sessions": f"""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CAST(ts >= before + INTERVAL 2 HOUR OR before IS NULL AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, s HAVING max(ts) + INTERVAL 2 HOUR <= {_CLOSED}""",
    "stream_event_since": "SELECT event_id, event_type FROM events",
    "stream_live_trust": f"WITH fb AS ({_SRC}) SELECT source, 1.0 + count(*) FILTER (WHERE outcome = 'validated') AS alpha, 1.0 + count(*) FILTER (WHERE outcome = 'refuted') AS beta, count(*) AS seen FROM fb WHERE outcome IN ('validated', 'refuted') GROUP BY 1",
}
