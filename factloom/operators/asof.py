"""Attributes as known at event time (problem 1) and references without a target (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.keys import scoped_key, trimmed, uuid_key
from factloom.operators import timeline as tl
from factloom.session import micros


def version_spans(versions: DataFrame, entity: str = "id", scope: str = "ns", number: str = "version_no") -> DataFrame:
    """(k, begin, until, number): from when to when a version is both known and valid, in microseconds.

    A null valid_from counts as tx_time, a null valid_until is open; versions with null tx_time, scope, entity
    or number, or an end before the start, never hold and give no row. Repeated rows do no harm."""
    known = micros(F.col("tx_time"))
    begin = F.greatest(known, F.coalesce(micros(F.col("valid_from")), known))
    until = F.coalesce(micros(F.col("valid_until")), F.lit(tl.FOREVER))
    return versions.select(
        scoped_key(scope, uuid_key(entity)).alias("k"), F.when(known.isNotNull(), begin).alias("begin"), until.alias("until"), F.col(number).cast("bigint").alias("number"),
    ).where("k is not null and begin is not null and number is not null and until >= begin")


def _changes(spans: DataFrame) -> DataFrame:
    """The change rows of spans: one where a span begins (edge 0), one right after its end (edge 1), if it ends."""
    at = lambda ts, edge: F.struct(ts.cast("bigint").alias("ts"), F.lit(edge).alias("edge"))
    ends = F.col("until") < tl.FOREVER
    both = F.explode(F.when(ends, F.array(at(F.col("begin"), 0), at(F.col("until") + 1, 1))).otherwise(F.array(at(F.col("begin"), 0))))
    rows = spans.select("k", "begin", "until", "number", both.alias("x"))
    return rows.select("k", "x.ts", F.lit(tl.CHANGE).alias("kind"), F.lit("").alias("tie"), F.when(~ends, F.col("number")).alias("value"), "number", "begin", "until", "x.edge")


def versions_at_events(events: DataFrame, versions: DataFrame, attributes: list[str] | None = None) -> DataFrame:
    """Each event with the number of the entity's version that held and was already known at its time.

    events: event (string), ns, entity, at (timestamp). versions: ns, id, version_no, valid_from, valid_until,
    tx_time and more. Result: event, ns, entity (one UUID spelling), version_no and the `attributes`, which are
    equi-joined on (ns, entity, version_no). Of several versions that hold, the largest number counts. Events
    without time, scope, entity or such a version give no row; repeated events give one row; empty tables
    give an empty result.

    An entity's time line is cut wherever a version begins to hold or has ended. Each cut has a number, the
    cumulative count of changes, each stretch up to the next one at most one winner (timeline.segments). An event
    is numbered by the changes before it, over narrow timestamp rows only, and equi-joined with the stretches on (entity,
    number). An entity with very many events makes a large partition of that join, which streams and is split by AQE."""
    asked = events.select(
        scoped_key("ns", uuid_key("entity")).alias("k"), micros(F.col("at")).alias("ts"), F.lit(tl.EVENT).alias("kind"), F.col("event").cast("string").alias("tie"),
    ).where("k is not null and ts is not null and tie is not null")
    line = tl.Line(_changes(version_spans(versions)).unionByName(asked, allowMissingColumns=True))
    changes = line.counted(lambda kind, ts, c, top, has: kind == tl.CHANGE, ["k", "number", "begin", "until", "edge"])
    numbered = line.counted(lambda kind, ts, c, top, has: (kind == tl.EVENT) & (c > 0), ["k", "tie"]).select("k", "tie", "c")
    found = numbered.join(tl.segments(changes), ["k", "c"]).select("tie", "k", "number").distinct()
    found = found.select(F.col("tie").alias("event"), F.split_part("k", F.lit("\x1f"), F.lit(1)).alias("ns"), F.split_part("k", F.lit("\x1f"), F.lit(2)).alias("entity"), F.col("number").alias("version_no"))
    if not attributes:
        return found
    # Repeated rows of a version differ in other fields: one of them, whole, chosen by its values.
    wide = versions.select("ns", uuid_key("id").alias("entity"), "version_no", F.struct("tx_time", *[c for c in attributes if c != "tx_time"]).alias("w"))
    wide = wide.groupBy("ns", "entity", "version_no").agg(F.max("w").alias("w"))
    return found.join(wide, ["ns", "entity", "version_no"]).select("event", "ns", "entity", "version_no", *[F.col("w")[c].alias(c) for c in attributes])


def orphan_references(children: DataFrame, parents: DataFrame) -> DataFrame:
    """References whose target was not there at the time of the reference.

    children: target (table name), scope, ref, at (timestamp), child (string), endpoint. parents: target, scope,
    key, begin and until (microseconds; null until is open). Both become tagged long rows under one key
    (target, scope, key); in a group, a child is missing if of the parents begun by its time none, or none with an end
    as late as it, came before: the largest end so far tells (timeline.Line). Null or blank references are none. A
    null scope or time matches nothing, so the reference is missing. Values that aren't UUIDs are
    references too. Result, distinct: child, endpoint, target, at_us (null for a null time)."""
    sep = F.lit("\x1f")
    up = parents.select(
        F.concat("target", sep, F.col("scope"), sep, uuid_key("key")).alias("k"), F.col("begin").alias("ts"), F.lit(tl.CHANGE).alias("kind"), F.lit("").alias("tie"),
        F.coalesce("until", F.lit(tl.FOREVER)).alias("value"),
    ).where("k is not null and ts is not null and value >= ts")
    down = children.where(F.length(trimmed("ref")) > 0).select(
        F.concat("target", sep, F.coalesce("scope", F.lit("\x00")), sep, uuid_key("ref")).alias("k"), F.coalesce(micros(F.col("at")), F.lit(tl.BEFORE_ALL)).alias("ts"), F.lit(tl.EVENT).alias("kind"),
        F.concat_ws("\x1f", "endpoint", F.coalesce(micros(F.col("at")).cast("string"), F.lit("")), "child").alias("tie"), F.lit(None).cast("bigint").alias("value"),
    )
    part = lambda c, i: F.split_part(F.col(c), sep, F.lit(i))
    missing = tl.Line(up.unionByName(down)).counted(lambda kind, ts, c, top, has: (kind == tl.EVENT) & ~(has & (top >= ts)), ["k", "tie"])
    return (
        missing
        .select(part("tie", 3).alias("child"), part("tie", 1).alias("endpoint"), part("k", 1).alias("target"), F.expr("try_cast(split_part(tie, '\x1f', 2) as bigint)").alias("at_us"))
        .distinct()
    )


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Missing references per target table and month of the reference (null month: no time)."""
    month = F.date_format(F.timestamp_micros("at_us"), "yyyy-MM")
    return orphans.groupBy("target", month.alias("month")).agg(F.count("*").alias("orphans"), F.countDistinct("child").alias("children"))


def edge_references(edges: DataFrame) -> DataFrame:
    """Both ends of edges as children rows for orphan_references."""
    one = lambda end, target, scope: F.struct(F.lit(end).alias("endpoint"), target.alias("target"), scope.alias("scope"), F.col(end).alias("ref"))
    endorsed = F.coalesce(F.col("edge_type") == "endorsed_by", F.lit(False))
    ends = F.array(
        one("src", F.lit("nodes"), F.col("ns")),
        one("dst", F.when(endorsed, "sources").otherwise("nodes"), F.when(endorsed, "*").otherwise(F.col("ns"))),
    )
    return edges.select(F.col("id").alias("child"), F.col("tx_time").alias("at"), F.explode(ends).alias("x")).select("child", "at", "x.*")


def edge_targets(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Nodes (in their namespace) and sources (in any) as parents rows for orphan_references."""
    known = micros(F.col("tx_time"))
    n = nodes.select(
        F.lit("nodes").alias("target"), F.col("ns").alias("scope"), F.col("id").alias("key"),
        F.when(known.isNotNull(), F.greatest(known, F.coalesce(micros(F.col("valid_from")), known))).alias("begin"), micros(F.col("valid_until")).alias("until"),
    )
    s = sources.select(F.lit("sources").alias("target"), F.lit("*").alias("scope"), F.col("id").alias("key"), micros(F.col("created_at")).alias("begin"), F.lit(None).cast("bigint").alias("until"))
    return n.unionByName(s)
