"""Small stores as tables: event log, key-value items with expiry, snapshots as NDJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import temporal

# --- event log: id, ns, type, payload, ts, processed, origin


def events_since(log: DataFrame, after: Column, processed: bool = False) -> DataFrame:
    """Events later than `after`; those already processed only if asked for."""
    rows = log.where(F.col("ts") > after)
    return rows if processed else rows.where(~F.coalesce("processed", F.lit(False)))


def mark_processed(log: DataFrame, ids: DataFrame) -> DataFrame:
    return log.join(ids.select("id").distinct().withColumn("_done", F.lit(True)), "id", "left").withColumn("processed", F.coalesce("_done", "processed", F.lit(False))).drop("_done")


# --- key-value items: key, value, set_at, expires_at


def kv_put(items: DataFrame, new: DataFrame) -> DataFrame:
    """Items after new ones replaced those of the same key."""
    return items.join(new.select("key"), "key", "left_anti").unionByName(new)


def kv_expiry(now: Column, ttl_seconds: Column) -> Column:
    """When an item set now expires; a ttl of 0 or less never."""
    return F.when(ttl_seconds > 0, F.timestamp_micros(F.unix_micros(now.cast("timestamp")) + (ttl_seconds * 1_000_000).cast("bigint")).cast("timestamp_ntz"))


def kv_get(items: DataFrame, now: Column) -> DataFrame:
    return items.where(F.col("expires_at").isNull() | (now <= F.col("expires_at")))


# --- snapshots: one JSON object {"type", "data"} a line


def snapshot(versions: DataFrame, edges: DataFrame, sources: DataFrame, t: Column) -> DataFrame:
    """(value): lines for all versions of nodes valid at t, their active out-edges and all sources."""
    from factloom.operators.graph import active

    alive = temporal.valid_nodes(versions, t).select("ns", "id")
    n = versions.join(alive, ["ns", "id"], "left_semi")
    e = active(edges, t).join(alive.select("ns", F.col("id").alias("src")), ["ns", "src"], "left_semi")
    line = lambda df, kind: df.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*df.columns).alias("data"))).alias("value"))
    return line(n, "node").unionByName(line(e, "edge")).unionByName(line(sources, "source"))


def snapshot_of(seeds: DataFrame, versions: DataFrame, edges: DataFrame, sources: DataFrame, t: Column, levels: int = 10) -> DataFrame:
    """A snapshot of what can be reached from the seeds (ns, id) along active edges: all versions of these nodes, the edges among them, and the
    sources that they name."""
    from factloom.operators.graph import active, subgraph

    found, e = subgraph(seeds, active(edges, t), levels)
    n = versions.join(found.select("ns", "id"), ["ns", "id"], "left_semi")
    s = sources.join(n.select("ns", F.col("source_id").alias("external_id")).distinct(), ["ns", "external_id"], "left_semi")
    line = lambda df, kind: df.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*df.columns).alias("data"))).alias("value"))
    return line(n, "node").unionByName(line(e, "edge")).unionByName(line(s, "source"))


def write_snapshot(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def read_snapshot(spark: SparkSession, path: str, schemas: dict, ns: str | None = None) -> dict[str, DataFrame]:
    """DataFrames by type; ns replaces the namespace. A line of unknown type is an error, named with its text."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    kind = F.get_json_object("value", "$.type")
    bad = lines.where(kind.isNull() | ~kind.isin(*schemas)).limit(1).collect()
    if bad:
        raise ValueError(f"unknown type in line {bad[0].value[:80]!r}")
    out = {}
    for name, schema in schemas.items():
        df = lines.where(kind == name).select(F.from_json(F.get_json_object("value", "$.data"), schema).alias("d")).select("d.*")
        out[name] = df.withColumn("ns", F.lit(ns)) if ns and "ns" in df.columns else df
    return out


def snapshot_report(lines: DataFrame, versions: DataFrame) -> DataFrame:
    """One row: lines, nodes, edges, sources of a snapshot and how its latest nodes compare with the stored ones."""
    kind = F.get_json_object("value", "$.type")
    get = lambda f: F.get_json_object("value", f"$.data.{f}")
    counts = lines.agg(F.count("*").alias("lines"), *[F.sum((kind == k).cast("bigint")).alias(f"{k}s") for k in ("node", "edge", "source")])
    n = lines.where(kind == "node").groupBy(get("ns").alias("ns"), get("id").alias("id")).agg(F.max(get("version_no").cast("bigint")).alias("v"))
    mine = versions.groupBy("ns", "id").agg(F.max("version_no").alias("mine"))
    j = n.join(mine, ["ns", "id"], "left")
    is_ = lambda c: F.sum(c.cast("bigint"))
    return counts.join(F.broadcast(j.agg(is_(F.col("mine").isNull()).alias("new"), is_(F.col("v") != F.col("mine")).alias("changed"), is_(F.col("v") == F.col("mine")).alias("unchanged"))))
