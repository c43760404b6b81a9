"""Versions of facts: numbering, latest, as of, history, difference, retraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.temporal import expiry_class, valid_at

KEY = ["ns", "id"]


def _newest(df: DataFrame) -> DataFrame:
    """The row of the largest version_no of each key."""
    n = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("version_no")))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def number_versions(rows: DataFrame, order: str = "tx_time", tie: str = "seq") -> DataFrame:
    """upsert_node: appended rows get version_no 1, 2, ... by (order, tie); valid_from defaults to tx_time."""
    w = Window.partitionBy(*KEY).orderBy(order, tie)
    return rows.withColumn("version_no", F.row_number().over(w).cast("bigint")).withColumn("valid_from", F.coalesce("valid_from", "tx_time"))


def upsert(versions: DataFrame, rows: DataFrame, tie: str = "seq") -> DataFrame:
    """versions and, after the last of each key, the new rows."""
    last = versions.groupBy(*KEY).agg(F.max("version_no").alias("_last"))
    new = number_versions(rows, tie=tie).join(last, KEY, "left").withColumn("version_no", F.col("version_no") + F.coalesce("_last", F.lit(0)))
    return versions.unionByName(new.select(*versions.columns))


def latest(versions: DataFrame) -> DataFrame:
    return _newest(versions)


def history(versions: DataFrame, ns: str | None = None, node: str | None = None) -> DataFrame:
    """All versions of a node (or of all), oldest first within the node."""
    if ns is not None:
        versions = versions.where((F.col("ns") == ns) & (F.col("id") == node))
    return versions.orderBy(*KEY, "version_no")


def as_of(versions: DataFrame, t: Column) -> DataFrame:
    """Newest version valid at t and known by t."""
    return _newest(versions.where(valid_at(t) & (F.col("tx_time") <= t)))


def valid_nodes(versions: DataFrame, t: Column, labels: list[str] | None = None) -> DataFrame:
    """Newest version valid at t, whenever it became known; dropped if that version lacks one of the labels."""
    n = _newest(versions.where(valid_at(t)))
    return n.where(F.size(F.array_except(F.array(*map(F.lit, labels)), F.coalesce("labels", F.array().cast("array<string>")))) == 0) if labels else n


def by_fingerprint(versions: DataFrame, fingerprint: Column | str, t: Column) -> DataFrame:
    """Latest versions that carry the fingerprint and are valid at t."""
    return latest(versions).where((F.col("fingerprint") == fingerprint) & valid_at(t))


def touched(versions: DataFrame, keys: DataFrame, at: Column) -> DataFrame:
    """touch_node: new versions of the keys' latest ones that differ only in tx_time."""
    return latest(versions).join(keys.select(*KEY).distinct(), KEY, "left_semi").withColumns({"version_no": F.col("version_no") + 1, "tx_time": at})


def diff(versions: DataFrame, t1: Column, t2: Column) -> DataFrame:
    """Versions known in (t1, t2] and their change: removed if they end by t2, else added (first version) or modified."""
    change = F.when(F.col("valid_until") <= t2, "removed").when(F.col("version_no") == 1, "added").otherwise("modified")
    return versions.where((F.col("tx_time") > t1) & (F.col("tx_time") <= t2)).withColumn("change", change)


def recent(versions: DataFrame, t: Column, n: int = 5) -> DataFrame:
    """The n valid nodes known last."""
    return valid_nodes(versions, t).orderBy(F.coalesce("tx_time", "valid_from").desc(), *KEY).limit(n)


def retracted(versions: DataFrame, keys: DataFrame, at: Column) -> DataFrame:
    """Latest versions of the keys (valid at `at`) with their end set."""
    return latest(versions).join(keys.select(*KEY).distinct(), KEY, "left_semi").where(valid_at(at)).withColumn("valid_until", at)


def trajectory(versions: DataFrame) -> DataFrame:
    """Confidence over versions, with the change since the version before."""
    before = F.lag("confidence").over(Window.partitionBy(*KEY).orderBy("version_no"))
    return versions.select(*KEY, "version_no", "tx_time", "confidence", (F.col("confidence") - before).alias("change"))


def expiry_alerts(versions: DataFrame, t: Column) -> DataFrame:
    """Valid nodes that end within a week."""
    kind = expiry_class(F.col("valid_until"), t)
    return valid_nodes(versions, t).withColumn("alert", kind).where("alert is not null")
