"""Several writers: last writer wins, additive evidence, what a peer lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_writer(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that is last by the columns of `order`, all descending (version, time, origin)."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_evidence(rows: DataFrame, key: list[str], update: str | None = None) -> DataFrame:
    """(key, alpha, beta, peers): Beta parameters of several peers added without their common prior (1, 1); with `update`, rows of one
    update id count once, so that pulling again does not count twice."""
    if update:
        rows = rows.dropDuplicates([*key, update])
    g = rows.groupBy(*key).agg(F.sum(F.col("alpha") - 1).alias("a"), F.sum(F.col("beta") - 1).alias("b"), F.count("*").alias("peers"))
    return g.select(*key, F.round(F.greatest(F.lit(1.0), F.col("a") + 1), 6).alias("alpha"), F.round(F.greatest(F.lit(1.0), F.col("b") + 1), 6).alias("beta"), "peers")


def missing(here: DataFrame, there: DataFrame, key: str, since: Column, until: Column, ts: str = "ts") -> DataFrame:
    """Events of a time window that `here` has and `there` lacks."""
    return here.where((F.col(ts) > since) & (F.col(ts) <= until)).join(there.select(key), key, "left_anti")


def replicate(here: DataFrame, there: DataFrame, watermark: Column, own: str, key: list[str], order: list[str], overlap: str = "1 minute", ns: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One pull: here after the peer's rows later than the watermark less an overlap, without those of the own origin, were merged; and the
    new watermark (one row). Rows: key, order, tx_time, origin; the last by `order` (all descending) wins, so that rows pulled again do no
    harm. ns: only this namespace."""
    new = there.where((F.col("tx_time") > watermark - F.expr(f"interval {overlap}")) & ~F.coalesce(F.col("origin") == own, F.lit(False)))
    new = new.where(F.col("ns") == ns) if ns is not None else new
    return last_writer(here.unionByName(new.select(*here.columns)), key, order), new.agg(F.coalesce(F.greatest(F.max("tx_time"), F.max(watermark)), watermark).alias("watermark"))


def since(log: DataFrame, watermark: Column, overlap: str = "1 minute", own: str | None = None, origin: str = "origin", ts: str = "ts") -> DataFrame:
    """Events after the watermark less an overlap, without those of the own origin, in time order."""
    rows = log.where(F.col(ts) > watermark - F.expr(f"interval {overlap}"))
    return (rows.where(F.col(origin) != own) if own else rows).orderBy(ts)
