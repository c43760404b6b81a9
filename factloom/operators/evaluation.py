"""Quality of rankings and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ir_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query with relevant items: ndcg, recall and hit at k, reciprocal rank, rank of the first hit (null if none).

    ranked: query, id, rank; relevant: query, id."""
    hits = ranked.join(relevant.select("query", "id").distinct(), ["query", "id"])
    gain = 1 / F.log2(F.col("rank") + 1.0)
    g = hits.groupBy("query").agg(F.sum(F.when(F.col("rank") <= k, gain)).alias("dcg"), F.sum((F.col("rank") <= k).cast("int")).alias("found"), F.min("rank").alias("first"))
    n = relevant.select("query", "id").distinct().groupBy("query").agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    j = n.join(g, "query", "left")
    r = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(name)
    return j.select("query", r(F.col("dcg") / ideal, "ndcg"), r(F.col("found") / F.col("n"), "recall"), r(1 / F.col("first"), "rr"), F.coalesce(F.col("found") > 0, F.lit(False)).alias("hit"), F.col("first").alias("first_rank"))


def ranking_eval(ranked: DataFrame, golden: DataFrame) -> DataFrame:
    """One row: queries, mean reciprocal rank of the expected item, and how many queries pass, having it among the first `cutoff`.

    ranked: query, id, rank; golden: query, id, cutoff, one expected item a query."""
    g = golden.join(ranked.select("query", "id", "rank"), ["query", "id"], "left")
    return g.agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.sum(F.coalesce((F.col("rank") <= F.col("cutoff")).cast("bigint"), F.lit(0))).alias("passed"))


def stats(writes: DataFrame, requests: DataFrame, latencies: DataFrame) -> DataFrame:
    """One row: writes, admitted, rejected, retrievals, and of their latencies (latency) the mean and nearest-rank p50 and p95."""
    from factloom.operators.epistemics import quantiles

    w = writes.groupBy("write_id").agg(F.max("admitted").alias("ok")).agg(F.count("*").alias("ingest_total"), F.coalesce(F.sum(F.col("ok").cast("bigint")), F.lit(0)).alias("ingest_admitted"))
    r = requests.select("retrieve_id").distinct().agg(F.count("*").alias("retrieval_total"))
    one = quantiles(latencies.select("latency").withColumn("_all", F.lit(1)), "latency", ["_all"]).select("mean", "p50", "p95")
    out = w.crossJoin(r).join(one, F.lit(True), "left")  # three single rows
    return out.select("ingest_total", "ingest_admitted", (F.col("ingest_total") - F.col("ingest_admitted")).alias("ingest_rejected"), "retrieval_total", "mean", "p50", "p95")


def ranking_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query, id, before, after, moved): full join of two rankings; moved is positive upwards, null where an item appears or disappears."""
    b = before.select("query", "id", F.col("rank").alias("before"))
    a = after.select("query", "id", F.col("rank").alias("after"))
    return b.join(a, ["query", "id"], "full").withColumn("moved", F.col("before") - F.col("after")).where("not (before <=> after)")


def sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, precision, recall, f1) of accepting what scores a threshold or more. scored: score, good (boolean)."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    c = scored.groupBy(F.round("score", 6).alias("score")).agg(F.count("*").alias("n"), F.sum(F.col("good").cast("bigint")).alias("g"))
    s = c.select("*", t)
    yes = F.col("score") >= F.col("threshold")
    s = s.groupBy("threshold").agg(F.sum(F.when(yes, F.col("n")).otherwise(0)).alias("taken"), F.sum(F.when(yes, F.col("g")).otherwise(0)).alias("right"), F.sum("g").alias("good"))
    p = F.when(F.col("taken") > 0, F.col("right") / F.col("taken")).otherwise(0.0)
    r = F.when(F.col("good") > 0, F.col("right") / F.col("good")).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return s.select("threshold", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))
