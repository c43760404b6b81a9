"""Maintenance: clustering and summaries, consolidation, recall, erasure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import sm2
from factloom.functions.score import clamp, neutral
from factloom.functions.temporal import hours_between
from factloom.functions.text import hashed_uuid
from factloom.functions.vector import unit
from factloom.operators import search
from factloom.operators.ingest import first_independent


def leader_clusters(entries: DataFrame, least: float = 0.7, smallest: int = 3, largest: int = 50) -> DataFrame:
    """(id, leader): greedy clusters in order of id; an entry joins the first leader within the similarity. Of a cluster that would grow
    beyond `largest`, the entries after that many are clustered again among themselves. Clusters below `smallest` are dropped.

    entries: id bigint, ns, vec."""
    out, rest = None, entries
    pairs = search.pairs_within(entries.select("id", F.col("ns").alias("scope"), "vec"), least, 2.0).select("a", "b")
    while True:
        led = first_independent(rest, pairs)
        nth = F.row_number().over(Window.partitionBy("leader").orderBy("id"))
        led = led.withColumn("nth", nth)
        own = led.where(F.col("nth") <= largest).select("id", "leader")
        out = own if out is None else out.unionByName(own)
        over = led.where(F.col("nth") > largest).select("id")
        if over.isEmpty():
            break
        rest = entries.join(over, "id", "left_semi")
        pairs = pairs.join(over.withColumnRenamed("id", "a"), "a", "left_semi").join(over.withColumnRenamed("id", "b"), "b", "left_semi")
    n = out.groupBy("leader").agg(F.count("*").alias("n")).where(F.col("n") >= smallest)
    return out.join(n.select("leader"), "leader", "left_semi").select("id", "leader")


def summaries(clusters: DataFrame, entries: DataFrame, texts: int = 3, chars: int = 500) -> tuple[DataFrame, DataFrame]:
    """Summary nodes (leader, members, confidence, text, vec) and derived_from edges (src = summary, dst = member) of clusters.

    entries: id, ns, vec, text, confidence. Clusters without any text are left out; the text is that of the first members."""
    m = clusters.join(entries, "id")
    some = m.where("text is not null and text <> ''").withColumn("_n", F.row_number().over(Window.partitionBy("leader").orderBy("id"))).where(F.col("_n") <= texts)
    text = some.groupBy("leader").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "text"))), lambda x: x["text"]), " ").alias("text"))
    dims = m.select("leader", F.posexplode("vec").alias("i", "x")).groupBy("leader", "i").agg(F.avg("x").alias("x"))
    centre = dims.groupBy("leader").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))
    g = m.groupBy("ns", "leader").agg(F.count("*").alias("members"), F.avg("confidence").alias("confidence"))
    nodes = g.join(text, "leader").join(centre, "leader").withColumn("vec", unit(F.col("vec"))).withColumn("text", F.substring("text", 1, chars))
    return nodes, clusters.join(nodes.select("leader"), "leader", "left_semi").select(F.col("leader").alias("src"), F.col("id").alias("dst"), F.lit("derived_from").alias("edge_type"), F.lit(1.0).alias("weight"))


def episodic(valid: DataFrame, t: Column, least_hours: float = 24) -> DataFrame:
    """Episodic nodes of a day or older that aren't consolidated yet (where there is such a column)."""
    old = valid.where((F.coalesce(F.col("mem_type") == "episodic", F.lit(False)) | F.coalesce(F.array_contains("labels", "Episode"), F.lit(False))) & (hours_between(F.col("valid_from"), t) >= least_hours))
    return old.where(~F.coalesce("consolidated", F.lit(False))) if "consolidated" in valid.columns else old


def facts(valid: DataFrame, t: Column, least_hours: float = 24, least_nodes: int = 3, chars: int = 500) -> tuple[DataFrame, DataFrame]:
    """(ns, id, nodes, confidence, text) of the fact of each namespace, and its originals (ns, id, fact, consolidated).

    valid: also content. The text is what the first nodes say, joined, up to `chars` characters; as each adds two or more, so many
    halved are enough. Without any text there is no fact. Unknown confidences count 0.5."""
    old = episodic(valid, t, least_hours)
    said = old.where("content is not null and content <> ''").withColumn("_n", F.row_number().over(Window.partitionBy("ns").orderBy("valid_from", "id"))).where(F.col("_n") <= chars // 2)
    text = said.groupBy("ns").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.substring("content", 1, chars).alias("c")))), lambda x: x["c"]), "; ").alias("text"))
    g = old.groupBy("ns").agg(F.count("*").alias("nodes"), F.round(F.avg(neutral(F.col("confidence"))), 6).alias("confidence")).where(F.col("nodes") >= least_nodes)
    out = g.join(text, "ns").select("ns", hashed_uuid(F.lit("fact"), "ns", t).alias("id"), "nodes", "confidence", F.concat(F.lit("Consolidated: "), F.substring("text", 1, chars)).alias("text"))
    return out, old.select("ns", "id").join(out.select("ns", F.col("id").alias("fact")), "ns").select("ns", "id", "fact", F.lit(True).alias("consolidated"))


def consolidate(valid: DataFrame, t: Column, least_hours: float = 24, least_nodes: int = 3) -> DataFrame:
    """(ns, nodes, confidence, labels, first, last): one semantic fact per namespace from its episodic nodes of a day or older, if there are enough."""
    old = episodic(valid, t, least_hours)
    labels = old.select("ns", F.explode("labels").alias("l")).where("l <> 'Episode'").groupBy("ns").agg(F.sort_array(F.collect_set("l")).alias("labels"))
    g = old.groupBy("ns").agg(F.count("*").alias("nodes"), F.round(F.avg("confidence"), 6).alias("confidence"), F.min("valid_from").alias("first"), F.max("valid_from").alias("last"))
    return g.where(F.col("nodes") >= least_nodes).join(labels, "ns", "left")


def recall_quality(confidence: Column, utility: Column, age_hours: Column) -> Column:
    """Simulated recall, 0 to 5, from confidence, utility and age."""
    s = 0.4 * confidence + 0.3 * F.coalesce(utility, F.lit(0.5)) + 0.3 * F.exp(-0.05 * age_hours)
    q = F.lit(0)
    for cut_, v in ((0.1, 1), (0.3, 2), (0.5, 3), (0.7, 4), (0.9, 5)):
        q = F.when(s >= cut_, v).otherwise(q)
    return q


def recall_cycle(valid: DataFrame, t: Column, most: int | None = None, schedule: DataFrame | None = None) -> DataFrame:
    """(ns, id, quality, interval_days, easiness, utility): a first review of each node; with `most`, of the most urgent ones only.

    schedule (ns, id, easiness, interval_days, repetitions, next_review): reviews before; only nodes that are due at t (next_review by t, or
    none) are reviewed, and the result also has repetitions and next_review, the schedule of the next cycle."""
    age = F.greatest(F.lit(0.0), hours_between(F.col("valid_from"), t))
    q = recall_quality(clamp(F.coalesce("confidence", F.lit(0.0))), F.col("utility"), age)
    start = F.struct(F.lit(2.5).alias("easiness"), F.lit(0).alias("interval_days"), F.lit(0).alias("repetitions"))
    if schedule is not None:
        valid = valid.join(schedule.select("ns", "id", F.struct("easiness", "interval_days", "repetitions").alias("_s"), "next_review"), ["ns", "id"], "left").where(F.col("next_review").isNull() | (F.col("next_review") <= t))
        start = F.coalesce(F.col("_s"), start)
    n = valid.withColumn("quality", q).withColumn("s", sm2.review(start, F.col("quality")))
    gain = F.when(F.col("quality") >= 3, 0.05 * F.col("quality") / 5).otherwise(-0.02 * (3 - F.col("quality")))
    out = n.select("ns", "id", "quality", F.col("s.interval_days").alias("interval_days"), F.round("s.easiness", 6).alias("easiness"), F.round(clamp(F.coalesce("utility", F.lit(0.5)) + gain), 6).alias("utility"), age.alias("age"), *([] if schedule is None else [F.col("s.repetitions").alias("repetitions"), (t + F.make_dt_interval(F.col("s.interval_days"))).alias("next_review")]))
    return (out.orderBy(F.desc("age"), "ns", "id").limit(most) if most else out).drop("age")


def erase(source_ids: list[str], versions: DataFrame, entries: DataFrame, edges: DataFrame, t: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Erasure of sources at t: nodes to retract (ns, id), vector entries to drop, edges to invalidate (all but retraction self-loops)."""
    from factloom.functions.temporal import valid_at
    from factloom.operators.temporal import latest

    mine = latest(versions).where(F.col("source_id").isin(*source_ids)).select("ns", "id")
    gone = latest(versions).join(mine, ["ns", "id"], "left_semi").where(valid_at(t)).select("ns", "id")
    drop = entries.join(mine.select("ns", F.col("id").alias("node_id")), ["ns", "node_id"], "left_semi")
    ends = edges.where(F.col("invalidated_at").isNull() & ~((F.col("edge_type") == "retracted") & (F.col("src") == F.col("dst"))))
    touched = ends.join(mine.select("ns", F.col("id").alias("src")), ["ns", "src"], "left_semi").unionByName(ends.join(mine.select("ns", F.col("id").alias("dst")), ["ns", "dst"], "left_semi")).select("id", "ns").distinct()
    return gone, drop, touched
