"""Writing: the whole pipeline over a batch, single stores of edges, vectors, sources and truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import fingerprint, hashed_uuid
from factloom.functions.vector import usable
from factloom.operators import ingest, search
from factloom.operators.temporal import latest, touched, upsert
from factloom.functions.temporal import valid_at
from factloom.session import cut


def one_per_write(writes: DataFrame) -> DataFrame:
    """Of repeated deliveries of a write one, whole: the largest by all fields but the vector in turn."""
    flat = {"array<string>": lambda c: F.array_join(c, "\x1f")}
    order = [flat.get(f.dataType.simpleString(), F.col)(f.name).desc_nulls_last() for f in writes.schema if f.name not in ("write_id", "vector")]
    return writes.withColumn("_n", F.row_number().over(Window.partitionBy("write_id").orderBy(*order))).where("_n = 1").drop("_n")


def write_batch(writes: DataFrame, versions: DataFrame, entries: DataFrame, credibility: DataFrame, t: Column, threshold: float = 0.25, dim: int = 64, near: search.Search = search.topk) -> dict[str, DataFrame]:
    """Deduplicate, judge, store, index and check for conflicts a batch of writes against what is stored before it.

    writes: write_id, ns, content, source_id, labels, vector, confidence, valid_from, dedup, received_at. versions: of nodes. entries:
    write_id, ns, node_id, vec, content. credibility: ns, source_id, credibility; unknown sources have 0.5. Result:

    - results (write_id, ns, node_id, admitted, reason, confidence, conflicts): `deduplicated` onto a valid node of the same
      fingerprint, `repeats` an earlier write of the batch whose node it shares, or the gate's reason. conflicts: nodes contradicted.
    - nodes, entries, edges: new rows of the admitted; touched: new versions of the nodes that were written again.

    A confidence that is null or 0 is the source's credibility, by which the gate multiplies it. Writes without a usable vector resemble
    nothing and aren't indexed. Null or blank contents have no fingerprint. near: the search for neighbours, exact or in cells."""
    w = one_per_write(writes).withColumn("fp", F.nullif(fingerprint("content"), F.lit("")))
    w = w.join(credibility.select("ns", "source_id", "credibility"), ["ns", "source_id"], "left").withColumn("credibility", F.coalesce("credibility", F.lit(0.5)))
    w = w.withColumns({"new_id": hashed_uuid("ns", "write_id"), "own": F.when(F.coalesce(F.col("confidence"), F.lit(0.0)) == 0, F.col("credibility")).otherwise(F.col("confidence"))})
    valid = latest(versions).where(valid_at(t))
    d = ingest.dedup(w.select("write_id", "ns", "content", "dedup", "received_at"), valid).select("write_id", F.col("node_id").alias("old_id"), F.col("reason").alias("same"), F.col("first").alias("first_write"))
    w = cut(w.join(d, "write_id", "left"))
    fresh = w.where("same is null")
    alive = entries.join(valid.select("ns", F.col("id").alias("node_id"), "labels", "valid_from", "valid_until"), ["ns", "node_id"])
    asked = fresh.where(usable(F.col("vector"), dim)).select(F.col("write_id").alias("id"), "ns", F.col("vector").cast("array<double>").alias("vec"), "labels", F.col("content").alias("text"), F.coalesce("valid_from", "received_at").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_until"))
    stored = alive.select(F.col("write_id").alias("id"), "ns", "vec", "labels", F.col("content").alias("text"), "valid_from", "valid_until", "node_id")
    side = lambda df: df.select("id", F.col("ns").alias("scope"), "vec")
    nearest = cut(near(side(asked), side(stored), 5))
    most = F.coalesce("most", F.lit(0.0))
    ok, reason = ingest.admission(F.col("credibility"), most, threshold)
    judged = fresh.join(nearest.where("rank = 1").select(F.col("query").alias("write_id"), F.col("similarity").alias("most")), "write_id", "left").withColumns({"admitted": ok, "reason": reason})
    clash = ingest.conflict_candidates(asked, stored, near=lambda *_: nearest)
    clash = clash.join(stored.select(F.col("id").alias("existing"), "node_id"), "existing").join(judged.where("admitted").select(F.col("write_id").alias("candidate"), "ns", "new_id"), "candidate")
    against = clash.groupBy("candidate").agg(F.sort_array(F.collect_set("node_id")).alias("conflicts"))
    none = F.array().cast("array<string>")
    judged = cut(judged.join(against.withColumnRenamed("candidate", "write_id"), "write_id", "left").withColumn("conflicts", F.when(F.col("admitted"), F.coalesce("conflicts", none)).otherwise(none)))
    plain = judged.select("write_id", "ns", F.when(F.col("admitted"), F.col("new_id")).alias("node_id"), "admitted", "reason", F.when(F.col("admitted"), F.round(F.col("own") * F.col("credibility"), 6)).alias("confidence"), "conflicts")
    # what is known already is admitted as the node that it repeats; a repeat of a rejected write shares its fate
    again = w.where("same = 'deduplicated'").select("write_id", "ns", F.col("old_id").alias("node_id"), F.lit(True).alias("admitted"), F.col("same").alias("reason"), F.lit(None).cast("double").alias("confidence"), none.alias("conflicts"))
    lead = plain.select(F.col("write_id").alias("first_write"), F.col("node_id").alias("led"), F.col("admitted").alias("lead"))
    repeat = w.where("same = 'repeats'").join(lead, "first_write", "left").select("write_id", "ns", F.col("led").alias("node_id"), F.coalesce("lead", F.lit(False)).alias("admitted"), F.col("same").alias("reason"), F.lit(None).cast("double").alias("confidence"), none.alias("conflicts"))
    kept = judged.where("admitted")
    has = {f.name for f in versions.schema}
    node = {"id": F.col("new_id"), "confidence": F.round(F.col("own") * F.col("credibility"), 6), "fingerprint": F.when(F.coalesce("dedup", F.lit(False)), F.col("fp")), "valid_from": F.coalesce("valid_from", "received_at"), "tx_time": F.col("received_at"), "version_no": F.lit(1).cast("bigint")}
    cols = [node[c].alias(c) if c in node else F.col(c) if c in kept.columns else F.lit(None).cast(versions.schema[c].dataType).alias(c) for c in versions.columns]
    edges = clash.select(hashed_uuid("ns", "new_id", "node_id").alias("id"), "ns", F.col("new_id").alias("src"), F.col("node_id").alias("dst"), F.lit("contradicts").alias("edge_type"), "weight").dropDuplicates(["id"])
    return {
        "results": reduce(DataFrame.unionByName, [plain, again, repeat]), "nodes": kept.select(*cols), "edges": edges,
        "entries": kept.where(usable(F.col("vector"), dim)).select("write_id", "ns", F.col("new_id").alias("node_id"), F.col("vector").cast("array<double>").alias("vec"), "content", *(["received_at"] if "received_at" in entries.columns else [])),
        "touched": touched(versions, again.select("ns", F.col("node_id").alias("id")).distinct(), t) if {"ns", "id", "version_no"} <= has else again.select("ns", "node_id"),
    }


# --- edges


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by id: a known id keeps its ends and type, and takes weight and invalidated_at of the new row (of several, the last by tx_time)."""
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.col("tx_time").desc_nulls_last(), F.col("weight").desc_nulls_last()))).where("_n = 1").drop("_n")
    known = edges.join(last.select("id", F.col("weight").alias("_w"), F.col("invalidated_at").alias("_i"), F.lit(True).alias("_new")), "id", "left")
    held = known.withColumns({"weight": F.when(F.col("_new"), F.col("_w")).otherwise(F.col("weight")), "invalidated_at": F.when(F.col("_new"), F.col("_i")).otherwise(F.col("invalidated_at"))})
    return held.select(*edges.columns).unionByName(last.join(edges.select("id"), "id", "left_anti").select(*edges.columns))


def invalidate_edges(edges: DataFrame, ids: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Edges with invalidated_at set for the ids, and the ids of which there is no edge."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    out = edges.join(hit, "id", "left").withColumn("invalidated_at", F.when(F.col("_hit"), at).otherwise(F.col("invalidated_at"))).drop("_hit")
    return out.select(*edges.columns), ids.select("id").distinct().join(edges.select("id"), "id", "left_anti")


# --- vector entries


def index_entries(entries: DataFrame, new: DataFrame, key: str = "write_id") -> DataFrame:
    """Entries after new ones replaced those of the same key."""
    return entries.join(new.select(key), key, "left_anti").unionByName(new.select(*entries.columns))


def delete_entries(entries: DataFrame, ids: DataFrame, key: str = "write_id") -> DataFrame:
    return entries.join(ids.select(key).distinct(), key, "left_anti")


def self_search_misses(nodes: DataFrame, entries: DataFrame, k: int = 10, near: search.Search = search.topk) -> DataFrame:
    """(ns, id, why): nodes without an entry (`missing`), and those that a search for their own vector doesn't find (`unfound`).

    Of a node with several entries its newest (largest write_id) is searched for. An exact search misses a node only behind k entries that
    are as near, such as copies."""
    have = entries.where("node_id is not null")
    missing = nodes.select("ns", "id").join(have.select("ns", F.col("node_id").alias("id")), ["ns", "id"], "left_anti").withColumn("why", F.lit("missing"))
    own = have.join(nodes.select("ns", F.col("id").alias("node_id")), ["ns", "node_id"], "left_semi").groupBy("ns", "node_id").agg(F.max(F.struct("write_id", "vec")).alias("x"))
    asked = own.select(F.col("x.write_id").alias("id"), F.col("ns").alias("scope"), "x.vec")
    got = near(asked, have.select(F.col("write_id").alias("id"), F.col("ns").alias("scope"), "vec"), k).join(have.select(F.col("write_id").alias("row"), F.col("node_id").alias("found")), "row")
    seen = got.select(F.col("query").alias("write_id"), "found").distinct()
    lost = own.select("ns", F.col("node_id").alias("id"), F.col("x.write_id").alias("write_id")).join(seen.withColumnRenamed("found", "id"), ["write_id", "id"], "left_anti")
    return missing.unionByName(lost.select("ns", "id", F.lit("unfound").alias("why")))


# --- sources


def upsert_sources(sources: DataFrame, new: DataFrame) -> DataFrame:
    """Sources by (ns, external_id): new rows replace those of the same key."""
    key = ["ns", "external_id"]
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("updated_at").desc_nulls_last(), F.col("id").desc_nulls_last()))).where("_n = 1").drop("_n")
    return sources.join(last.select(*key), key, "left_anti").unionByName(last.select(*sources.columns))


def label_source(sources: DataFrame, ns: str, external_id: str, labels: list[str], at: Column) -> DataFrame:
    """Sources with the labels of one replaced."""
    mine = (F.col("ns") == ns) & (F.col("external_id") == external_id)
    return sources.withColumns({"labels": F.when(mine, F.array(*map(F.lit, labels)).cast("array<string>")).otherwise(F.col("labels")), "updated_at": F.when(mine, at).otherwise(F.col("updated_at"))})


# --- truth


def store_truth(versions: DataFrame, truth: DataFrame, at: Column) -> DataFrame:
    """Versions and, for each node of `truth` (ns, id, truth, confidence), a new one that differs in tx_time, truth_estimate and truth_confidence."""
    t = truth.groupBy("ns", "id").agg(F.max(F.struct("confidence", "truth")).alias("_t"))
    old = versions if "truth_estimate" in versions.columns else versions.withColumns({"truth_estimate": F.lit(None).cast("double"), "truth_confidence": F.lit(None).cast("double")})
    new = latest(old).join(t, ["ns", "id"]).withColumns({"tx_time": at, "truth_estimate": F.col("_t.truth"), "truth_confidence": F.col("_t.confidence"), "seq": F.lit(0)})
    return upsert(old, new.select(*old.columns, "seq"))


def load_truth(versions: DataFrame) -> DataFrame:
    """(ns, id, truth, confidence) that the newest versions hold."""
    return latest(versions).where("truth_estimate is not null").select("ns", "id", F.col("truth_estimate").alias("truth"), F.col("truth_confidence").alias("confidence"))
