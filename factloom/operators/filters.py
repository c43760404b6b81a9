"""Filter trees over nodes, and substring search with a scan where retrieval finds nothing."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.temporal import valid_at
from factloom.operators.graph import active

#: What a tree may hold: branches, tests of the node itself, of its active out-edges, of its source.
BRANCH = {"and", "or", "not"}
NODE = {"contentContains", "similarityMin", "validAt", "validFromBefore", "validToAfter", "confidenceMin", "labels", "memType"}
EDGE = {"hasEdgeTo", "edgeTypes", "edgeWeightMin"}
SOURCE = {"sourceCredibilityMin", "sourceCredibilityMax"}


def _time(x: Any) -> Column:
    return F.lit(datetime.fromisoformat(x) if isinstance(x, str) else x).cast("timestamp_ntz")


def _leaves(tree: dict, out: list[tuple]) -> list[tuple]:
    """The different tests of edges in a tree."""
    key = _edge_key(tree)
    if key and key not in out:
        out.append(key)
    for b in ("and", "or"):
        for x in tree.get(b) or []:
            _leaves(x, out)
    if tree.get("not"):
        _leaves(tree["not"], out)
    return out


def _edge_key(tree: dict) -> tuple | None:
    if not EDGE & tree.keys():
        return None
    return tuple(tree["hasEdgeTo"]) if "hasEdgeTo" in tree else None, tuple(tree.get("edgeTypes") or ()), tree.get("edgeWeightMin")


def _column(tree: dict, edges: list[tuple]) -> Column:
    unknown = tree.keys() - BRANCH - NODE - EDGE - SOURCE
    if unknown:
        raise ValueError(f"no filter {sorted(unknown)[0]!r}; there are {', '.join(sorted(BRANCH | NODE | EDGE | SOURCE))}")
    said: list[Column] = [_column(x, edges) for x in tree.get("and") or []]
    if tree.get("or"):
        some = F.lit(False)
        for x in tree["or"]:
            some = some | _column(x, edges)
        said.append(some)
    if tree.get("not"):
        said.append(~_column(tree["not"], edges))
    if tree.get("contentContains"):
        said.append(F.contains(F.lower(F.coalesce("content", F.lit(""))), F.lit(tree["contentContains"].lower())))
    if "similarityMin" in tree:
        said.append(F.coalesce("similarity", F.lit(0.0)) >= tree["similarityMin"])
    if "confidenceMin" in tree:
        said.append(F.col("confidence") >= tree["confidenceMin"])
    if "labels" in tree:
        said.append(F.size(F.array_except(F.array(*map(F.lit, tree["labels"])).cast("array<string>"), F.coalesce("labels", F.array().cast("array<string>")))) == 0)
    if "memType" in tree:
        said.append(F.col("mem_type") == tree["memType"])
    if "validAt" in tree:
        said.append(valid_at(_time(tree["validAt"])))
    if "validFromBefore" in tree:
        said.append(F.col("valid_from") < _time(tree["validFromBefore"]))
    if "validToAfter" in tree:
        said.append(F.col("valid_until") > _time(tree["validToAfter"]))
    key = _edge_key(tree)
    if key:
        said.append(F.col(f"_edge{edges.index(key)}"))
    if "sourceCredibilityMin" in tree:
        said.append(F.col("_credibility") >= tree["sourceCredibilityMin"])
    if "sourceCredibilityMax" in tree:
        said.append(F.col("_credibility") <= tree["sourceCredibilityMax"])
    out = F.lit(True)
    for c in said:
        out = out & F.coalesce(c, F.lit(False))
    return out


def matching(nodes: DataFrame, tree: dict, edges: DataFrame, credibility: DataFrame, t: Column) -> DataFrame:
    """The nodes that a filter tree lets through.

    nodes: ns, id, source_id, valid_from, valid_until and what the tree asks for (content, similarity, confidence, labels, mem_type).
    edges: of which those active at t count. credibility: ns, source_id, credibility. Keys of one level all hold; `and` and `or` are
    lists of trees, an empty tree or list lets everything through; `not` is a tree. A test of a null field fails, so its negation
    holds; an edge test asks for one edge that passes all its parts, a credibility test fails without a known source."""
    leaves = _leaves(tree, [])
    out, cols = nodes, nodes.columns
    for i, (to, types, least) in enumerate(leaves):
        e = active(edges, t, list(types) or None)
        e = e.where(F.col("dst").isin(*to)) if to is not None else e
        e = e.where(F.col("weight") >= least) if least is not None else e
        out = out.join(e.select("ns", F.col("src").alias("id")).distinct().withColumn(f"_edge{i}", F.lit(True)), ["ns", "id"], "left")
    if SOURCE & _keys(tree):
        out = out.join(credibility.select("ns", "source_id", F.col("credibility").alias("_credibility")), ["ns", "source_id"], "left")
    return out.where(_column(tree, leaves)).select(*cols)


def _keys(tree: dict) -> set[str]:
    found = set(tree)
    for x in [*(tree.get("and") or []), *(tree.get("or") or []), *([tree["not"]] if tree.get("not") else [])]:
        found |= _keys(x)
    return found


def admin_search(valid: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """(ns, id, source_id, match_reason): valid nodes (with content) that hold the text, newest first; the first of text, source, label and
    id that holds it is the reason. An empty text gives the most recent nodes. limit: 1 to 50."""
    needle = (text or "").strip().lower()
    has = lambda c: F.contains(F.lower(c), F.lit(needle))
    why = F.when(has(F.col("content")), "text").when(has(F.col("source_id")), "source").when(F.exists("labels", has), "label").when(has(F.col("id")), "id") if needle else F.lit("recent")
    found = valid.withColumn("match_reason", why).where("match_reason is not null")
    return found.orderBy(F.col("tx_time").desc_nulls_last(), "id", "ns").limit(max(1, min(limit, 50))).select("ns", "id", "source_id", "match_reason")


def search_or_scan(found: DataFrame, valid: DataFrame, text: str, tree: dict, edges: DataFrame, credibility: DataFrame, t: Column, limit: int = 10) -> DataFrame:
    """(ns, id, score, path): retrieved nodes (ns, id, score, similarity, path) that pass the tree; if none does, the valid nodes that pass it
    and whose content, source, label or id holds the text, each with score 1 and path `scan`."""
    f = found.select("ns", "id", "score", "similarity", "path").join(valid, ["ns", "id"])
    kept = matching(f, tree, edges, credibility, t).select("ns", "id", "score", "path")
    if not kept.isEmpty():
        return kept.orderBy(F.desc("score"), "ns", "id").limit(limit)
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(text.strip().lower())), F.lit(False))
    hit = has(F.col("content")) | has(F.col("source_id")) | F.coalesce(F.exists("labels", has), F.lit(False)) | has(F.col("id"))
    scanned = matching(valid.withColumn("similarity", F.lit(1.0)).where(hit), tree, edges, credibility, t)
    return scanned.select("ns", "id", F.lit(1.0).alias("score"), F.lit("scan").alias("path")).orderBy("ns", "id").limit(limit)
