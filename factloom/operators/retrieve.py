"""Hybrid retrieval for many requests at once: vector candidates, graph and session nodes, fused, scored, ranked."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.score import Weights, decay_alpha, score, session_factor
from factloom.functions.temporal import edge_active
from factloom.operators import search


@dataclass(frozen=True)
class Fusion:
    """Weights of the three paths in the fused similarity, and candidates a request gets from the index: `candidates` or top_k * `times`,
    whichever is more, of the entries that are valid at t (and have the wanted labels). cells: parameters of an index to search
    in, for collections too large to compare every request with all of its namespace; without it the search is exact."""

    vector: float = 1.0
    graph: float = 0.6
    session: float = 0.8
    candidates: int = 50
    times: int = 4
    cells: search.Cells | None = None


def vector_candidates(requests: DataFrame, entries: DataFrame, k: int, near: search.Search = search.topk) -> DataFrame:
    """(retrieve_id, ns, id, similarity): nodes of the k nearest entries, each with its best similarity. near: the search, exact or in cells.

    requests: retrieve_id, ns, vec; several rows of one request are several query vectors, of which the best counts."""
    q = requests.select(F.xxhash64("retrieve_id", "vec").alias("id"), F.col("ns").alias("scope"), "vec", "retrieve_id")
    near = near(q.select("id", "scope", "vec"), entries.select(F.col("write_id").alias("id"), F.col("ns").alias("scope"), "vec"), k)
    near = near.join(q.select(F.col("id").alias("query"), "retrieve_id", F.col("scope").alias("ns")), "query")
    near = near.join(entries.select(F.col("write_id").alias("row"), "node_id"), "row").where("node_id is not null")
    return near.groupBy("retrieve_id", "ns", F.col("node_id").alias("id")).agg(F.max("similarity").alias("similarity"))


def allowed_candidates(requests: DataFrame, entries: DataFrame, nodes: DataFrame, f: Fusion = Fusion(), labels: bool = False, only: Weights | None = None) -> DataFrame:
    """vector_candidates among the entries whose node is valid at the request's t and, with labels, has all its labels.

    only: weights of the score; candidates that can't come among the request's top_k by it, as they aren't fused with others, are left
    out where they are found, so that few are moved."""
    wanted = F.col("labels") if labels else F.lit(None).cast("array<string>")
    most = F.greatest(F.lit(f.candidates), F.col("top_k") * f.times)
    q = requests.select(F.xxhash64("retrieve_id", "vec").alias("id"), F.col("ns").alias("scope"), "vec", "retrieve_id", "t", "top_k", most.alias("most"), wanted.alias("wanted"))
    e, index = entries.select(F.col("write_id").alias("id"), F.col("ns").alias("scope"), "node_id", "vec"), {}
    if f.cells:
        index = {"cells": search.centroids(e.select("id", "vec"), f.cells), "probes": f.cells.probes}
        e = search.coded(e, index["cells"])
    n = nodes.select(F.col("ns").alias("scope"), F.col("id").alias("node_id"), F.col("labels") if labels else F.lit(None).cast("array<string>").alias("labels"), "valid_from", "valid_until", *(["confidence", "utility"] if only else []))
    e = e.join(n, ["scope", "node_id"])
    if only:
        near = search.gathered(q, e, ["retrieve_id", "scope", "t", "top_k"], ["node_id", "valid_from", "valid_until", "confidence", "utility"], **index)
        near = near.withColumn("score", F.round(score(F.col("similarity") * f.vector, F.col("t"), only)["score"], 6)).where("score > 0")
        near = near.select("query", "retrieve_id", F.col("scope").alias("ns"), "node_id", "similarity", "score", "top_k")
        near = search.first_of_runs(near, "query", "node_id", "top_k", "score")
        return near.groupBy("retrieve_id", "ns", F.col("node_id").alias("id")).agg(F.max("similarity").alias("similarity"))
    near = search.topk_allowed(q, e, **index)
    near = near.join(q.select(F.col("id").alias("query"), "retrieve_id", F.col("scope").alias("ns")), "query")
    near = near.join(entries.select(F.col("write_id").alias("row"), "node_id"), "row")
    return near.groupBy("retrieve_id", "ns", F.col("node_id").alias("id")).agg(F.max("similarity").alias("similarity"))


def with_top_k(requests: DataFrame, default: int = 10) -> DataFrame:
    """A top_k that is null, 0 or less means the default."""
    return requests.withColumn("top_k", F.when(F.col("top_k") > 0, F.col("top_k")).otherwise(F.lit(default)))


def graph_candidates(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """(retrieve_id, ns, id): seeds and the nodes that an edge active at the request's time leads to from a seed."""
    seeds = requests.select("retrieve_id", "ns", "t", F.explode("seeds").alias("id")).where("id is not null").distinct()
    out = edges.select("ns", F.col("src").alias("id"), "dst", "valid_from", "valid_until", "invalidated_at")
    step = seeds.join(out, ["ns", "id"]).where(edge_active(F.col("t"))).select("retrieve_id", "ns", F.col("dst").alias("id"))
    return seeds.select("retrieve_id", "ns", "id").unionByName(step.where("id is not null")).distinct()


def fuse(vector: DataFrame, graph: DataFrame | None = None, session: DataFrame | None = None, f: Fusion = Fusion()) -> DataFrame:
    """(retrieve_id, ns, id, similarity, path): a node that several paths find keeps its largest weighted similarity."""
    parts = [vector.select("retrieve_id", "ns", "id", (F.col("similarity") * f.vector).alias("similarity"), F.lit("vector").alias("path"))]
    for df, w, name in ((graph, f.graph, "graph"), (session, f.session, "session")):
        if df is not None:
            parts.append(df.select("retrieve_id", "ns", "id", F.lit(w).alias("similarity"), F.lit(name).alias("path")))
    all_ = parts[0]
    for x in parts[1:]:
        all_ = all_.unionByName(x)
    best = F.max(F.struct("similarity", "path"))
    return all_.groupBy("retrieve_id", "ns", "id").agg(best.alias("b"), F.count("*").alias("paths")).select("retrieve_id", "ns", "id", "b.similarity", F.when(F.col("paths") > 1, "fused").otherwise(F.col("b.path")).alias("path"))


def penalise_session(candidates: DataFrame, session_vectors: DataFrame) -> DataFrame:
    """Lower the similarity of candidates (with vec) that resemble a node of the request's session."""
    s = session_vectors.select("retrieve_id", F.col("vec").alias("sv"))
    met = candidates.select("retrieve_id", "id", "vec").where("vec is not null").join(s.where("sv is not null"), "retrieve_id")
    most = search.paired(met, ["retrieve_id", "id"], "vec", "sv").groupBy("retrieve_id", "id").agg(F.max("similarity").alias("most"))
    return candidates.join(most, ["retrieve_id", "id"], "left").withColumn("similarity", F.col("similarity") * session_factor(F.coalesce("most", F.lit(0.0)))).drop("most")


def rank(candidates: DataFrame, nodes: DataFrame, requests: DataFrame, w: Weights, exclude_sources: list[str] | None = None, per_type_decay: bool = False, where: Column | None = None) -> DataFrame:
    """Score candidates at the request's t, drop what scores 0, keep top_k: the ranked result with its components."""
    n = nodes.select("ns", "id", "labels", "source_id", "confidence", "utility", "mem_type", "valid_from", "valid_until", "version_no")
    r = requests.select("retrieve_id", "t", "top_k", F.col("labels").alias("wanted")).dropDuplicates(["retrieve_id"])
    c = candidates.join(n, ["ns", "id"]).join(r, "retrieve_id")
    if exclude_sources:
        c = c.where(F.col("source_id").isNull() | ~F.col("source_id").isin(*exclude_sources))
    if where is not None:
        c = c.where(where)
    s = score(F.col("similarity"), F.col("t"), w, decay=decay_alpha(F.col("mem_type")) if per_type_decay else None)
    c = c.withColumn("s", s).where("s.score > 0")
    c = c.withColumn("score", F.round("s.score", 6))
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("retrieve_id").orderBy(F.desc("score"), "id")).cast("bigint")).where("rank <= top_k")
    rounded = [F.round(f"s.{x}_score", 6).alias(x) for x in ("similarity", "confidence", "recency", "utility")]
    return c.select("retrieve_id", "rank", "ns", "id", "score", *rounded, "path")


def has_labels(wanted: str = "wanted", labels: str = "labels") -> Column:
    """All wanted labels are there; nothing wanted is always there."""
    none = F.array().cast("array<string>")
    return F.size(F.array_except(F.coalesce(wanted, none), F.coalesce(labels, none))) == 0


def retrieve(requests: DataFrame, nodes: DataFrame, entries: DataFrame, w: Weights, edges: DataFrame | None = None, session: DataFrame | None = None, f: Fusion = Fusion(), labels: bool = False, **options) -> DataFrame:
    """The flagship: candidates of all paths, fused, scored and cut to top_k per request. labels: results have all labels of the request."""
    if labels:
        where = options.pop("where", None)
        options["where"] = has_labels() if where is None else where & has_labels()
    requests = with_top_k(requests)
    alone = f.cells and edges is None and session is None and not options
    vector = allowed_candidates(requests, entries, nodes, f, labels, w if alone else None)
    graph = graph_candidates(requests, edges) if edges is not None else None
    return rank(fuse(vector, graph, session, f), nodes, requests, w, **options)


def mmr(ranked: DataFrame, vectors: DataFrame, trade: float, k: int) -> DataFrame:
    """Greedy maximal marginal relevance: after the best, always the largest trade * score - (1 - trade) * similarity to the chosen.

    ranked: retrieve_id, id, score, rank; vectors: id, vec. A missing vector resembles nothing. Groups are top-k results, so small."""
    have = ranked.select("retrieve_id", "id", "score", "rank").join(vectors.select("id", "vec"), "id", "left")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "id"]).reset_index(drop=True)
        n = len(pdf)
        dim = max((len(v) for v in pdf.vec if v is not None), default=0)
        x = np.zeros((n, dim))
        for i, v in enumerate(pdf.vec):
            if v is not None and len(v) == dim:
                x[i] = v
        x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
        chosen, most = [], np.zeros(n)
        left = list(range(n))
        while left and len(chosen) < k:
            gain = [trade * pdf.score[i] - (1 - trade) * most[i] for i in left]
            i = left.pop(0 if not chosen else int(np.argmax(np.round(gain, 12))))
            chosen.append(i)
            most = np.maximum(most, x @ x[i])
        out = pdf.iloc[chosen][["retrieve_id", "id", "score"]].copy()
        out["mmr_rank"] = np.arange(1, len(chosen) + 1)
        return out

    return have.groupBy("retrieve_id").applyInPandas(greedy, "retrieve_id bigint, id string, score double, mmr_rank long")


def ranking_prompt(query: str, texts: list[str]) -> str:
    """What a model is asked for: an order of numbered texts, each cut to 200 characters."""
    cut_ = [t if len(t) <= 200 else t[:200] + "..." for t in texts]
    return "\n".join([f"Query: {query}", "Order the texts by how well they answer the query. Give their numbers only, the best first, separated by commas.", *[f"Text {i}: {t}" for i, t in enumerate(cut_, 1)]])


def parsed_ranking(answer: str, n: int) -> list[int]:
    """Positions from 1 that an answer like '3, 1, 2' gives: each once, unknown ones left out, missing ones appended."""
    said = [int(m.group()) for x in answer.split(",") if (m := re.match(r"[+-]?\d+", x.strip()))]
    said = list(dict.fromkeys(i for i in said if 1 <= i <= n))
    return said + [i for i in range(1, n + 1) if i not in set(said)]


def rerank(ranked: DataFrame, order: Callable[[pd.DataFrame], list[int]] | None = None) -> DataFrame:
    """Put each request's results into the order that a callable gives (positions from 1; unknown and repeated ones are
    ignored, missing ones follow). Without one, or where it fails, the order stays. Scores become 1 - i / n."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        n = len(pdf)
        try:
            said = order(pdf) if order else []
        except Exception:
            said = []
        seq = [i - 1 for i in dict.fromkeys(said) if 1 <= i <= n]
        seq += [i for i in range(n) if i not in set(seq)]
        out = pdf.iloc[seq][["retrieve_id", "id"]].copy()
        out["rerank"] = np.arange(1, n + 1)
        out["score"] = 1 - np.arange(n) / max(n, 1)
        return out

    return ranked.groupBy("retrieve_id").applyInPandas(one, "retrieve_id bigint, id string, rerank long, score double")


def explain(ranked: DataFrame) -> DataFrame:
    """Why the first result of a request beats the second: winner, margin and the factor that differs most."""
    top = ranked.where("rank <= 2")
    factors = ["similarity", "confidence", "recency", "utility"]
    side = lambda r: F.max(F.when(F.col("rank") == r, F.struct("id", "score", *factors)))
    p = top.groupBy("retrieve_id").agg(side(1).alias("a"), side(2).alias("b")).where("b is not null")
    deltas = F.array(*[F.struct((-F.abs(F.col(f"a.{x}") - F.col(f"b.{x}"))).alias("size"), F.lit(i).alias("i"), F.lit(x).alias("factor"), F.round(F.col(f"a.{x}") - F.col(f"b.{x}"), 6).alias("delta")) for i, x in enumerate(factors)])
    first = F.element_at(F.array_sort(deltas), 1)
    return p.select("retrieve_id", F.col("a.id").alias("winner"), F.col("b.id").alias("loser"), F.round(F.col("a.score") - F.col("b.score"), 6).alias("margin"), first["factor"].alias("factor"), first["delta"].alias("delta"))


def contrastive(ranked: DataFrame, nodes: DataFrame, edges: DataFrame, t: Column, w: Weights) -> DataFrame:
    """Each result with its strongest contradicting neighbour, in either direction, scored without similarity."""
    e = edges.where((F.col("edge_type") == "contradicts") & edge_active(t)).select("ns", "src", "dst", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    both = e.select("ns", F.col("src").alias("id"), F.col("dst").alias("other"), "weight").unionByName(e.select("ns", F.col("dst").alias("id"), F.col("src").alias("other"), "weight"))
    best = both.groupBy("ns", "id").agg(F.max_by("other", F.struct("weight", "other")).alias("other"), F.max("weight").alias("weight"))
    n = nodes.select("ns", F.col("id").alias("other"), "confidence", F.lit(1.0).alias("utility"), "valid_from", "valid_until")
    found = ranked.select("ns", "id").distinct().join(best, ["ns", "id"]).join(n, ["ns", "other"])
    return found.select("ns", "id", "other", "weight", F.round(score(F.lit(0.0), t, w)["score"], 6).alias("other_score"))
