"""Running a parsed query: names become columns, filters go below the ranking."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.dsl.language import Both, LanguageError, Not, Query
from factloom.functions import beta
from factloom.functions.score import MODES, Mode
from factloom.functions.temporal import valid_at
from factloom.operators import graph, retrieve
from factloom.operators.temporal import latest

#: Names of a query and the columns they mean.
FIELDS = {
    "id": "id", "ns": "ns", "namespace": "ns", "version": "version_no", "confidence": "confidence", "utility": "utility", "valid_from": "valid_from", "valid_time": "valid_from", "valid_until": "valid_until", "tx_time": "tx_time",
    "label": "labels", "labels": "labels", "content": "content", "text": "content", "mem_type": "mem_type", "epistemic_type": "epistemic_type", "source.name": "source_id", "source_id": "source_id", "source.credibility": "credibility",
    "score": "score", "similarity": "similarity", "rank": "rank", "path": "path",
}
RANKED = {"score", "similarity", "rank", "path"}
_MODES = {"belief_system": "belief", "agent_memory": "agent"}


def hashed_vector(text: str, dim: int = 64) -> list[float]:
    """A unit vector that depends on the text only: the embedder where no model is at hand."""
    raw = b"".join(hashlib.sha256(f"{i}:{text}".encode()).digest() for i in range(-(-dim * 4 // 32)))
    x = np.frombuffer(raw[: dim * 4], "<u4").astype(float) / 2**31 - 1
    return (x / np.sqrt((x * x).sum())).tolist()


def _literal(v) -> Column:
    return F.lit(v).cast("timestamp_ntz") if isinstance(v, datetime) else F.lit(v)


def _time(c: str, v):
    if c in ("valid_from", "valid_until", "tx_time") and isinstance(v, str):
        return datetime.fromisoformat(v)
    return v


def condition(c, fields: dict[str, str] = FIELDS) -> Column:
    """Column of a condition; a null field satisfies none of its comparisons, nor their negation."""
    if isinstance(c, Both):
        out = condition(c.parts[0], fields)
        for x in c.parts[1:]:
            out = (out & condition(x, fields)) if c.op == "and" else (out | condition(x, fields))
        return out
    if isinstance(c, Not):
        return ~condition(c.of, fields)
    if c.field not in fields or c.field in RANKED:
        raise LanguageError(f"no field {c.field!r} to filter by; there are {', '.join(sorted(set(fields) - RANKED))}")
    name = fields[c.field]
    col = F.col(name)
    if c.op == "null":
        return col.isNull()
    if name == "labels":
        if c.op in ("=", "!="):
            has = F.array_contains(col, c.value)
            return has if c.op == "=" else ~has
        if c.op == "in":
            return F.arrays_overlap(col, F.array(*map(F.lit, c.value)))
        if c.op == "like":
            return F.exists(col, lambda x: x.like(c.value))
        raise LanguageError(f"labels can't be compared by {c.op}")
    if c.op == "like":
        return col.like(c.value)
    if c.op == "between":
        return col.between(*[_literal(_time(name, x)) for x in c.value])
    if c.op == "in":
        return col.isin(*[_time(name, x) for x in c.value])
    v = _literal(_time(name, c.value))
    return {"=": col == v, "!=": col != v, ">": col > v, ">=": col >= v, "<": col < v, "<=": col <= v}[c.op]


def mode_of(q: Query) -> Mode:
    name = _MODES.get(q.mode or "general", q.mode or "general")
    if name not in MODES:
        raise LanguageError(f"no mode {q.mode!r}; there are {', '.join(MODES)}")
    m = MODES[name]
    return replace(m, weights=replace(m.weights, **q.weights))


def run(q: Query, versions: DataFrame, entries: DataFrame, edges: DataFrame, sources: DataFrame, now: datetime, embed: Callable[[str], list[float]] = hashed_vector, default_limit: int = 10, rerankers: dict[str, Callable[[str, list[str]], str] | None] | None = None) -> DataFrame:
    """Result of a query over versions (ns, id, ...), entries (write_id, ns, node_id, vec, content), edges and sources.

    Newest versions valid at AS OF (else now) and known by KNOWN AT (else whenever) are filtered, then ranked by
    similarity of their entries; FOLLOW adds what edges lead to from the best hits. An empty namespace means all.
    rerankers: models by name for RERANK, each from the query and the texts to an answer like '3,1,2'; `default` keeps the order
    unless it is given. A name that isn't there is an error. Reranked scores are 1 - i / n."""
    models = {"default": None, **(rerankers or {})}
    if q.rerank and q.rerank not in models:
        raise LanguageError(f"no reranker {q.rerank!r}; there are {', '.join(sorted(models))}")
    at = q.as_of or now
    t = _literal(at)
    n = versions.where(valid_at(t))
    n = n.where(F.col("tx_time") <= _literal(q.known_at)) if q.known_at else n
    if q.ns:
        n, entries, edges = (df.where(F.col("ns") == q.ns) for df in (n, entries, edges))
    n = latest(n)
    cred = sources.select("ns", F.col("external_id").alias("source_id"), beta.effective(F.col("labels"), F.col("alpha"), F.col("beta")).alias("credibility"))
    said = entries.where("node_id is not null").groupBy("ns", F.col("node_id").alias("id")).agg(F.max_by("content", "write_id").alias("content"))
    n = n.join(cred, ["ns", "source_id"], "left").join(said, ["ns", "id"], "left")
    if q.where is not None:
        n = n.where(condition(q.where))
    if q.exclude:
        n = n.where(F.col("source_id").isNull() | ~F.col("source_id").isin(*q.exclude))
    limit = default_limit if q.limit is None else q.limit
    mode = mode_of(q)
    space = entries.select("ns").distinct().withColumn("retrieve_id", F.xxhash64("ns"))
    asked = space.select("retrieve_id", "ns", F.array(*map(F.lit, embed(q.text))).alias("vec"))
    allowed = entries.join(n.select("ns", F.col("id").alias("node_id")), ["ns", "node_id"], "left_semi")
    found = retrieve.vector_candidates(asked, allowed, max(50, 4 * limit))
    graph_found = None
    if q.follow:
        seeds = found.orderBy(F.desc("similarity"), "id").limit(limit).select("ns", "id")
        for kind, depth in q.follow:
            one = graph.walk(seeds, graph.active(edges, t, [kind]), depth + 1).where("depth > 0").select("ns", "id")
            graph_found = one if graph_found is None else graph_found.unionByName(one)
        graph_found = graph_found.distinct().withColumn("retrieve_id", F.xxhash64("ns"))
    fused = retrieve.fuse(found, graph_found)
    wanted = space.withColumns({"t": t, "top_k": F.lit(limit), "labels": F.array().cast("array<string>")})
    ranked = retrieve.rank(fused, n, wanted, mode.weights).orderBy(F.desc("score"), "ns", "id").limit(limit)
    keep = ["ns", "id", "score", "path", F.col("similarity").alias("_similarity")]
    out = ranked.select(*keep).join(n, ["ns", "id"]).withColumn("similarity", F.col("_similarity"))
    if q.rerank:
        out = _reranked(out, q.text, models[q.rerank])
    fields = q.fields or ["ns", "id", "score", "content"]
    unknown = [f for f in fields if f not in FIELDS or f == "rank"]
    if unknown:
        raise LanguageError(f"no field {unknown[0]!r} to return; there are {', '.join(sorted(FIELDS))}")
    return _selected(out, fields)


def _reranked(out: DataFrame, query: str, model: Callable[[str, list[str]], str] | None) -> DataFrame:
    """At most the query's limit of rows, in the order that the model says."""
    best = out.select(F.lit(0).cast("bigint").alias("retrieve_id"), F.concat_ws("\x1f", "ns", "id").alias("id"), F.coalesce("content", F.lit("")).alias("content"), F.row_number().over(Window.orderBy(F.desc("score"), "ns", "id")).alias("rank"))
    order = (lambda pdf: retrieve.parsed_ranking(model(query, pdf.content.tolist()), len(pdf))) if model else None
    new = retrieve.rerank(best, order).select(F.split_part("id", F.lit("\x1f"), F.lit(1)).alias("ns"), F.split_part("id", F.lit("\x1f"), F.lit(2)).alias("id"), F.round("score", 6).alias("_score"))
    return out.join(new, ["ns", "id"]).withColumn("score", F.col("_score"))


def _selected(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.select(*[F.col(FIELDS[f]).alias(f.replace(".", "_")) for f in fields])
