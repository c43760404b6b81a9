"""Queries of retrieval and vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.keys import uuid_key
from factloom.functions.score import MODES
from factloom.operators import retrieve as r
from factloom.operators import search, temporal
from factloom.sources import views as v

ALL = 1 << 20


def _parts(spark: SparkSession, d: str):
    q = v.requests(spark, d).withColumn("seeds", F.array_distinct(F.transform("seed_ids", uuid_key)))
    return q, temporal.latest(v.nodes(spark, d)), v.vectors(spark, d)


def _mode(mode: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        q, n, e = _parts(spark, d)
        return r.retrieve(q, n, e, MODES[mode].weights)

    return run


def _labels(spark: SparkSession, d: str) -> DataFrame:
    q, n, e = _parts(spark, d)
    return r.retrieve(q, n, e, MODES["general"].weights, labels=True)


def _exclude(spark: SparkSession, d: str) -> DataFrame:
    q, n, e = _parts(spark, d)
    return r.retrieve(q, n, e, MODES["general"].weights, exclude_sources=["agent:siozeaxfin", "user:pruwend"])


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    q, n, e = _parts(spark, d)
    return r.retrieve(q, n, e, MODES["general"].weights, edges=v.edges(spark, d))


def _typed_decay(spark: SparkSession, d: str) -> DataFrame:
    q, n, e = _parts(spark, d)
    return r.retrieve(q, n, e, MODES["agent"].weights, per_type_decay=True)


def _multi(spark: SparkSession, d: str) -> DataFrame:
    """Every request asks with its own vector and with that of its namespace's request before it."""
    q, n, e = _parts(spark, d)
    before = F.lag("vec").over(Window.partitionBy("ns").orderBy("retrieve_id"))
    two = q.withColumn("before", before).withColumn("vec", F.explode(F.array_compact(F.array("vec", "before"))))
    return r.rank(r.fuse(r.allowed_candidates(two, e, n)), n, q, MODES["general"].weights)


def _session(spark: SparkSession, d: str) -> DataFrame:
    """Seeds serve as the session: they join the candidates, and what resembles them is lowered."""
    q, n, e = _parts(spark, d)
    seeds = q.select("retrieve_id", "ns", F.explode("seeds").alias("id")).where("id is not null").distinct()
    vec = e.groupBy("ns", F.col("node_id").alias("id")).agg(F.max_by("vec", F.struct("received_at", "write_id")).alias("vec"))
    c = r.fuse(r.allowed_candidates(q, e, n), session=seeds).join(vec, ["ns", "id"], "left")
    c = r.penalise_session(c, seeds.join(vec, ["ns", "id"]))
    return r.rank(c, n, q, MODES["general"].weights)


def _topk(spark: SparkSession, d: str) -> DataFrame:
    q, _, e = _parts(spark, d)
    near = search.topk(q.select(F.col("retrieve_id").alias("id"), F.col("ns").alias("scope"), "vec"), e.select(F.col("write_id").alias("id"), F.col("ns").alias("scope"), "vec"), 20)
    return near.select(F.col("query").alias("retrieve_id"), F.col("row").alias("write_id"), F.round("similarity", 6).alias("similarity"))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    q, _, e = _parts(spark, d)
    near = search.topk_cells(q.select(F.col("retrieve_id").alias("id"), F.col("ns").alias("scope"), "vec"), e.select(F.col("write_id").alias("id"), F.col("ns").alias("scope"), "vec"), 10)
    return near.select(F.col("query").alias("retrieve_id"), F.col("row").alias("write_id"), F.round("similarity", 6).alias("similarity"), "rank")


def _cells_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the search in cells finds 0.95 or more of the ten nearest entries of all requests."""
    q, e = v.requests(spark, d, narrow=True), v.vectors(spark, d, narrow=True)
    n = search.agreement(q.select(F.col("retrieve_id").alias("id"), F.col("ns").alias("scope"), "vec"), e.select(F.col("write_id").alias("id"), F.col("ns").alias("scope"), "vec"), 10, of=20, coarse=6)
    total = lambda c: F.coalesce(F.sum(F.col("queries") * F.col(c)), F.lit(0))
    return n.agg((total("found") >= 0.95 * total("n")).alias("enough"))


def _in_cells(spark: SparkSession, d: str) -> DataFrame:
    """retrieve_general over an index of cells."""
    q, n, e = _parts(spark, d)
    return r.retrieve(q, n, e, MODES["general"].weights, f=r.Fusion(cells=search.Cells()))


def _pairs(low: float, high: float):
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = v.vectors(spark, d).select(F.col("write_id").alias("id"), F.col("ns").alias("scope"), "vec")
        return search.pairs_within(e, low, high).select("a", "b", F.round("similarity", 6).alias("similarity"))

    return run


def _mmr(spark: SparkSession, d: str) -> DataFrame:
    q, n, e = _parts(spark, d)
    vec = e.groupBy(F.col("node_id").alias("id")).agg(F.max_by("vec", F.struct("received_at", "write_id")).alias("vec"))
    return r.mmr(r.retrieve(q, n, e, MODES["general"].weights), vec, 0.5, 10)


def _explain(spark: SparkSession, d: str) -> DataFrame:
    return r.explain(_mode("general")(spark, d))


def _contrastive(spark: SparkSession, d: str) -> DataFrame:
    _, n, _ = _parts(spark, d)
    return r.contrastive(_mode("general")(spark, d), n, v.edges(spark, d), v.now(), MODES["general"].weights)


def _rerank(spark: SparkSession, d: str) -> DataFrame:
    return r.rerank(_mode("general")(spark, d), lambda pdf: list(range(len(pdf), 0, -1))).select("retrieve_id", "id", "rerank", F.round("score", 6).alias("score"))


QUERIES = {
    **{f"retrieve_{m}": _mode(m) for m in MODES}, "retrieve_labels": _labels, "retrieve_exclude_sources": _exclude, "retrieve_hybrid_graph": _hybrid, "retrieve_typed_decay": _typed_decay,
    "retrieve_multi_vector": _multi, "retrieve_session": _session, "vector_topk": _topk, "vector_topk_cells": _cells, "vector_cells_recall": _cells_recall, "retrieve_in_cells": _in_cells, "near_dup_pairs": _pairs(0.95, 2.0), "similar_pairs_band": _pairs(0.85, 0.95),
    "mmr_rerank": _mmr, "explain_rank": _explain, "contrastive": _contrastive, "rerank_reverse": _rerank,
}

_ALL = "SELECT q.retrieve_id, q.ns, v.write_id, v.node_id, round(list_cosine_similarity(q.vec, v.vec), 9) AS sim FROM q JOIN v ON q.ns = v.ns"
_CAND = "SELECT q.retrieve_id, q.ns, q.vec AS qv, q.top_k, v.write_id, v.node_id, round(list_cosine_similarity(q.vec, v.vec), 9) AS sim FROM {q} q JOIN v ON q.ns = v.ns JOIN latest l ON l.ns = v.ns AND l.id = v.node_id AND l.valid_from <= q.t AND (l.valid_until IS NULL OR q.t <= l.valid_until)"
_LAB = " AND (q.labels IS NULL OR list_has_all(coalesce(l.labels, []), q.labels))"
_K = "SELECT * FROM c0 WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY sim DESC, write_id) <= greatest(50, 4 * top_k)"
_BEST = "SELECT retrieve_id, ns, node_id AS id, max(sim) AS similarity, 'vector' AS path FROM c1 WHERE node_id IS NOT NULL GROUP BY 1, 2, 3"
_HOURS = "(epoch_us({b}) - epoch_us({a})) / 3600000000.0"


def sql_score(w, sim: str = "similarity", t: str = "t", alpha: str | None = None, utility: str = "utility") -> dict[str, str]:
    s, c, r_, u = w.shares()
    age = f"greatest(0.0, {_HOURS.format(a='valid_from', b=t)})"
    left = _HOURS.format(a=t, b="valid_until")
    parts = {
        "similarity": f"greatest(0.0, least(1.0, {sim}))",
        "confidence": f"greatest(0.0, least(1.0, (CASE WHEN confidence IS NULL OR confidence = 0 THEN 0.5 ELSE confidence END) * (CASE WHEN {left} > 0 THEN 1 - exp(-0.02 * {left}) ELSE 1.0 END)))",
        "recency": f"exp(-({alpha or w.decay}) * {age})",
        "utility": f"coalesce(greatest(0.0, least(1.0, {utility})), 1.0)",
    }
    ok = f"valid_from <= {t} AND (valid_until IS NULL OR {t} <= valid_until)"
    total = f"{s} * {parts['similarity']} + {c} * {parts['confidence']} + {r_} * {parts['recency']} + {u} * {parts['utility']}"
    return parts | {"score": f"CASE WHEN {ok} THEN {total} ELSE 0.0 END"}


def _ranked(w, where: str = "TRUE", alpha: str | None = None) -> str:
    p = sql_score(w, alpha=alpha)
    return f"""SELECT * FROM (SELECT c.retrieve_id, c.ns, c.id, c.path, r.top_k, round({p["score"]}, 6) AS score, round({p["similarity"]}, 6) AS similarity, round({p["confidence"]}, 6) AS confidence,
round({p["recency"]}, 6) AS recency, round({p["utility"]}, 6) AS utility FROM c2 c JOIN latest n ON c.ns = n.ns AND c.id = n.id JOIN (SELECT retrieve_id AS rid, t, top_k, labels AS wanted FROM q) r ON r.rid = c.retrieve_id WHERE {where}) WHERE score > 0"""


_OUT = "SELECT retrieve_id, row_number() OVER (PARTITION BY retrieve_id ORDER BY score DESC, id) AS rank, ns, id, score, similarity, confidence, recency, utility, path FROM k QUALIFY row_number() OVER (PARTITION BY retrieve_id ORDER BY score DESC, id) <= top_k"


def _sql(w, where: str = "TRUE", alpha: str | None = None, body: str = _OUT, c2: str = "SELECT * FROM cv", q: str = "q", key: str = "retrieve_id", also: str = "", **more: str) -> str:
    return v.sql(body, c0=_CAND.format(q=q) + also, c1=_K.format(key=key), cv=_BEST, **more, c2=c2, k=_ranked(w, where, alpha))


_SEEDS = f"SELECT DISTINCT retrieve_id, ns, t, {v.sql_uuid('s')} AS id FROM (SELECT retrieve_id, ns, t, unnest(seed_ids) AS s FROM q) WHERE {v.sql_uuid('s')} IS NOT NULL"
_GRAPH = """SELECT DISTINCT retrieve_id, ns, id, 0.6 AS similarity, 'graph' AS path FROM (SELECT retrieve_id, ns, id FROM seeds UNION
SELECT s.retrieve_id, s.ns, e.dst FROM seeds s JOIN e ON s.ns = e.ns AND s.id = e.src WHERE e.dst IS NOT NULL AND e.valid_from <= s.t AND (e.valid_until IS NULL OR s.t <= e.valid_until) AND (e.invalidated_at IS NULL OR s.t < e.invalidated_at))"""
_FUSE = "SELECT retrieve_id, ns, id, max(similarity) AS similarity, CASE WHEN count(*) > 1 THEN 'fused' ELSE max(path) END AS path FROM (SELECT * FROM cv UNION ALL SELECT * FROM {g}) GROUP BY 1, 2, 3"
_VEC = "SELECT ns, node_id AS id, arg_max(vec, (received_at, write_id)) AS vec FROM v WHERE node_id IS NOT NULL GROUP BY 1, 2"
_G = MODES["general"].weights
_TYPED = "CASE mem_type WHEN 'episodic' THEN 0.08 WHEN 'semantic' THEN 0.02 WHEN 'procedural' THEN 0.001 WHEN 'working' THEN 999.0 ELSE 0.05 END"
_PAIRS = "SELECT a.write_id AS a, b.write_id AS b, round(s, 6) AS similarity FROM (SELECT a, b, round(list_cosine_similarity(a.vec, b.vec), 9) AS s FROM v a JOIN v b ON a.ns = b.ns AND a.write_id < b.write_id) WHERE s >= {low} AND s < {high}"
_F4 = ["similarity", "confidence", "recency", "utility"]
_NOW = f"TIMESTAMP '{v.AS_OF}'"
_ACTIVE = "valid_from <= {t} AND (valid_until IS NULL OR {t} <= valid_until) AND (invalidated_at IS NULL OR {t} < invalidated_at)"
SQL = {
    **{f"retrieve_{m}": _sql(MODES[m].weights) for m in MODES},
    "retrieve_labels": _sql(_G, "wanted IS NULL OR list_has_all(coalesce(n.labels, []), wanted)", also=_LAB),
    "retrieve_exclude_sources": _sql(_G, "n.source_id IS NULL OR n.source_id NOT IN ('agent:siozeaxfin', 'user:pruwend')"),
    "retrieve_hybrid_graph": _sql(_G, seeds=_SEEDS, g=_GRAPH, c2=_FUSE.format(g="g")),
    "retrieve_typed_decay": _sql(MODES["agent"].weights, alpha=_TYPED),
    "retrieve_multi_vector": v.sql(_OUT, q2="SELECT retrieve_id, ns, vec, top_k, t FROM q UNION ALL SELECT retrieve_id, ns, pv, top_k, t FROM (SELECT retrieve_id, ns, top_k, t, lag(vec) OVER (PARTITION BY ns ORDER BY retrieve_id) AS pv FROM q) WHERE pv IS NOT NULL",
                                   c0=_CAND.format(q="q2"), c1=_K.format(key="retrieve_id, qv"), cv=_BEST, c2="SELECT * FROM cv", k=_ranked(_G)),
    "retrieve_session": _sql(_G, seeds=_SEEDS, g="SELECT DISTINCT retrieve_id, ns, id, 0.8 AS similarity, 'session' AS path FROM seeds", f=_FUSE.format(g="g"), nv=_VEC,
                             m="SELECT f.retrieve_id, f.id, max(list_cosine_similarity(x.vec, y.vec)) AS most FROM f JOIN nv x ON x.ns = f.ns AND x.id = f.id JOIN seeds s ON s.retrieve_id = f.retrieve_id JOIN nv y ON y.ns = s.ns AND y.id = s.id GROUP BY 1, 2",
                             c2="SELECT f.retrieve_id, f.ns, f.id, f.path, f.similarity * (CASE WHEN coalesce(m.most, 0) > 0.8 THEN greatest(0.5, 1 - (m.most - 0.8) * 2.5) ELSE 1.0 END) AS similarity FROM f LEFT JOIN m ON f.retrieve_id = m.retrieve_id AND f.id = m.id"),
    "vector_topk": v.sql("SELECT retrieve_id, write_id, round(sim, 6) AS similarity FROM c0 WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY retrieve_id ORDER BY sim DESC, write_id) <= 20", c0=_ALL),
    "vector_cells_recall": "SELECT true AS enough",
    "near_dup_pairs": v.sql("SELECT a, b, round(s, 6) AS similarity FROM p WHERE s >= 0.95", p="SELECT a.write_id AS a, b.write_id AS b, round(list_cosine_similarity(a.vec, b.vec), 9) AS s FROM v a JOIN v b ON a.ns = b.ns AND a.write_id < b.write_id"),
    "similar_pairs_band": v.sql("SELECT a, b, round(s, 6) AS similarity FROM p WHERE s >= 0.85 AND s < 0.95", p="SELECT a.write_id AS a, b.write_id AS b, round(list_cosine_similarity(a.vec, b.vec), 9) AS s FROM v a JOIN v b ON a.ns = b.ns AND a.write_id < b.write_id"),
    "explain_rank": v.sql(
        f"SELECT a.retrieve_id, a.id AS winner, b.id AS loser, round(a.score - b.score, 6) AS margin, CASE {' '.join(f'WHEN abs(a.{x} - b.{x}) = greatest({chr(44).join(f'abs(a.{y} - b.{y})' for y in _F4)}) THEN {chr(39)}{x}{chr(39)}' for x in _F4)} END AS factor, "
        f"CASE {' '.join(f'WHEN abs(a.{x} - b.{x}) = greatest({chr(44).join(f'abs(a.{y} - b.{y})' for y in _F4)}) THEN round(a.{x} - b.{x}, 6)' for x in _F4)} END AS delta FROM o a JOIN o b ON a.retrieve_id = b.retrieve_id AND a.rank = 1 AND b.rank = 2",
        c0=_CAND.format(q="q"), c1=_K.format(key="retrieve_id"), cv=_BEST, c2="SELECT * FROM cv", k=_ranked(_G), o=_OUT),
    "contrastive": v.sql(
        f"SELECT x.ns, x.id, b.other, b.weight, round({sql_score(_G, sim='0.0', t=_NOW, utility='1.0')['score']}, 6) AS other_score FROM (SELECT DISTINCT ns, id FROM o) x JOIN b ON x.ns = b.ns AND x.id = b.id JOIN latest n ON n.ns = b.ns AND n.id = b.other",
        c0=_CAND.format(q="q"), c1=_K.format(key="retrieve_id"), cv=_BEST, c2="SELECT * FROM cv", k=_ranked(_G), o=_OUT,
        ce=f"SELECT ns, src, dst, coalesce(weight, 0.0) AS weight FROM e WHERE edge_type = 'contradicts' AND {_ACTIVE.format(t=_NOW)}",
        b="SELECT ns, id, arg_max(other, (weight, other)) AS other, max(weight) AS weight FROM (SELECT ns, src AS id, dst AS other, weight FROM ce UNION ALL SELECT ns, dst, src, weight FROM ce) WHERE id IS NOT NULL GROUP BY 1, 2"),
    "rerank_reverse": v.sql("SELECT retrieve_id, id, row_number() OVER (PARTITION BY retrieve_id ORDER BY rank DESC) AS rerank, round(1 - (row_number() OVER (PARTITION BY retrieve_id ORDER BY rank DESC) - 1) / count(*) OVER (PARTITION BY retrieve_id), 6) AS score FROM o",
        c0=_CAND.format(q="q"), c1=_K.format(key="retrieve_id"), cv=_BEST, c2="SELECT * FROM cv", k=_ranked(_G), o=_OUT),
}
