"""Queries of versions and of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.temporal import hours_between
from factloom.functions.text import fingerprint
from factloom.operators import graph, temporal
from factloom.sources import views as v
from factloom.sources.tables import table

T1, T2 = "2025-03-01 00:00:00", "2025-04-01 00:00:00"
_t = lambda s: F.lit(s).cast("timestamp_ntz")
_COLS = ["ns", "id", "version_no", "tx_time", "valid_from", "valid_until", "confidence"]


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return temporal.latest(v.nodes(spark, d)).select(*_COLS)


def _as_of(spark: SparkSession, d: str) -> DataFrame:
    return temporal.as_of(v.nodes(spark, d), _t(T2)).select(*_COLS)


def _valid_at(spark: SparkSession, d: str) -> DataFrame:
    return temporal.valid_nodes(v.nodes(spark, d), v.now(), ["Fact"]).select(*_COLS)


def _diff(spark: SparkSession, d: str) -> DataFrame:
    return temporal.diff(v.nodes(spark, d), _t(T1), _t(T2)).select("ns", "id", "version_no", "change")


def _history(spark: SparkSession, d: str) -> DataFrame:
    return temporal.history(v.nodes(spark, d)).select(*_COLS)


def _touched(spark: SparkSession, d: str) -> DataFrame:
    n = v.nodes(spark, d)
    return temporal.touched(n, n.where("mem_type = 'working'"), v.now()).select(*_COLS)


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """Events appended as versions of their user."""
    e = table(spark, d, "events").select(F.lit("events").alias("ns"), F.col("user_id").cast("string").alias("id"), F.col("ts").alias("tx_time"), F.lit(None).cast("timestamp_ntz").alias("valid_from"), F.col("event_id").alias("seq"))
    return temporal.number_versions(e).select("id", "seq", "version_no", "valid_from")


def _recent(spark: SparkSession, d: str) -> DataFrame:
    return temporal.recent(v.nodes(spark, d), v.now()).select(*_COLS)


def _retract(by: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        n = v.nodes(spark, d)
        which = F.col("source_id") == "agent:siozeaxfin" if by == "source" else F.array_contains("labels", "Episode")
        return temporal.retracted(n, temporal.latest(n).where(which), v.now()).select("ns", "id", "version_no", "valid_until")

    return run


def _expiry(spark: SparkSession, d: str) -> DataFrame:
    return temporal.expiry_alerts(v.nodes(spark, d), v.now()).select("ns", "id", "version_no", "alert", F.round(hours_between(v.now(), F.col("valid_until")), 6).alias("hours"))


def _trajectory(spark: SparkSession, d: str) -> DataFrame:
    return temporal.trajectory(v.nodes(spark, d)).withColumn("change", F.round("change", 6))


def _fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose latest version carries the fingerprint of a written content and is valid now."""
    w = table(spark, d, "write_requests").where("content is not null").select("write_id", "ns", fingerprint("content").alias("fp")).where("fp <> ''").distinct()
    n = temporal.latest(v.nodes(spark, d)).where(temporal.valid_at(v.now()))
    return w.join(n.select("ns", "id", F.col("fingerprint").alias("fp")), ["ns", "fp"]).select("write_id", "ns", "id", "fp")


def _edges_active(spark: SparkSession, d: str) -> DataFrame:
    return graph.active(v.edges(spark, d), v.now()).groupBy("ns", "edge_type").agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 4).alias("weight"))


def _edges_of_working(direction: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        n = temporal.latest(v.nodes(spark, d)).where("mem_type = 'working'")
        f = graph.edges_from if direction == "from" else graph.edges_to
        return f(v.edges(spark, d), n, v.now(), ["supports", "contradicts"]).select("id", "ns", "src", "dst", "edge_type")

    return run


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    """Seeds of walks: nodes that the label Skill marks in their latest version."""
    return temporal.latest(v.nodes(spark, d)).where(F.array_contains("labels", "Skill")).select("ns", "id")


def _walk(spark: SparkSession, d: str) -> DataFrame:
    return graph.walk(_seeds(spark, d), graph.active(v.edges(spark, d), v.now()), 4)


def _walk_weight(spark: SparkSession, d: str) -> DataFrame:
    return graph.walk(_seeds(spark, d), graph.active(v.edges(spark, d), v.now(), ["supports", "relates_to"], 0.7), 4)


def _walk_paths(spark: SparkSession, d: str) -> DataFrame:
    p = graph.walk_paths(_seeds(spark, d), graph.active(v.edges(spark, d), v.now(), ["supports", "cites"], 0.6), 3)
    return p.select("ns", "seed", "id", "depth", F.array_join("path", ">").alias("path"))


def _subgraph(spark: SparkSession, d: str) -> DataFrame:
    return graph.subgraph(_seeds(spark, d), graph.active(v.edges(spark, d), v.now(), ["cites", "refines"]), 3)[1].select("id", "ns", "src", "dst", "edge_type")


def _inference(spark: SparkSession, d: str) -> DataFrame:
    c = graph.chains(temporal.latest(v.nodes(spark, d)), graph.active(v.edges(spark, d), v.now()), "supports", 20)
    return c.select("ns", "id", "steps", F.round("compound", 12).alias("compound"))


def _provenance(spark: SparkSession, d: str) -> DataFrame:
    return graph.provenance_depth(temporal.latest(v.nodes(spark, d)), graph.active(v.edges(spark, d), v.now()))


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return graph.conflict_clusters(temporal.latest(v.nodes(spark, d)), graph.active(v.edges(spark, d), v.now()))


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    return graph.cascade(_seeds(spark, d), graph.active(v.edges(spark, d), v.now()))


def _context(spark: SparkSession, d: str) -> DataFrame:
    c = graph.context(graph.active(v.edges(spark, d), v.now()))
    return c.groupBy("ns", "id", "relation").agg(F.count("*").alias("neighbours"), F.round(F.sum("weight"), 6).alias("weight"))


QUERIES = {
    "latest": _latest, "as_of": _as_of, "valid_at": _valid_at, "diff": _diff, "history": _history, "touch_node": _touched, "upsert_versions": _numbered, "recent_nodes": _recent,
    "retract_by_source": _retract("source"), "retract_by_label": _retract("label"), "expiry_alerts": _expiry, "trajectory": _trajectory, "get_by_fingerprint": _fingerprints,
    "edges_active": _edges_active, "edges_from": _edges_of_working("from"), "edges_to": _edges_of_working("to"), "walk": _walk, "walk_min_weight": _walk_weight, "walk_paths": _walk_paths,
    "subgraph": _subgraph, "inference_chain": _inference, "provenance_depth": _provenance, "conflict_clusters": _clusters, "cascade_retract": _cascade, "graph_context": _context,
}

_C = ", ".join(_COLS)
_NOW = f"TIMESTAMP '{v.AS_OF}'"
_VALID = "valid_from <= {t} AND (valid_until IS NULL OR {t} <= valid_until)"
_NEWEST = "QUALIFY row_number() OVER (PARTITION BY ns, id ORDER BY version_no DESC) = 1"
_ACT = f"SELECT * FROM e WHERE {_VALID.format(t=_NOW)} AND (invalidated_at IS NULL OR {_NOW} < invalidated_at) AND src IS NOT NULL AND dst IS NOT NULL"
_SEED = "SELECT ns, id FROM latest WHERE list_contains(labels, 'Skill')"
_WALK = "SELECT ns, id, 0 AS depth FROM sd UNION SELECT w.ns, x.dst, w.depth + 1 FROM w JOIN fe x ON x.ns = w.ns AND x.src = w.id WHERE w.depth < {hops}"
_DEPTH = "SELECT ns, id, min(depth) AS depth FROM w GROUP BY 1, 2"
_NEUTRAL = "(CASE WHEN confidence IS NULL OR confidence = 0 THEN 0.5 ELSE confidence END)"
_FP = r"trim(regexp_replace(regexp_replace(lower(content), '[^\p{L}\p{Nd}\s\x{0B}\x{85}\p{Z}]+', '', 'g'), '[\s\x{0B}\x{85}\p{Z}]+', ' ', 'g'))"
_CHAIN = dict(
    act=_ACT,
    up="SELECT ns, {h} AS id, {o} AS parent, weight FROM (SELECT ns, src, dst, id, {w} AS weight FROM act WHERE edge_type = '{k}') WHERE weight > 0 AND src <> dst QUALIFY row_number() OVER (PARTITION BY ns, {h} ORDER BY weight DESC, {o}, id) = 1",
    cf=f"SELECT ns, id, {_NEUTRAL} AS c FROM latest",
    w="SELECT ns, id, id AS cur, 0 AS steps, c AS compound, [id] AS path FROM cf UNION ALL SELECT w.ns, w.id, up.parent, w.steps + 1, w.compound * (up.weight * cf.c), list_append(w.path, up.parent) FROM w JOIN up ON up.ns = w.ns AND up.id = w.cur JOIN cf ON cf.ns = w.ns AND cf.id = up.parent WHERE NOT list_contains(w.path, up.parent) AND w.steps < {m}",
)


def _chain_sql(body: str, kind: str, weight: str, most: int) -> str:
    up = _CHAIN["up"].format(h="dst", o="src", w=weight, k=kind)
    return v.sql(body, recursive=True, act=_CHAIN["act"], up=up, cf=_CHAIN["cf"], w=_CHAIN["w"].format(m=most))


SQL = {
    "latest": v.sql(f"SELECT {_C} FROM latest"),
    "as_of": v.sql(f"SELECT {_C} FROM n WHERE {_VALID.format(t=f'TIMESTAMP {chr(39)}{T2}{chr(39)}')} AND tx_time <= TIMESTAMP '{T2}' {_NEWEST}"),
    "valid_at": v.sql(f"SELECT {_C} FROM (SELECT * FROM n WHERE {_VALID.format(t=_NOW)} {_NEWEST}) WHERE list_contains(labels, 'Fact')"),
    "diff": v.sql(f"SELECT ns, id, version_no, CASE WHEN valid_until <= TIMESTAMP '{T2}' THEN 'removed' WHEN version_no = 1 THEN 'added' ELSE 'modified' END AS change FROM n WHERE tx_time > TIMESTAMP '{T1}' AND tx_time <= TIMESTAMP '{T2}'"),
    "history": v.sql(f"SELECT {_C} FROM n"),
    "touch_node": v.sql(f"SELECT ns, id, version_no + 1 AS version_no, {_NOW} AS tx_time, valid_from, valid_until, confidence FROM latest l WHERE EXISTS (SELECT 1 FROM n WHERE n.ns = l.ns AND n.id = l.id AND n.mem_type = 'working')"),
    "upsert_versions": "SELECT CAST(user_id AS VARCHAR) AS id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version_no, ts AS valid_from FROM events",
    "recent_nodes": v.sql(f"SELECT {_C} FROM (SELECT * FROM n WHERE {_VALID.format(t=_NOW)} {_NEWEST}) ORDER BY coalesce(tx_time, valid_from) DESC, ns, id LIMIT 5"),
    "retract_by_source": v.sql(f"SELECT ns, id, version_no, {_NOW} AS valid_until FROM latest WHERE source_id = 'agent:siozeaxfin' AND {_VALID.format(t=_NOW)}"),
    "retract_by_label": v.sql(f"SELECT ns, id, version_no, {_NOW} AS valid_until FROM latest WHERE list_contains(labels, 'Episode') AND {_VALID.format(t=_NOW)}"),
    "expiry_alerts": v.sql(f"SELECT ns, id, version_no, CASE WHEN h < 24 THEN 'imminent' ELSE 'approaching' END AS alert, round(h, 6) AS hours FROM (SELECT *, (epoch_us(valid_until) - epoch_us({_NOW})) / 3600000000.0 AS h FROM n WHERE {_VALID.format(t=_NOW)} {_NEWEST}) WHERE h < 168"),
    "trajectory": v.sql("SELECT ns, id, version_no, tx_time, confidence, round(confidence - lag(confidence) OVER (PARTITION BY ns, id ORDER BY version_no), 6) AS change FROM n"),
    "get_by_fingerprint": v.sql(f"SELECT x.write_id, x.ns, l.id, x.fp FROM (SELECT DISTINCT write_id, ns, sha256({_FP}) AS fp FROM write_requests WHERE {_FP} <> '') x JOIN latest l ON l.ns = x.ns AND l.fingerprint = x.fp WHERE {_VALID.format(t=_NOW)}"),
    "edges_active": v.sql("SELECT ns, edge_type, count(*) AS edges, round(sum(weight), 4) AS weight FROM act GROUP BY 1, 2", act=_ACT),
    **{f"edges_{k}": v.sql(f"SELECT id, ns, src, dst, edge_type FROM act WHERE edge_type IN ('supports', 'contradicts') AND EXISTS (SELECT 1 FROM latest l WHERE l.mem_type = 'working' AND l.ns = act.ns AND l.id = act.{c})", act=_ACT) for k, c in (("from", "src"), ("to", "dst"))},
    "walk": v.sql(_DEPTH, recursive=True, act=_ACT, sd=_SEED, fe="SELECT * FROM act", w=_WALK.format(hops=3)),
    "walk_min_weight": v.sql(_DEPTH, recursive=True, act=_ACT, sd=_SEED, fe="SELECT * FROM act WHERE edge_type IN ('supports', 'relates_to') AND weight >= 0.7", w=_WALK.format(hops=3)),
    "subgraph": v.sql("SELECT id, ns, src, dst, edge_type FROM fe WHERE EXISTS (SELECT 1 FROM w WHERE w.ns = fe.ns AND w.id = fe.src) AND EXISTS (SELECT 1 FROM w WHERE w.ns = fe.ns AND w.id = fe.dst)", recursive=True, act=_ACT, sd=_SEED, fe="SELECT * FROM act WHERE edge_type IN ('cites', 'refines')", w=_WALK.format(hops=2)),
    "cascade_retract": v.sql(_DEPTH, recursive=True, act=_ACT, sd=_SEED, fe="SELECT * FROM act WHERE edge_type = 'derived_from'", w=_WALK.format(hops=10)),
    "inference_chain": _chain_sql("SELECT ns, id, max(steps) AS steps, round(arg_max(compound, steps), 12) AS compound FROM w GROUP BY 1, 2", "supports", "weight", 20),
    "provenance_depth": _chain_sql("SELECT ns, id, max(steps) AS depth FROM w GROUP BY 1, 2", "derived_from", "greatest(coalesce(weight, 0.0), 1e-9)", 10),
    "conflict_clusters": v.sql(
        f"SELECT ns, component, count(*) AS members, min(c) AS low, max(c) AS high, round(max(c) - min(c), 6) AS gap FROM (SELECT w.ns, w.id, min(w.r) AS component, {_NEUTRAL.replace('confidence', 'any_value(l.confidence)')} AS c FROM w JOIN latest l ON l.ns = w.ns AND l.id = w.id GROUP BY 1, 2) GROUP BY 1, 2 HAVING count(*) >= 2",
        recursive=True, act=_ACT, ce="SELECT ns, src, dst FROM act WHERE edge_type = 'contradicts' AND src <> dst AND EXISTS (SELECT 1 FROM n WHERE n.ns = act.ns AND n.id = act.src) AND EXISTS (SELECT 1 FROM n WHERE n.ns = act.ns AND n.id = act.dst)",
        be="SELECT ns, src, dst FROM ce UNION SELECT ns, dst, src FROM ce", w="SELECT ns, src AS id, src AS r FROM be UNION SELECT w.ns, be.dst, w.r FROM w JOIN be ON be.ns = w.ns AND be.src = w.id"),
    "graph_context": v.sql("SELECT ns, id, relation, count(*) AS neighbours, round(sum(weight), 6) AS weight FROM (SELECT ns, src AS id, 'out:' || edge_type AS relation, weight FROM act UNION ALL SELECT ns, dst, 'in:' || edge_type, weight FROM act) GROUP BY 1, 2, 3", act=_ACT),
}
