"""Queries of the two general training-data problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import asof
from factloom.sources.tables import table
from factloom.sources.views import _TRIM, sql_uuid


def _seed_events(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "retrieve_requests").select("retrieve_id", "ns", "seed_ids", F.coalesce("as_of", "requested_at").alias("at"))
    return r.select(F.col("retrieve_id").cast("string").alias("event"), "ns", F.explode("seed_ids").alias("entity"), "at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nodes").select("ns", "id", "version_no", "valid_from", "valid_until", "tx_time")
    got = asof.versions_at_events(_seed_events(spark, d), nodes)
    return got.select(F.col("event").cast("bigint").alias("retrieve_id"), F.col("entity").alias("node_id"), "version_no").distinct()


def p1_attributes(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nodes").select("ns", "id", "version_no", "valid_from", "valid_until", "tx_time")
    got = asof.versions_at_events(_seed_events(spark, d), nodes, ["tx_time", "valid_from", "valid_until"])
    return got.select(F.col("event").cast("bigint").alias("retrieve_id"), F.col("entity").alias("node_id"), "version_no", "tx_time", "valid_from", "valid_until").distinct()


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edges").select("id", "ns", "src", "dst", "edge_type", "tx_time")
    nodes = table(spark, d, "nodes").select("id", "ns", "valid_from", "valid_until", "tx_time")
    sources = table(spark, d, "sources").select("id", "created_at")
    return asof.orphan_references(asof.edge_references(edges), asof.edge_targets(nodes, sources))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select(F.col("child").alias("edge_id"), "endpoint").distinct()


def p2_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    return asof.orphan_counts(_orphans(spark, d))


_SPANS = "SELECT ns, id, version_no, tx_time, valid_from, valid_until, greatest(tx_time, coalesce(valid_from, tx_time)) AS b FROM nodes WHERE tx_time IS NOT NULL"
_SEEDS = f"""SELECT DISTINCT retrieve_id, ns, t_at, {sql_uuid("s")} AS node_id FROM (
  SELECT retrieve_id, ns, coalesce(as_of, requested_at) AS t_at, unnest(seed_ids) AS s FROM retrieve_requests) WHERE s IS NOT NULL"""
_REFS = f"""SELECT edge_id, endpoint, tgt, ns, t_at, {sql_uuid("ref")} AS ref FROM (
  SELECT DISTINCT id AS edge_id, 'src' AS endpoint, 'nodes' AS tgt, ns, src AS ref, tx_time AS t_at FROM edges
  UNION SELECT DISTINCT id, 'dst', CASE WHEN edge_type = 'endorsed_by' THEN 'sources' ELSE 'nodes' END, ns, dst, tx_time FROM edges
) WHERE ref IS NOT NULL AND {_TRIM.format(x="ref")} <> ''"""
_MISSING = f"""WITH sp AS ({_SPANS}), r AS ({_REFS}),
nh AS (SELECT DISTINCT r.edge_id, r.endpoint, r.t_at FROM r JOIN sp ON r.tgt = 'nodes' AND r.ns = sp.ns AND r.ref = sp.id AND sp.b <= r.t_at AND (sp.valid_until IS NULL OR r.t_at <= sp.valid_until)),
sh AS (SELECT DISTINCT r.edge_id, r.endpoint, r.t_at FROM r JOIN sources s ON r.tgt = 'sources' AND r.ref = s.id AND s.created_at <= r.t_at),
h AS (SELECT * FROM nh UNION SELECT * FROM sh),
m AS (SELECT r.* FROM r LEFT JOIN h ON r.edge_id = h.edge_id AND r.endpoint = h.endpoint AND r.t_at = h.t_at WHERE h.edge_id IS NULL)"""

QUERIES = {"p1_found": p1_found, "p1_attributes": p1_attributes, "p2_found": p2_found, "p2_orphans_by_month": p2_orphans_by_month}
SQL = {
    "p1_found": f"""WITH sp AS ({_SPANS}), q AS ({_SEEDS})
SELECT q.retrieve_id, q.node_id, max(sp.version_no) AS version_no FROM q JOIN sp ON q.ns = sp.ns AND q.node_id = sp.id
AND sp.b <= q.t_at AND (sp.valid_until IS NULL OR q.t_at <= sp.valid_until) GROUP BY 1, 2""",
    "p1_attributes": f"""WITH sp AS ({_SPANS}), q AS ({_SEEDS}),
v AS (SELECT q.retrieve_id, q.ns, q.node_id, max(sp.version_no) AS version_no FROM q JOIN sp ON q.ns = sp.ns AND q.node_id = sp.id
AND sp.b <= q.t_at AND (sp.valid_until IS NULL OR q.t_at <= sp.valid_until) GROUP BY 1, 2, 3)
SELECT DISTINCT v.retrieve_id, v.node_id, v.version_no, sp.tx_time, sp.valid_from, sp.valid_until FROM v JOIN sp ON v.ns = sp.ns AND v.node_id = sp.id AND v.version_no = sp.version_no""",
    "p2_found": _MISSING + " SELECT DISTINCT edge_id, endpoint FROM m",
    "p2_orphans_by_month": _MISSING + " SELECT tgt AS target, strftime(t_at, '%Y-%m') AS month, count(*) AS orphans, count(DISTINCT edge_id) AS children FROM m GROUP BY 1, 2",
}
