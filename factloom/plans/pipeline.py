"""Queries of the writing pipeline, single stores, schedules and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import hashed_uuid, idempotency_key, node_text, shortened
from factloom.operators import compaction, evaluation, filters, graph, replication, search, temporal
from factloom.operators import epistemics as ep
from factloom.operators import write as wr
from factloom.plans import epistemic, maintenance, retrieval
from factloom.plans.epistemic import _ACT, _EFF, _GAPSQL, _N5, _VALID
from factloom.plans.history import _FP
from factloom.plans.maintenance import _B, _CR, _JAC, _NOW, SAID
from factloom.sources import store
from factloom.sources import views as v
from factloom.sources.tables import table


def _parts(spark: SparkSession, d: str):
    w = table(spark, d, "write_requests").select("write_id", "ns", "content", "source_id", "labels", "vector", "confidence", "valid_from", "mem_type", "dedup", "received_at", "admitted")
    return w.where(F.col("received_at") >= maintenance._batch()), v.nodes(spark, d), v.vectors(spark, d).where(F.col("received_at") < maintenance._batch()), maintenance._credibility(spark, d)


def _written(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return wr.write_batch(*_parts(spark, d), v.now())


def _write(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, d)["results"].withColumn("conflicts", F.array_join("conflicts", ","))


def _write_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, d)["nodes"].select("ns", "id", "version_no", "source_id", "confidence", "fingerprint", "valid_from", "tx_time")


def _write_edges(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, d)["edges"].select("id", "ns", "src", "dst", "edge_type", "weight")


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """Consensus on each node stored as a new version, and read again."""
    n = v.nodes(spark, d)
    t = ep.resolve_truth(temporal.latest(n), graph.active(v.edges(spark, d), v.now()), v.sources(spark, d))
    stored = wr.store_truth(n, t, v.now())
    return wr.load_truth(stored).join(temporal.latest(stored).select("ns", "id", "version_no"), ["ns", "id"])


def _label(spark: SparkSession, d: str) -> DataFrame:
    """The credibility of sources after one got the label flagged."""
    s = v.sources(spark, d)
    from factloom.functions import beta

    out = wr.label_source(s, "harbor/agent", "agent:siozeaxfin", ["flagged"], v.now())
    return out.select("ns", "external_id", F.array_join("labels", ",").alias("labels"), F.round(beta.effective(F.col("labels"), F.col("alpha"), F.col("beta")), 6).alias("credibility"))


def _edge_writes(spark: SparkSession, d: str) -> DataFrame:
    """Edges known by March, after those from then on were written with half their weight again and those of type cites invalidated."""
    e = v.edges(spark, d)
    march = F.lit("2025-03-01").cast("timestamp_ntz")
    old = e.where(F.col("tx_time") < march)
    out = wr.upsert_edges(old, e.where("tx_time is not null").withColumn("weight", F.col("weight") / 2))
    out, _ = wr.invalidate_edges(out, out.where("edge_type = 'cites'"), v.now())
    return out.select("id", "ns", "src", "dst", F.round("weight", 6).alias("weight"), "invalidated_at")


def _index_writes(spark: SparkSession, d: str) -> DataFrame:
    """Entries after those of the batch were indexed anew under later ids' texts and those of two sources dropped."""
    e = v.vectors(spark, d)
    new = e.where(F.col("received_at") >= maintenance._batch()).withColumn("content", F.lit("again"))
    gone = table(spark, d, "write_requests").where("source_id in ('agent:siozeaxfin', 'user:pruwend')")
    return wr.delete_entries(wr.index_entries(e, new), gone).groupBy("ns").agg(F.count("*").alias("entries"), F.sum((F.col("content") == "again").cast("bigint")).alias("again"))


def _self_search(spark: SparkSession, d: str) -> DataFrame:
    n = temporal.valid_nodes(v.nodes(spark, d), v.now())
    return wr.self_search_misses(n, v.vectors(spark, d)).groupBy("ns", "why").agg(F.count("*").alias("nodes"))


def _scan(spark: SparkSession, d: str) -> DataFrame:
    """Nothing is retrieved in a namespace that no request asks in, so its nodes are scanned."""
    q, n, e = retrieval._parts(spark, d)
    found = retrieval.QUERIES["retrieve_general"](spark, d).where("ns = 'nowhere'")
    valid = maintenance.said(temporal.valid_nodes(v.nodes(spark, d), v.now()), e)
    return filters.search_or_scan(found, valid, "Lathe", {"not": {"memType": "working"}}, v.edges(spark, d), maintenance._credibility(spark, d), v.now(), 25)


def _facts(spark: SparkSession, d: str) -> DataFrame:
    n = maintenance.said(temporal.valid_nodes(v.nodes(spark, d), v.now()), v.vectors(spark, d))
    f, marks = compaction.facts(n, v.now())
    return f.join(marks.groupBy("ns").agg(F.count("*").alias("marked")), "ns").select("ns", "nodes", "confidence", "text", "marked")


def _due(spark: SparkSession, d: str) -> DataFrame:
    """A cycle over nodes whose schedule follows from their versions: so many repetitions and days, since the last was written."""
    n = temporal.valid_nodes(v.nodes(spark, d), v.now())
    schedule = n.where("version_no > 1").select("ns", "id", F.lit(2.5).alias("easiness"), F.col("version_no").cast("int").alias("interval_days"), F.col("version_no").cast("int").alias("repetitions"), (F.col("tx_time") + F.make_dt_interval(F.col("version_no").cast("int"))).alias("next_review"))
    return compaction.recall_cycle(n, v.now(), schedule=schedule)


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    e = v.vectors(spark, d).select(F.col("write_id").alias("id"), "ns", "vec", "node_id")
    return ep.gap_details(ep.gaps(e), e, temporal.latest(v.nodes(spark, d)), v.now())


def _acquire(spark: SparkSession, d: str) -> DataFrame:
    return ep.acquisitions(epistemic.QUERIES["active_learning"](spark, d))


def _severity(spark: SparkSession, d: str) -> DataFrame:
    return epistemic.QUERIES["belief_diff"](spark, d).select("id", "gap", ep.contradiction_severity(F.col("gap"), F.col("weight")).alias("severity"))


def _eval(spark: SparkSession, d: str) -> DataFrame:
    """The node nearest to each request should be among its first three results."""
    near = retrieval.QUERIES["vector_topk"](spark, d).join(v.vectors(spark, d).select("write_id", F.col("node_id").alias("id")), "write_id").where("id is not null")
    golden = near.groupBy(F.col("retrieve_id").alias("query")).agg(F.max_by("id", F.struct("similarity", (-F.col("write_id")).alias("w"))).alias("id")).withColumn("cutoff", F.lit(3))
    r = retrieval.QUERIES["retrieve_general"](spark, d).select(F.col("retrieve_id").alias("query"), "id", "rank")
    return evaluation.ranking_eval(r, golden)


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.stats(table(spark, d, "write_requests"), table(spark, d, "retrieve_requests"), table(spark, d, "events").select(F.col("value").alias("latency")))


def _replicate(spark: SparkSession, d: str) -> DataFrame:
    """What was known by May pulls from a peer that has everything."""
    n = v.nodes(spark, d).select("id", "ns", "version_no", "tx_time", F.split_part("source_id", F.lit(":"), F.lit(1)).alias("origin"))
    may = F.lit("2025-05-01").cast("timestamp_ntz")
    out, _ = replication.replicate(n.where(F.col("tx_time") < may), n, may, "agent", ["ns", "id"], ["version_no", "tx_time", "origin"])
    return out


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    """What a snapshot from the seeds of the requests holds."""
    q = v.requests(spark, d).select("ns", F.explode("seed_ids").alias("id"))
    from factloom.functions.keys import uuid_key

    n = v.nodes(spark, d)
    lines = store.snapshot_of(q.select("ns", uuid_key("id").alias("id")).where("id is not null").distinct(), n, v.edges(spark, d), v.sources(spark, d), v.now(), 3)
    return lines.groupBy(F.get_json_object("value", "$.type").alias("type")).agg(F.count("*").alias("lines"))


def _keys(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "write_requests").select("write_id", "ns", "content").distinct()
    return w.select("write_id", idempotency_key("ns", "write_id", "content").alias("key"), shortened(node_text(F.lit(None).cast("string"), "content"), 40).alias("short"), hashed_uuid("ns", "write_id").alias("uuid"))


QUERIES = {
    "write_batch": _write, "write_nodes": _write_nodes, "write_edges": _write_edges, "truth_store": _truth, "label_source": _label, "edge_writes": _edge_writes, "index_writes": _index_writes, "vector_self_search": _self_search, "search_scan": _scan,
    "consolidate_facts": _facts, "recall_due": _due, "knowledge_gaps_top": _gaps, "acquisitions": _acquire, "contradiction_severity": _severity, "ranking_eval": _eval, "db_stats": _stats, "replicate": _replicate, "snapshot_seeds": _seeds, "request_keys": _keys,
}

_UUID = "substr({h},1,8)||'-'||substr({h},9,4)||'-'||substr({h},13,4)||'-'||substr({h},17,4)||'-'||substr({h},21,12)"
_ORDER = ", ".join(f"{c} DESC NULLS LAST" for c in ["ns", "content", "source_id", "array_to_string(labels, chr(31))", "confidence", "valid_from", "mem_type", "dedup", "received_at", "admitted"])
_ID = _UUID.format(h="sha256(coalesce(ns, '') || chr(31) || write_id)")
_WRITE = dict(
    b0=f"SELECT *, CASE WHEN {_FP} <> '' THEN sha256({_FP}) END AS fp, {_ID} AS new_id FROM write_requests WHERE received_at >= {_B} QUALIFY row_number() OVER (PARTITION BY write_id ORDER BY {_ORDER}) = 1",
    cr=_CR, al=f"SELECT * FROM latest WHERE valid_from <= {_NOW} AND (valid_until IS NULL OR {_NOW} <= valid_until)",
    lf="SELECT ns, fingerprint, min(id) AS id FROM al WHERE fingerprint <> '' GROUP BY 1, 2",
    b1="SELECT b0.*, coalesce(cr.credibility, 0.5) AS cred, CASE WHEN coalesce(confidence, 0) = 0 THEN coalesce(cr.credibility, 0.5) ELSE confidence END AS own FROM b0 LEFT JOIN cr ON cr.ns = b0.ns AND cr.source_id = b0.source_id",
    ff="SELECT ns, fp, arg_min(write_id, (received_at, write_id)) AS first FROM b1 WHERE dedup AND fp IS NOT NULL GROUP BY 1, 2",
    b2="SELECT b1.*, lf.id AS old_id, ff.first, CASE WHEN lf.id IS NOT NULL THEN 'deduplicated' WHEN ff.first <> b1.write_id THEN 'repeats' END AS same FROM b1 LEFT JOIN lf ON coalesce(b1.dedup, false) AND lf.ns = b1.ns AND lf.fingerprint = b1.fp LEFT JOIN ff ON coalesce(b1.dedup, false) AND ff.ns = b1.ns AND ff.fp = b1.fp",
    st=f"SELECT v.write_id, v.ns, v.node_id, v.vec, v.content AS text, al.labels, al.valid_from, al.valid_until FROM v JOIN al ON al.ns = v.ns AND al.id = v.node_id WHERE v.received_at < {_B}",
    nr=f"SELECT x.write_id AS candidate, y.write_id AS existing, y.node_id, round(list_cosine_similarity(CAST(x.vector AS DOUBLE[]), y.vec), 9) AS sim, x.content AS ta, y.text AS tb, {_JAC.format(a='x.labels', b='y.labels')} AS j, coalesce(x.valid_from, x.received_at) AS vf, y.valid_until AS yu FROM (SELECT * FROM b2 WHERE same IS NULL AND {v._GOOD}) x JOIN st y ON x.ns = y.ns",
    n5="SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY sim DESC, existing) AS rk FROM nr WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY sim DESC, existing) <= 5",
    jd="SELECT *, CASE WHEN cred <= 0.05 THEN 'low_credibility' WHEN most >= 0.95 THEN 'near_duplicate' WHEN cred * (1 - most) < 0.25 THEN 'below_threshold' ELSE 'admitted' END AS reason FROM (SELECT b2.*, coalesce(n5.sim, 0.0) AS most FROM b2 LEFT JOIN n5 ON n5.candidate = b2.write_id AND rk = 1 WHERE same IS NULL)",
    cw="SELECT candidate, node_id, weight FROM (SELECT *, round(CASE WHEN j = 0 OR coalesce(ta, '') = coalesce(tb, '') THEN 0.0 ELSE least(1.0, 0.6 * j + CASE WHEN coalesce(ta, '') <> '' AND coalesce(tb, '') <> '' THEN 0.2 ELSE 0.0 END) END, 6) AS weight FROM n5 WHERE sim >= 0.3 AND sim < 0.95 AND (yu IS NULL OR vf <= yu)) WHERE weight >= 0.5 AND candidate IN (SELECT write_id FROM jd WHERE reason = 'admitted')",
)
_UPE = dict(
    old="SELECT * FROM e WHERE tx_time < TIMESTAMP '2025-03-01'", nw="SELECT *, weight / 2 AS w2 FROM e WHERE tx_time IS NOT NULL",
    up="SELECT old.id, old.ns, old.src, old.dst, old.edge_type, nw.w2 AS weight, nw.invalidated_at FROM old JOIN nw ON nw.id = old.id UNION ALL SELECT id, ns, src, dst, edge_type, w2, invalidated_at FROM nw WHERE id NOT IN (SELECT id FROM old)",
)
_TRUTH = epistemic._cons("ns, id", "vo")
SQL = {
    "write_batch": v.sql(
        "SELECT write_id, ns, CASE WHEN reason = 'admitted' THEN new_id END AS node_id, reason = 'admitted' AS admitted, reason, CASE WHEN reason = 'admitted' THEN round(own * cred, 6) END AS confidence, coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT node_id AS x FROM cw WHERE candidate = jd.write_id)), '') AS conflicts FROM jd "
        "UNION ALL SELECT write_id, ns, old_id, true, 'deduplicated', NULL, '' FROM b2 WHERE same = 'deduplicated' UNION ALL SELECT b2.write_id, b2.ns, CASE WHEN jd.reason = 'admitted' THEN jd.new_id END, coalesce(jd.reason = 'admitted', false), 'repeats', NULL, '' FROM b2 LEFT JOIN jd ON jd.write_id = b2.first WHERE b2.same = 'repeats'", **_WRITE),
    "write_nodes": v.sql("SELECT ns, new_id AS id, CAST(1 AS BIGINT) AS version_no, source_id, round(own * cred, 6) AS confidence, CASE WHEN dedup THEN fp END AS fingerprint, coalesce(valid_from, received_at) AS valid_from, received_at AS tx_time FROM jd WHERE reason = 'admitted'", **_WRITE),
    "write_edges": v.sql(f"SELECT {_UUID.format(h='h')} AS id, ns, src, dst, 'contradicts' AS edge_type, max(weight) AS weight FROM (SELECT jd.ns, jd.new_id AS src, cw.node_id AS dst, weight, sha256(coalesce(jd.ns, '') || chr(31) || jd.new_id || chr(31) || cw.node_id) AS h FROM cw JOIN jd ON jd.write_id = cw.candidate) GROUP BY h, ns, src, dst", **_WRITE),
    "truth_store": v.sql("SELECT t.ns, t.id, t.truth, t.confidence, l.version_no + 1 AS version_no FROM t JOIN latest l ON l.ns = t.ns AND l.id = t.id", act=_ACT, sc=f"SELECT ns, external_id, {_EFF} AS cr FROM s", vo="SELECT act.ns, act.dst AS id, coalesce(sc.cr, 0.5) AS cr, coalesce(sc.cr, 0.5) AS w, CASE edge_type WHEN 'supports' THEN 1.0 ELSE 0.0 END AS val FROM act JOIN latest l ON l.ns = act.ns AND l.id = act.src LEFT JOIN sc ON sc.ns = act.ns AND sc.external_id = l.source_id WHERE edge_type IN ('supports', 'contradicts')", t=_TRUTH),
    "label_source": v.sql(f"SELECT ns, external_id, array_to_string(labels, ',') AS labels, round({_EFF}, 6) AS credibility FROM x", x="SELECT * REPLACE (CASE WHEN ns = 'harbor/agent' AND external_id = 'agent:siozeaxfin' THEN ['flagged'] ELSE labels END AS labels) FROM s"),
    "edge_writes": v.sql(f"SELECT id, ns, src, dst, round(weight, 6) AS weight, CASE WHEN edge_type = 'cites' THEN {_NOW} ELSE invalidated_at END AS invalidated_at FROM up", **_UPE),
    "index_writes": v.sql(f"SELECT ns, count(*) AS entries, CAST(sum(CAST(received_at >= {_B} OR content = 'again' AS BIGINT)) AS BIGINT) AS again FROM v WHERE write_id NOT IN (SELECT write_id FROM write_requests WHERE source_id IN ('agent:siozeaxfin', 'user:pruwend')) GROUP BY 1"),
    "vector_self_search": v.sql("SELECT ns, why, count(*) AS nodes FROM (SELECT ns, id, 'missing' AS why FROM vn WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.ns = vn.ns AND v.node_id = vn.id) UNION ALL SELECT ns, node_id, 'unfound' FROM own WHERE NOT EXISTS (SELECT 1 FROM nr WHERE nr.write_id = own.write_id AND nr.found = own.node_id)) GROUP BY 1, 2", vn=_VALID,
        own="SELECT v.ns, v.node_id, max(v.write_id) AS write_id, arg_max(v.vec, v.write_id) AS vec FROM v JOIN vn ON vn.ns = v.ns AND vn.id = v.node_id GROUP BY 1, 2", nr="SELECT * FROM (SELECT own.write_id, x.node_id AS found, x.write_id AS row, round(list_cosine_similarity(own.vec, x.vec), 9) AS sim FROM own JOIN v x ON x.ns = own.ns WHERE x.node_id IS NOT NULL) WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY write_id ORDER BY sim DESC, row) <= 10"),
    "search_scan": v.sql("SELECT vn.ns, vn.id, CAST(1 AS DOUBLE) AS score, 'scan' AS path FROM vn LEFT JOIN sd ON sd.ns = vn.ns AND sd.id = vn.id WHERE (contains(lower(coalesce(content, '')), 'lathe') OR contains(lower(coalesce(source_id, '')), 'lathe') OR len(list_filter(coalesce(labels, []), lambda l: contains(lower(l), 'lathe'))) > 0 OR contains(lower(vn.id), 'lathe')) AND NOT coalesce(mem_type = 'working', false) ORDER BY 1, 2 LIMIT 25", vn=_VALID, sd=SAID),
    "consolidate_facts": v.sql("SELECT x.ns, nodes, confidence, 'Consolidated: ' || substr(text, 1, 500) AS text, nodes AS marked FROM x JOIN y ON x.ns = y.ns", vn=_VALID, sd=SAID,
        old=f"SELECT vn.*, sd.content FROM vn LEFT JOIN sd ON sd.ns = vn.ns AND sd.id = vn.id WHERE (coalesce(mem_type = 'episodic', false) OR coalesce(list_contains(labels, 'Episode'), false)) AND epoch_us({_NOW}) - epoch_us(valid_from) >= 86400000000",
        x=f"SELECT ns, count(*) AS nodes, round(avg({_N5}), 6) AS confidence FROM old GROUP BY 1 HAVING count(*) >= 3", y="SELECT ns, string_agg(content, '; ' ORDER BY valid_from, id) AS text FROM old WHERE content <> '' GROUP BY 1"),
    "recall_due": v.sql(
        f"SELECT ns, id, q AS quality, CAST(CASE WHEN r2 <= 1 THEN 1 WHEN r2 = 2 THEN 6 ELSE floor(d * e2 + 0.5) END AS INTEGER) AS interval_days, round(e2, 6) AS easiness, round(greatest(0.0, least(1.0, coalesce(utility, 0.5) + CASE WHEN q >= 3 THEN 0.05 * q / 5 ELSE -0.02 * (3 - q) END)), 6) AS utility, r2 AS repetitions, {_NOW} + to_days(CAST(CASE WHEN r2 <= 1 THEN 1 WHEN r2 = 2 THEN 6 ELSE floor(d * e2 + 0.5) END AS INTEGER)) AS next_review FROM "
        "(SELECT *, greatest(1.3, 2.5 + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02)) AS e2, CAST(CASE WHEN q < 3 THEN 0 ELSE r + 1 END AS INTEGER) AS r2 FROM (SELECT *, CASE WHEN s >= 0.9 THEN 5 WHEN s >= 0.7 THEN 4 WHEN s >= 0.5 THEN 3 WHEN s >= 0.3 THEN 2 WHEN s >= 0.1 THEN 1 ELSE 0 END AS q, CASE WHEN version_no > 1 THEN version_no ELSE 0 END AS r, CASE WHEN version_no > 1 THEN version_no ELSE 0 END AS d FROM x))",
        vn=_VALID, x=f"SELECT *, {maintenance._Q5} AS s FROM vn WHERE version_no <= 1 OR tx_time IS NULL OR tx_time + to_days(CAST(version_no AS INTEGER)) <= {_NOW}"),
    "knowledge_gaps_top": v.sql(
        f"SELECT tp.ns, tp.rank, tp.a, tp.b, tp.density, coalesce(g.confidence, 0.0) AS confidence, coalesce(g.age_hours, 0.0) AS age_hours FROM tp LEFT JOIN (SELECT a, b, round(avg(coalesce(c, 0.5)), 6) AS confidence, round(coalesce(max(age), 0.0), 6) AS age_hours FROM (SELECT nr2.a, nr2.b, {_N5} AS c0, CASE WHEN l.id IS NULL THEN NULL ELSE {_N5} END AS c, greatest(0.0, (epoch_us({_NOW}) - epoch_us(l.valid_from)) / 3600000000.0) AS age FROM nr2 LEFT JOIN latest l ON l.ns = nr2.ns AND l.id = nr2.node_id) GROUP BY 1, 2) g ON g.a = tp.a AND g.b = tp.b",
        **_GAPSQL, tp="SELECT *, row_number() OVER (PARTITION BY ns ORDER BY density, a, b) AS rank FROM gp QUALIFY row_number() OVER (PARTITION BY ns ORDER BY density, a, b) <= 10",
        nr2="SELECT p.a, p.b, p.ns, x.node_id FROM (SELECT p.a, p.b, p.ns, x.write_id, x.node_id, round(list_cosine_similarity(p.mid, x.vec), 9) AS sim FROM pr p JOIN v x ON x.ns = p.ns) x JOIN pr p ON p.a = x.a AND p.b = x.b WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY sim DESC, x.write_id) <= 5"),
    "acquisitions": "SELECT ns, row_number() OVER (PARTITION BY ns ORDER BY priority DESC, kind, id) AS rank, id, kind, priority FROM (" + epistemic.SQL["active_learning"] + ") QUALIFY row_number() OVER (PARTITION BY ns ORDER BY priority DESC, kind, id) <= 10",
    "contradiction_severity": "SELECT id, gap, CASE WHEN gap >= 0.5 OR w >= 0.9 THEN 'high' WHEN gap >= 0.2 OR w >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT *, CASE WHEN coalesce(weight, 0) = 0 THEN 1.0 ELSE weight END AS w FROM (" + epistemic.SQL["belief_diff"] + "))",
    "ranking_eval": v.sql("SELECT count(*) AS queries, round(avg(coalesce(1 / rank, 0.0)), 6) AS mrr, CAST(sum(CAST(coalesce(rank <= 3, false) AS BIGINT)) AS BIGINT) AS passed FROM g LEFT JOIN o ON o.retrieve_id = g.retrieve_id AND o.id = g.id", **maintenance._RANK("general"), o=retrieval._OUT,
        g=f"SELECT retrieve_id, arg_max(node_id, (round(sim, 6), -write_id)) AS id FROM (SELECT * FROM ({retrieval._ALL}) WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY retrieve_id ORDER BY sim DESC, write_id) <= 20) WHERE node_id IS NOT NULL GROUP BY 1"),
    "db_stats": "WITH w AS (SELECT write_id, max(admitted) AS ok FROM write_requests GROUP BY 1), e AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS k FROM events WHERE value IS NOT NULL) SELECT (SELECT count(*) FROM w) AS ingest_total, (SELECT CAST(coalesce(sum(CAST(ok AS BIGINT)), 0) AS BIGINT) FROM w) AS ingest_admitted, (SELECT CAST(count(*) - coalesce(sum(CAST(ok AS BIGINT)), 0) AS BIGINT) FROM w) AS ingest_rejected, (SELECT count(DISTINCT retrieve_id) FROM retrieve_requests) AS retrieval_total, round(avg(value), 6) AS mean, max(CASE WHEN i = floor(0.5 * (k - 1)) THEN value END) AS p50, max(CASE WHEN i = floor(0.95 * (k - 1)) THEN value END) AS p95 FROM e",
    "replicate": v.sql("SELECT id, ns, version_no, tx_time, origin FROM (SELECT * FROM x WHERE tx_time < TIMESTAMP '2025-05-01' UNION ALL SELECT * FROM x WHERE tx_time > TIMESTAMP '2025-04-30 23:59:00' AND NOT coalesce(origin = 'agent', false)) QUALIFY row_number() OVER (PARTITION BY ns, id ORDER BY version_no DESC NULLS LAST, tx_time DESC NULLS LAST, origin DESC NULLS LAST) = 1", x="SELECT id, ns, version_no, tx_time, split_part(source_id, ':', 1) AS origin FROM n"),
    "snapshot_seeds": v.sql(
        "SELECT 'node' AS type, count(*) AS lines FROM n WHERE (ns, id) IN (SELECT ns, id FROM r) UNION ALL SELECT 'edge', count(*) FROM act WHERE (ns, src) IN (SELECT ns, id FROM r) AND (ns, dst) IN (SELECT ns, id FROM r) UNION ALL SELECT 'source', count(*) FROM s WHERE (ns, external_id) IN (SELECT ns, source_id FROM n WHERE (ns, id) IN (SELECT ns, id FROM r))", recursive=True, act=_ACT,
        sd=f"SELECT DISTINCT ns, id FROM (SELECT ns, {v.sql_uuid('x')} AS id FROM (SELECT ns, unnest(seed_ids) AS x FROM q)) WHERE id IS NOT NULL", w="SELECT ns, id, 1 AS lv FROM sd UNION SELECT w.ns, act.dst, w.lv + 1 FROM w JOIN act ON act.ns = w.ns AND act.src = w.id WHERE w.lv < 3", r="SELECT DISTINCT ns, id FROM w"),
    "request_keys": f"SELECT write_id, sha256(coalesce(ns, '') || chr(0) || write_id || chr(0) || coalesce(content, '') || chr(0)) AS key, CASE WHEN len(coalesce(content, '')) > 40 THEN substr(content, 1, 40) || '...' ELSE coalesce(content, '') END AS short, {_ID} AS uuid FROM (SELECT DISTINCT write_id, ns, content FROM write_requests)",
}
