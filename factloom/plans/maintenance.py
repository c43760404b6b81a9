"""Queries of writing, compaction, replication, stores, evaluation and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import beta, sm2
from factloom.functions.keys import distinct_strings, trimmed
from factloom.functions.score import clamp, decay_alpha, neutral
from factloom.functions.text import fingerprint
from factloom.functions.temporal import valid_at
from factloom.operators import compaction, evaluation, filters, graph, ingest, replication, review, search, temporal
from factloom.operators import epistemics as ep
from factloom.plans import retrieval
from factloom.plans.epistemic import _ACT, _EFF, _HIST, _SRC, _VALID, feedback
from factloom.plans.history import _FP
from factloom.sources import store
from factloom.sources import views as v
from factloom.sources.tables import table

#: Write requests from here on are the batch, those before the stored corpus.
BATCH = "2025-05-01 00:00:00"
_batch = lambda: F.lit(BATCH).cast("timestamp_ntz")


def _writes(spark, d):
    return table(spark, d, "write_requests")


def _dedup(spark: SparkSession, d: str) -> DataFrame:
    n = temporal.latest(v.nodes(spark, d)).where(valid_at(v.now()))
    return ingest.dedup(_writes(spark, d), n).drop("first")


def _credibility(spark, d):
    return v.sources(spark, d).select("ns", F.col("external_id").alias("source_id"), beta.effective(F.col("labels"), F.col("alpha"), F.col("beta")).alias("credibility"))


def _new_and_stored(spark, d, admitted=True):
    """The batch (admitted=False: also what wasn't admitted, for the gate to judge) and the stored entries."""
    w = _writes(spark, d).select("write_id", "source_id").groupBy("write_id").agg(F.max("source_id").alias("source_id"))
    e = v.vectors(spark, d).join(w, "write_id")
    new = e if admitted else v.vectors(spark, d, admitted=False).join(w, "write_id")
    return new.where(F.col("received_at") >= _batch()), e.where(F.col("received_at") < _batch())


def _admit(spark: SparkSession, d: str) -> DataFrame:
    new, stored = _new_and_stored(spark, d, admitted=False)
    return ingest.admit(new, stored, _credibility(spark, d))


def _admit_in_order(spark: SparkSession, d: str) -> DataFrame:
    new, _ = _new_and_stored(spark, d, admitted=False)
    return ingest.admit_in_order(new, _credibility(spark, d))


def _batch_leaders(spark: SparkSession, d: str) -> DataFrame:
    """Near duplicates within the whole index: who leads whom."""
    e = v.vectors(spark, d).select(F.col("write_id").alias("id"), F.col("ns").alias("scope"), "vec")
    return ingest.first_independent(e, search.pairs_within(e, 0.95, 2.0))


def _facts(spark, d):
    """Vector entries with the labels and validity of their node's latest version."""
    n = temporal.latest(v.nodes(spark, d)).select("ns", F.col("id").alias("node_id"), "labels", "confidence", "valid_from", "valid_until")
    return v.vectors(spark, d).join(n, ["ns", "node_id"]).withColumnRenamed("content", "text").withColumn("id", F.col("write_id"))


def _conflicts(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark, d)
    return ingest.conflict_candidates(f.where(F.col("received_at") >= _batch()), f.where(F.col("received_at") < _batch()))


def _after(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark, d)
    sup = graph.active(v.edges(spark, d), v.now(), ["supports"]).groupBy("ns", F.col("dst").alias("id")).agg(F.count("*").alias("supporters"))
    c = _conflicts(spark, d)
    new = f.select(F.col("write_id").alias("candidate"), F.col("confidence").alias("candidate_confidence"))
    old = f.select(F.col("write_id").alias("existing"), "ns", F.col("node_id").alias("id"), "confidence")
    j = c.join(new, "candidate").join(old, "existing").join(sup, ["ns", "id"], "left").withColumn("supporters", F.coalesce("supporters", F.lit(0)))
    return ingest.confidence_after(j)


def _interference(spark: SparkSession, d: str) -> DataFrame:
    """Contradicts edges whose source is weak while their target is firm and well supported."""
    n = temporal.latest(v.nodes(spark, d)).select("ns", "id", "confidence")
    e = graph.active(v.edges(spark, d), v.now())
    sup = e.where("edge_type = 'supports'").groupBy("ns", F.col("dst").alias("dst")).agg(F.count("*").alias("supporters"))
    c = e.where("edge_type = 'contradicts'").select("id", "ns", "src", "dst")
    j = c.join(n.select("ns", F.col("id").alias("src"), F.col("confidence").alias("weak")), ["ns", "src"]).join(n.select("ns", F.col("id").alias("dst"), F.col("confidence").alias("firm")), ["ns", "dst"]).join(sup, ["ns", "dst"], "left")
    return j.select("id", F.coalesce(ingest.is_interference(F.col("firm"), F.col("weak"), F.coalesce("supporters", F.lit(0))), F.lit(False)).alias("interference"))


def _fold(spark: SparkSession, d: str) -> DataFrame:
    return ingest.feedback_fold(feedback(spark, d).withColumnRenamed("user_id", "id"))


def _jaccard(spark: SparkSession, d: str) -> DataFrame:
    n = temporal.latest(v.nodes(spark, d)).select("ns", "id", "labels")
    e = graph.active(v.edges(spark, d), v.now(), ["contradicts"]).select("id", "ns", "src", "dst")
    j = e.join(n.select("ns", F.col("id").alias("src"), F.col("labels").alias("a")), ["ns", "src"]).join(n.select("ns", F.col("id").alias("dst"), F.col("labels").alias("b")), ["ns", "dst"])
    return j.select("id", F.round(ingest.label_jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


def _bursts(spark: SparkSession, d: str) -> DataFrame:
    return ingest.rate_bursts(table(spark, d, "events"), ["user_id"], 3600, 1)


def _budget(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "event")
    return ingest.budget(e, ["event_type"], 3600, 2).select("event", "within")


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """Parts as claims, related to their brand by its name."""
    p = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    nodes, edges = ingest.claims(p, "s_name", {"n_name": "nation"}, {"n_name": "located_in"})
    return edges.join(nodes.select(F.col("id").alias("src"), "labels"), "src").select("src", "dst", "edge_type", F.array_join("labels", ",").alias("labels"))


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return compaction.leader_clusters(v.vectors(spark, d).select(F.col("write_id").alias("id"), "ns", "vec"))


def _raptor(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark, d).withColumn("confidence", neutral(F.col("confidence")))
    nodes, _ = compaction.summaries(compaction.leader_clusters(f), f)
    return nodes.select("ns", "leader", "members", F.round("confidence", 6).alias("confidence"), F.length("text").alias("chars"), F.round(F.element_at("vec", 1), 6).alias("v1"))


def _consolidate(spark: SparkSession, d: str) -> DataFrame:
    c = compaction.consolidate(temporal.valid_nodes(v.nodes(spark, d), v.now()), v.now())
    return c.withColumn("labels", F.array_join("labels", ","))


def _recall(spark: SparkSession, d: str) -> DataFrame:
    return compaction.recall_cycle(temporal.valid_nodes(v.nodes(spark, d), v.now()), v.now())


def _sm2(spark: SparkSession, d: str) -> DataFrame:
    """State after all of a user's events as reviews of quality event_id % 6."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", (F.col("event_id") % 6).cast("int").alias("q")))).alias("s"))
    s = e.withColumn("s", sm2.fold(F.transform("s", lambda x: x["q"])))
    return s.select("user_id", F.round("s.easiness", 6).alias("easiness"), F.col("s.interval_days").alias("interval_days"), F.col("s.repetitions").alias("repetitions"))


def _erase(spark: SparkSession, d: str) -> DataFrame:
    n, e, g = compaction.erase(["agent:siozeaxfin", "user:pruwend"], v.nodes(spark, d), v.vectors(spark, d), v.edges(spark, d), v.now())
    one = lambda df, what: df.groupBy("ns").agg(F.count("*").alias("n")).withColumn("what", F.lit(what))
    return one(n, "nodes").unionByName(one(e, "vectors")).unionByName(one(g, "edges"))


def _lww(spark: SparkSession, d: str) -> DataFrame:
    n = v.nodes(spark, d).withColumn("origin", F.split_part("source_id", F.lit(":"), F.lit(1)))
    return replication.last_writer(n, ["id"], ["version_no", "tx_time", "origin", "ns"]).select("id", "ns", "version_no", "tx_time", "origin")


def _beta_merge(spark: SparkSession, d: str) -> DataFrame:
    s = v.sources(spark, d).withColumn("kind", F.split_part("external_id", F.lit(":"), F.lit(1)))
    return replication.merge_evidence(s, ["kind"], "id")


def _log(spark, d):
    """Events as a log of three peers; every seventh is processed."""
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("type"), F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("origin"), (F.col("event_id") % 7 == 0).alias("processed"))


_at = lambda s: F.lit(s).cast("timestamp_ntz")


def _anti(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    return replication.missing(log, log.where("id % 5 <> 0"), "id", _at("2024-01-10 00:00:00"), _at("2024-01-11 00:00:00")).select("id", "ts", "origin")


def _since(spark: SparkSession, d: str) -> DataFrame:
    return store.events_since(replication.since(_log(spark, d), _at("2024-01-20 00:00:00"), own="p1"), _at("2024-01-19 23:59:00")).select("id", "ts", "origin")


def _processed(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    return store.mark_processed(log, log.where("type = 'click'")).select("id", "processed")


def _kv(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user as an item that lives (value * 1000) seconds."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("ts", "value"), "event_id").alias("x"))
    items = e.select(F.col("user_id").cast("string").alias("key"), F.col("x.ts").alias("set_at"), store.kv_expiry(F.col("x.ts"), F.floor(F.col("x.value") * 1000)).alias("expires_at"))
    return store.kv_get(items, _at("2024-02-01 00:00:00"))


def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    n = v.nodes(spark, d)
    lines = store.snapshot(n, v.edges(spark, d), v.sources(spark, d), v.now())
    return store.snapshot_report(lines, n.where("tx_time < timestamp_ntz '2025-05-01'"))


def _repair(spark: SparkSession, d: str) -> DataFrame:
    """Valid nodes without an entry in the vector index."""
    n = temporal.valid_nodes(v.nodes(spark, d), v.now()).select("ns", "id")
    return n.join(v.vectors(spark, d).select("ns", F.col("node_id").alias("id")), ["ns", "id"], "left_anti")


def said(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Nodes with `content`, what their last entry says."""
    text = entries.where("node_id is not null").groupBy("ns", F.col("node_id").alias("id")).agg(F.max_by("content", "write_id").alias("content"))
    return nodes.join(text, ["ns", "id"], "left")


def _search(spark: SparkSession, d: str) -> DataFrame:
    return filters.admin_search(said(temporal.valid_nodes(v.nodes(spark, d), v.now()), v.vectors(spark, d)), "Kio")


#: (confidence >= 0.5 or valid before 2025) and not working, with an active edge that cites or supports of weight 0.5 or more, from a source of
#: credibility 0.3 to 1, or a text about a lathe.
TREE = {
    "or": [
        {"and": [{"or": [{"confidenceMin": 0.5}, {"validFromBefore": "2025-01-01"}]}, {"not": {"memType": "working"}}], "edgeTypes": ["cites", "supports"], "edgeWeightMin": 0.5, "sourceCredibilityMin": 0.3, "sourceCredibilityMax": 1.0},
        {"contentContains": "Lathe"},
    ]
}


def _filter(spark: SparkSession, d: str) -> DataFrame:
    n = said(temporal.valid_nodes(v.nodes(spark, d), v.now()), v.vectors(spark, d))
    return filters.matching(n, TREE, v.edges(spark, d), _credibility(spark, d), v.now()).select("ns", "id", "version_no")


def _ratios(spark: SparkSession, d: str) -> DataFrame:
    w = _writes(spark, d).groupBy("write_id").agg(F.max("ns").alias("ns"), F.max("admitted").alias("ok"))
    g = w.groupBy("ns").agg(F.count("*").alias("writes"), F.sum(F.col("ok").cast("bigint")).alias("admitted"))
    return g.select("ns", "writes", F.coalesce("admitted", F.lit(0)).alias("admitted"), F.round(F.coalesce("admitted", F.lit(0)) / F.col("writes"), 6).alias("ratio"))


def _relevant(spark, d):
    """Of each request the entries of cosine 0.9 or more are relevant."""
    q, _, e = retrieval._parts(spark, d)
    near = search.topk(q.select(F.col("retrieve_id").alias("id"), F.col("ns").alias("scope"), "vec"), e.select(F.col("write_id").alias("id"), F.col("ns").alias("scope"), "vec"), retrieval.ALL, 0.9, strict=False)
    return near.join(e.select(F.col("write_id").alias("row"), F.col("node_id").alias("id")), "row").where("id is not null").select("query", "id").distinct()


def _ir(spark: SparkSession, d: str) -> DataFrame:
    r = retrieval.QUERIES["retrieve_general"](spark, d).select(F.col("retrieve_id").alias("query"), "id", "rank")
    return evaluation.ir_metrics(r, _relevant(spark, d), 10)


def _ranking_diff(spark: SparkSession, d: str) -> DataFrame:
    a, b = (retrieval.QUERIES[f"retrieve_{m}"](spark, d).select(F.col("retrieve_id").alias("query"), "id", "rank") for m in ("general", "belief"))
    return evaluation.ranking_diff(a, b)


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    s = v.assertions(spark, d).where("kind in ('supports', 'contradicts') and source_credibility is not null")
    return evaluation.sweep(s.select(clamp(F.col("source_credibility")).alias("score"), (F.col("kind") == "supports").alias("good")), [0.1, 0.3, 0.5, 0.7, 0.9])


def _receipts(spark, d):
    e = table(spark, d, "events").where("event_type in ('purchase', 'error')")
    status = F.element_at(F.array(*[F.lit(x) for x in (0, 429, 500, 503, 404)]), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("event"), (F.col("event_type") == "purchase").alias("ok"), status.alias("status"))


def _retry(spark: SparkSession, d: str) -> DataFrame:
    r = review.retry_recommendations(review.retry_candidates(_receipts(spark, d)), _at("2024-01-31 00:00:00"))
    return r.select("key", "attempts", "last_ts", "status", "delay", "family", "ready")


def _fatigue(spark: SparkSession, d: str) -> DataFrame:
    return review.retry_fatigue(_retry(spark, d))


def _trust(spark: SparkSession, d: str) -> DataFrame:
    f = feedback(spark, d)
    refuted = f.where("outcome = 'refuted'").groupBy("source").agg(F.count("*").alias("n"))
    return review.trust_anomalies(ep.trust_history(f), refuted, 0.1, 0.49, 1_000_000)


def _fingerprints(spark: SparkSession, d: str) -> DataFrame:
    w = _writes(spark, d).select("write_id", fingerprint("content").alias("fp")).distinct()
    return w.groupBy("fp").agg(F.count("*").alias("n"), F.min("write_id").alias("first"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    n = temporal.latest(v.nodes(spark, d))
    l = n.select(F.explode(distinct_strings("labels")).alias("label"), "mem_type")
    return l.groupBy("label").agg(F.count("*").alias("nodes"), F.round(F.avg(decay_alpha(F.col("mem_type"))), 6).alias("decay"))


def _join_source(spark: SparkSession, d: str) -> DataFrame:
    n = temporal.latest(v.nodes(spark, d)).select("ns", "id", trimmed("source_id").alias("source_id"))
    return n.join(_credibility(spark, d), ["ns", "source_id"], "left").groupBy("ns").agg(F.count("*").alias("nodes"), F.count("credibility").alias("known"), F.round(F.avg("credibility"), 6).alias("credibility"))


QUERIES = {
    "dedup_write": _dedup, "admit": _admit, "admit_in_order": _admit_in_order, "near_dup_leaders": _batch_leaders, "detect_conflicts": _conflicts, "conflict_decay": _after, "interference": _interference, "feedback_fold": _fold, "label_jaccard": _jaccard,
    "write_rate_burst": _bursts, "conflict_budget": _budget, "claim_extractor": _claims, "leader_clusters": _clusters, "raptor_compact": _raptor, "consolidate": _consolidate, "recall_cycle": _recall, "sm2_fold": _sm2, "gdpr_erase": _erase,
    "lww_merge": _lww, "beta_merge": _beta_merge, "anti_entropy": _anti, "event_since": _since, "mark_processed": _processed, "kv_ttl": _kv, "snapshot_report": _snapshot, "vector_index_repair": _repair, "admin_search": _search, "graphql_filter": _filter,
    "admin_ratios": _ratios, "ir_metrics": _ir, "ranking_diff": _ranking_diff, "admission_sweep": _sweep, "retry_recommendations": _retry, "retry_fatigue": _fatigue, "source_trust_anomaly": _trust, "content_fingerprint": _fingerprints, "labels": _labels,
    "node_source_join": _join_source,
}

_NOW = f"TIMESTAMP '{v.AS_OF}'"
_B = f"TIMESTAMP '{BATCH}'"
_CR = f"SELECT ns, external_id AS source_id, {_EFF} AS credibility FROM s"
_FA = "SELECT v.write_id, v.ns, v.node_id, v.vec, v.content AS text, v.received_at, l.labels, l.confidence, l.valid_from, l.valid_until FROM v JOIN latest l ON l.ns = v.ns AND l.id = v.node_id"
SAID = "SELECT ns, node_id AS id, arg_max(content, write_id) AS content FROM v WHERE node_id IS NOT NULL GROUP BY 1, 2"
_JAC = "CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_distinct(list_intersect({a}, {b}))) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"
_CON = dict(
    fa=_FA,
    nr=f"SELECT x.write_id AS candidate, y.write_id AS existing, round(list_cosine_similarity(x.vec, y.vec), 9) AS sim FROM fa x JOIN fa y ON x.ns = y.ns WHERE x.received_at >= {_B} AND y.received_at < {_B}",
    n5="SELECT * FROM (SELECT * FROM nr WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY sim DESC, existing) <= 5) WHERE sim >= 0.3 AND sim < 0.95",
    cw=f"SELECT *, round(CASE WHEN j = 0 OR coalesce(ta, '') = coalesce(tb, '') THEN 0.0 ELSE least(1.0, 0.6 * j + CASE WHEN coalesce(ta, '') <> '' AND coalesce(tb, '') <> '' THEN 0.2 ELSE 0.0 END) END, 6) AS weight FROM (SELECT n5.*, x.text AS ta, y.text AS tb, {_JAC.format(a='x.labels', b='y.labels')} AS j, x.confidence AS cc, y.confidence, y.ns, y.node_id AS id FROM n5 JOIN fa x ON x.write_id = candidate JOIN fa y ON y.write_id = existing WHERE (y.valid_until IS NULL OR x.valid_from <= y.valid_until) AND (x.valid_until IS NULL OR y.valid_from <= x.valid_until))",
)
_SUP = "SELECT ns, dst, count(*) AS supporters FROM act WHERE edge_type = 'supports' GROUP BY 1, 2"
_NEU = "(CASE WHEN {x} IS NULL OR {x} = 0 THEN 0.5 ELSE {x} END)"
_LOG = "SELECT event_id AS id, ts, event_type AS type, 'p' || (event_id % 3) AS origin, event_id % 7 = 0 AS processed FROM events"
_DELAY = "least(3600.0, 60 * pow(2.0, least(attempts, 20) - 1))"
_REC = dict(
    rc="SELECT user_id AS key, ts, event_id AS event, event_type = 'purchase' AS ok, [0, 429, 500, 503, 404][event_id % 5 + 1] AS status FROM events WHERE event_type IN ('purchase', 'error')",
    rl="SELECT key, max(event) FILTER (WHERE ok) AS good FROM rc GROUP BY 1",
    rt="SELECT rc.key, count(*) AS attempts, max(ts) AS last_ts, arg_max(status, event) AS status FROM rc JOIN rl ON rl.key = rc.key WHERE NOT ok AND (good IS NULL OR event > good) GROUP BY 1",
    rr=f"SELECT *, {_DELAY} AS delay, CASE WHEN status > 0 THEN CAST(CAST(floor(status / 100) AS BIGINT) AS VARCHAR) || 'xx' ELSE 'network_error' END AS family, epoch_us(TIMESTAMP '2024-01-31 00:00:00') >= epoch_us(last_ts) + CAST({_DELAY} * 1000000 AS BIGINT) AND status IN (0, 408, 425, 429, 500, 502, 503, 504) AS ready FROM rt",
)
_RANK = lambda m: dict(zip(["c0", "c1", "cv", "c2", "k"], [retrieval._CAND.format(q="q"), retrieval._K.format(key="retrieve_id"), retrieval._BEST, "SELECT * FROM cv", retrieval._ranked(retrieval.MODES[m].weights)]))
_Q5 = "0.4 * greatest(0.0, least(1.0, coalesce(confidence, 0.0))) + 0.3 * coalesce(utility, 0.5) + 0.3 * exp(-0.05 * greatest(0.0, (epoch_us({t}) - epoch_us(valid_from)) / 3600000000.0))".format(t=_NOW)
#: Leaders taken one after the other in order of id: the list of those taken so far decides on the next.
_LEAD = lambda least: dict(
    p=f"SELECT * FROM (SELECT a.write_id AS a, b.write_id AS b, round(list_cosine_similarity(a.vec, b.vec), 9) AS s FROM v a JOIN v b ON a.ns = b.ns AND a.write_id < b.write_id) WHERE s >= {least}",
    o="SELECT v.write_id AS id, row_number() OVER (ORDER BY v.write_id) AS i, coalesce(nb, []) AS nb FROM v LEFT JOIN (SELECT b, list(a ORDER BY a) AS nb FROM p GROUP BY 1) x ON x.b = v.write_id",
    w="SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS taken UNION ALL SELECT o.i, CASE WHEN list_has_any(w.taken, o.nb) THEN w.taken ELSE list_append(w.taken, o.id) END FROM w JOIN o ON o.i = w.i + 1",
    ld="SELECT o.id, CASE WHEN list_contains(z.taken, o.id) THEN o.id ELSE list_min(list_filter(o.nb, lambda x: list_contains(z.taken, x))) END AS leader FROM o, (SELECT taken FROM w ORDER BY i DESC LIMIT 1) z",
)
SQL = {
    "near_dup_leaders": v.sql("SELECT id, leader FROM ld", recursive=True, **_LEAD(0.95)),
    # holds while no cluster is larger than 50, the size above which the rest is clustered again
    "leader_clusters": v.sql("SELECT id, leader FROM ld WHERE leader IN (SELECT leader FROM ld GROUP BY 1 HAVING count(*) >= 3)", recursive=True, **_LEAD(0.7)),
    "admit_in_order": v.sql(
        "SELECT write_id, reason = 'admitted' AS admitted, reason FROM w WHERE i > 0", recursive=True, cr=_CR,
        ea="SELECT x.*, w.source_id FROM (" + v.SQL["v"].replace("WHERE admitted AND", "WHERE") + ") x JOIN (SELECT write_id, max(source_id) AS source_id FROM write_requests GROUP BY 1) w ON w.write_id = x.write_id",
        o=f"SELECT ea.write_id, ea.ns, ea.vec, coalesce(cr.credibility, 0.5) AS c, row_number() OVER (PARTITION BY ea.ns ORDER BY ea.received_at, ea.write_id) AS i FROM ea LEFT JOIN cr ON cr.ns = ea.ns AND cr.source_id = ea.source_id WHERE ea.received_at >= {_B}",
        sm="SELECT x.ns, x.i, list(round(list_cosine_similarity(x.vec, y.vec), 9) ORDER BY y.i) AS s FROM o x JOIN o y ON x.ns = y.ns AND y.i < x.i GROUP BY 1, 2",
        w="SELECT DISTINCT ns, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS write_id, CAST(NULL AS VARCHAR) AS reason FROM o UNION ALL SELECT ns, i, CASE WHEN why = 'admitted' THEN list_append(kept, i) ELSE kept END, write_id, why FROM (SELECT *, CASE WHEN c <= 0.05 THEN 'low_credibility' WHEN most >= 0.95 THEN 'near_duplicate' WHEN c * (1 - most) < 0.25 THEN 'below_threshold' ELSE 'admitted' END AS why FROM (SELECT o.ns, o.i, w.kept, o.write_id, o.c, greatest(0.0, coalesce(list_max(list_transform(w.kept, lambda k: sm.s[k])), 0.0)) AS most FROM w JOIN o ON o.ns = w.ns AND o.i = w.i + 1 LEFT JOIN sm ON sm.ns = o.ns AND sm.i = o.i))"),
    "dedup_write": v.sql(f"SELECT w.write_id, w.fp, l.id AS node_id, CASE WHEN l.id IS NOT NULL THEN 'deduplicated' WHEN w.fp IS NOT NULL AND nth > 1 THEN 'repeats' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY ns, fp ORDER BY received_at, write_id) AS nth FROM (SELECT DISTINCT write_id, ns, received_at, CASE WHEN {_FP} <> '' THEN sha256({_FP}) END AS fp FROM write_requests WHERE dedup)) w LEFT JOIN lf l ON l.ns = w.ns AND l.fingerprint = w.fp", lf=f"SELECT ns, fingerprint, min(id) AS id FROM latest WHERE fingerprint <> '' AND valid_from <= {_NOW} AND (valid_until IS NULL OR {_NOW} <= valid_until) GROUP BY 1, 2"),
    "admit": v.sql("SELECT write_id, round(most, 6) AS most_similar, round(c, 6) AS credibility, reason = 'admitted' AS admitted, reason, CASE WHEN reason = 'admitted' THEN round(c, 6) END AS multiplier FROM (SELECT *, CASE WHEN c <= 0.05 THEN 'low_credibility' WHEN most >= 0.95 THEN 'near_duplicate' WHEN c * (1 - most) < 0.25 THEN 'below_threshold' ELSE 'admitted' END AS reason FROM (SELECT x.write_id, coalesce(m.most, 0.0) AS most, coalesce(cr.credibility, 0.5) AS c FROM ea x LEFT JOIN (SELECT a.write_id, max(round(list_cosine_similarity(a.vec, b.vec), 9)) AS most FROM ea a JOIN en b ON a.ns = b.ns WHERE a.received_at >= " + _B + " AND b.received_at < " + _B + " GROUP BY 1 HAVING max(round(list_cosine_similarity(a.vec, b.vec), 9)) > 0) m ON m.write_id = x.write_id LEFT JOIN cr ON cr.ns = x.ns AND cr.source_id = x.source_id WHERE x.received_at >= " + _B + "))", en="SELECT v.*, w.source_id FROM v JOIN (SELECT write_id, max(source_id) AS source_id FROM write_requests GROUP BY 1) w ON w.write_id = v.write_id", ea="SELECT x.*, w.source_id FROM (" + v.SQL["v"].replace("WHERE admitted AND", "WHERE") + ") x JOIN (SELECT write_id, max(source_id) AS source_id FROM write_requests GROUP BY 1) w ON w.write_id = x.write_id", cr=_CR),
    "detect_conflicts": v.sql("SELECT candidate, existing, round(sim, 6) AS similarity, weight FROM cw WHERE weight >= 0.5", **_CON),
    "conflict_decay": v.sql(f"SELECT ns, id, confidence, round(CASE WHEN lost > 0 THEN greatest(0.1, coalesce(confidence, 0.0) - lost) ELSE confidence END, 6) AS after, conflicts FROM (SELECT ns, id, confidence, sum(CASE WHEN {_NEU.format(x='confidence')} >= 0.8 AND {_NEU.format(x='cc')} < 0.4 AND supporters >= 2 THEN 0.0 ELSE weight * coalesce(cc, 0.0) * 0.3 END) AS lost, count(*) AS conflicts FROM (SELECT cw.*, coalesce(su.supporters, 0) AS supporters FROM cw LEFT JOIN su ON su.ns = cw.ns AND su.dst = cw.id WHERE weight >= 0.5) GROUP BY 1, 2, 3)", act=_ACT, su=_SUP, **_CON),
    "interference": v.sql(f"SELECT c.id, {_NEU.format(x='f.confidence')} >= 0.8 AND {_NEU.format(x='w.confidence')} < 0.4 AND coalesce(supporters, 0) >= 2 AS interference FROM act c JOIN latest w ON w.ns = c.ns AND w.id = c.src JOIN latest f ON f.ns = c.ns AND f.id = c.dst LEFT JOIN su ON su.ns = c.ns AND su.dst = c.dst WHERE c.edge_type = 'contradicts'", act=_ACT, su=_SUP),
    "feedback_fold": v.sql(
        "SELECT id, round(arg_max(c, i), 6) AS confidence, round(arg_max(u, i), 6) AS utility, max(i) AS events FROM w GROUP BY 1", recursive=True, fb=_SRC,
        o="SELECT user_id AS id, outcome, row_number() OVER (PARTITION BY user_id ORDER BY ts, event) AS i FROM fb",
        w="SELECT DISTINCT id, CAST(0 AS BIGINT) AS i, CAST(0.5 AS DOUBLE) AS c, CAST(0.5 AS DOUBLE) AS u FROM o UNION ALL SELECT w.id, o.i, CASE o.outcome WHEN 'refuted' THEN 0.05 WHEN 'validated' THEN greatest(0.0, least(1.0, w.c + 0.15)) WHEN 'stale' THEN greatest(0.0, least(1.0, w.c - 0.1)) ELSE w.c END, greatest(0.0, least(1.0, w.u + CASE o.outcome WHEN 'validated' THEN 0.05 WHEN 'refuted' THEN -0.2 WHEN 'useful' THEN 0.15 ELSE -0.25 END)) FROM w JOIN o ON o.id = w.id AND o.i = w.i + 1"),
    "label_jaccard": v.sql(f"SELECT c.id, round({_JAC.format(a='x.labels', b='y.labels')}, 6) AS jaccard FROM act c JOIN latest x ON x.ns = c.ns AND x.id = c.src JOIN latest y ON y.ns = c.ns AND y.id = c.dst WHERE edge_type = 'contradicts'", act=_ACT),
    "write_rate_burst": "SELECT user_id, date_trunc('hour', ts) AS start, count(*) AS n, round(least(1.0, count(*) / 2.0), 6) AS severity FROM events GROUP BY 1, 2 HAVING count(*) > 1",
    "conflict_budget": "SELECT event_id AS event, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) <= 2 AS within FROM events",
    "claim_extractor": "SELECT DISTINCT sha256(trim(regexp_replace(regexp_replace(lower(s_name), '[^\\p{L}\\p{Nd}\\s]+', '', 'g'), '\\s+', ' ', 'g'))) AS src, sha256(trim(regexp_replace(regexp_replace(lower(n_name), '[^\\p{L}\\p{Nd}\\s]+', '', 'g'), '\\s+', ' ', 'g'))) AS dst, 'located_in' AS edge_type, 'nation:' || n_name AS labels FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "consolidate": v.sql(f"SELECT x.ns, nodes, confidence, first, last, labels FROM (SELECT ns, count(*) AS nodes, round(avg(confidence), 6) AS confidence, min(valid_from) AS first, max(valid_from) AS last FROM old GROUP BY 1 HAVING count(*) >= 3) x LEFT JOIN (SELECT ns, string_agg(l, ',' ORDER BY l) AS labels FROM (SELECT DISTINCT ns, l FROM (SELECT ns, unnest(labels) AS l FROM old) WHERE l <> 'Episode') GROUP BY 1) y ON x.ns = y.ns", vn=_VALID, old=f"SELECT * FROM vn WHERE (coalesce(mem_type = 'episodic', false) OR coalesce(list_contains(labels, 'Episode'), false)) AND epoch_us({_NOW}) - epoch_us(valid_from) >= 86400000000"),
    "recall_cycle": v.sql("SELECT ns, id, q AS quality, CAST(1 AS INTEGER) AS interval_days, CAST(round(greatest(1.3, 2.5 + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02)), 6) AS DOUBLE) AS easiness, round(greatest(0.0, least(1.0, coalesce(utility, 0.5) + CASE WHEN q >= 3 THEN 0.05 * q / 5 ELSE -0.02 * (3 - q) END)), 6) AS utility FROM (SELECT *, CASE WHEN s >= 0.9 THEN 5 WHEN s >= 0.7 THEN 4 WHEN s >= 0.5 THEN 3 WHEN s >= 0.3 THEN 2 WHEN s >= 0.1 THEN 1 ELSE 0 END AS q FROM x)", vn=_VALID, x=f"SELECT *, {_Q5} AS s FROM vn"),
    "sm2_fold": v.sql(
        "SELECT user_id, round(arg_max(e, i), 6) AS easiness, arg_max(d, i) AS interval_days, arg_max(r, i) AS repetitions FROM w GROUP BY 1", recursive=True,
        o="SELECT user_id, CAST(event_id % 6 AS INTEGER) AS q, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events",
        w="SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(2.5 AS DOUBLE) AS e, CAST(0 AS INTEGER) AS d, CAST(0 AS INTEGER) AS r FROM o UNION ALL SELECT user_id, i, e2, CAST(CASE WHEN r2 <= 1 THEN 1 WHEN r2 = 2 THEN 6 ELSE floor(d * e2 + 0.5) END AS INTEGER), r2 FROM (SELECT w.user_id, o.i, w.d, greatest(1.3, w.e + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02)) AS e2, CAST(CASE WHEN q < 3 THEN 0 ELSE w.r + 1 END AS INTEGER) AS r2 FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)"),
    "gdpr_erase": v.sql(f"SELECT ns, count(*) AS n, 'nodes' AS what FROM latest WHERE (ns, id) IN (SELECT ns, id FROM mi) AND valid_from <= {_NOW} AND (valid_until IS NULL OR {_NOW} <= valid_until) GROUP BY 1 UNION ALL SELECT ns, count(*), 'vectors' FROM v WHERE (ns, node_id) IN (SELECT ns, id FROM mi) GROUP BY 1 UNION ALL SELECT ns, count(*), 'edges' FROM e WHERE invalidated_at IS NULL AND NOT coalesce(edge_type = 'retracted' AND src = dst, false) AND ((ns, src) IN (SELECT ns, id FROM mi) OR (ns, dst) IN (SELECT ns, id FROM mi)) GROUP BY 1", mi="SELECT ns, id FROM latest WHERE source_id IN ('agent:siozeaxfin', 'user:pruwend')"),
    "lww_merge": v.sql("SELECT id, ns, version_no, tx_time, origin FROM (SELECT *, split_part(source_id, ':', 1) AS origin FROM n) QUALIFY row_number() OVER (PARTITION BY id ORDER BY version_no DESC NULLS LAST, tx_time DESC NULLS LAST, origin DESC NULLS LAST, ns DESC NULLS LAST) = 1"),
    "beta_merge": v.sql("SELECT split_part(external_id, ':', 1) AS kind, round(greatest(1.0, 1 + sum(alpha - 1)), 6) AS alpha, round(greatest(1.0, 1 + sum(beta - 1)), 6) AS beta, count(*) AS peers FROM s GROUP BY 1"),
    "anti_entropy": f"WITH l AS ({_LOG}) SELECT id, ts, origin FROM l WHERE ts > TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-11 00:00:00' AND id % 5 = 0",
    "event_since": f"WITH l AS ({_LOG}) SELECT id, ts, origin FROM l WHERE ts > TIMESTAMP '2024-01-19 23:59:00' AND origin <> 'p1' AND NOT processed",
    "mark_processed": f"WITH l AS ({_LOG}) SELECT id, processed OR type = 'click' AS processed FROM l",
    "kv_ttl": "SELECT * FROM (SELECT CAST(user_id AS VARCHAR) AS key, arg_max(ts, event_id) AS set_at, arg_max(ts, event_id) + to_microseconds(CAST(floor(arg_max(value, event_id) * 1000) AS BIGINT) * 1000000) AS expires_at FROM events GROUP BY user_id) WHERE TIMESTAMP '2024-02-01 00:00:00' <= expires_at",
    "snapshot_report": v.sql("SELECT nodes + edges + sources AS lines, nodes, edges, sources, new, changed, unchanged FROM (SELECT (SELECT count(*) FROM n JOIN al ON al.ns = n.ns AND al.id = n.id) AS nodes, (SELECT count(*) FROM act JOIN al ON al.ns = act.ns AND al.id = act.src) AS edges, (SELECT count(*) FROM s) AS sources), (SELECT CAST(sum(CAST(m IS NULL AS BIGINT)) AS BIGINT) AS new, CAST(sum(CAST(vv <> m AS BIGINT)) AS BIGINT) AS changed, CAST(sum(CAST(vv = m AS BIGINT)) AS BIGINT) AS unchanged FROM (SELECT n.ns, n.id, max(version_no) AS vv, max(CASE WHEN tx_time < TIMESTAMP '2025-05-01' THEN version_no END) AS m FROM n JOIN al ON al.ns = n.ns AND al.id = n.id GROUP BY 1, 2))", act=_ACT, al=f"SELECT ns, id FROM ({_VALID})"),
    "vector_index_repair": v.sql("SELECT ns, id FROM vn WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.ns = vn.ns AND v.node_id = vn.id)", vn=_VALID),
    "admin_search": v.sql("SELECT ns, id, source_id, match_reason FROM (SELECT vn.*, CASE WHEN contains(lower(content), 'kio') THEN 'text' WHEN contains(lower(source_id), 'kio') THEN 'source' WHEN len(list_filter(labels, lambda l: contains(lower(l), 'kio'))) > 0 THEN 'label' WHEN contains(lower(vn.id), 'kio') THEN 'id' END AS match_reason FROM vn LEFT JOIN sd ON sd.ns = vn.ns AND sd.id = vn.id) WHERE match_reason IS NOT NULL ORDER BY tx_time DESC NULLS LAST, id, ns LIMIT 50", vn=_VALID, sd=SAID),
    "graphql_filter": v.sql("SELECT vn.ns, vn.id, version_no FROM vn LEFT JOIN sd ON sd.ns = vn.ns AND sd.id = vn.id WHERE contains(lower(coalesce(content, '')), 'lathe') OR ((confidence >= 0.5 OR valid_from < TIMESTAMP '2025-01-01') AND NOT coalesce(mem_type = 'working', false) AND EXISTS (SELECT 1 FROM act WHERE act.ns = vn.ns AND act.src = vn.id AND edge_type IN ('cites', 'supports') AND weight >= 0.5) AND EXISTS (SELECT 1 FROM cr WHERE cr.ns = vn.ns AND cr.source_id = vn.source_id AND credibility BETWEEN 0.3 AND 1.0))", vn=_VALID, sd=SAID, act=_ACT, cr=_CR),
    "admin_ratios": "SELECT ns, count(*) AS writes, coalesce(CAST(sum(CAST(ok AS BIGINT)) AS BIGINT), 0) AS admitted, round(coalesce(sum(CAST(ok AS BIGINT)), 0) / count(*), 6) AS ratio FROM (SELECT write_id, max(ns) AS ns, max(admitted) AS ok FROM write_requests GROUP BY 1) GROUP BY 1",
    "ir_metrics": v.sql(
        "SELECT rv.retrieve_id AS query, round(coalesce(sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1.0) END), 0.0) / any_value(list_sum(list_transform(range(1, least(nn, 10) + 1), lambda i: 1 / log2(i + 1.0)))), 6) AS ndcg, round(coalesce(sum(CAST(rank <= 10 AS INTEGER)), 0) / any_value(nn), 6) AS recall, round(coalesce(1 / min(rank), 0.0), 6) AS rr, coalesce(sum(CAST(rank <= 10 AS INTEGER)), 0) > 0 AS hit, min(rank) AS first_rank FROM (SELECT *, count(*) OVER (PARTITION BY retrieve_id) AS nn FROM rel) rv LEFT JOIN o ON o.retrieve_id = rv.retrieve_id AND o.id = rv.id GROUP BY 1",
        **_RANK("general"), o=retrieval._OUT, rel=f"SELECT DISTINCT retrieve_id, node_id AS id FROM ({retrieval._ALL}) WHERE sim >= 0.9 AND node_id IS NOT NULL"),
    "ranking_diff": v.sql(
        "SELECT coalesce(a.retrieve_id, b.retrieve_id) AS query, coalesce(a.id, b.id) AS id, a.rank AS before, b.rank AS after, a.rank - b.rank AS moved FROM o a FULL JOIN ob b ON a.retrieve_id = b.retrieve_id AND a.id = b.id WHERE a.rank IS DISTINCT FROM b.rank",
        **_RANK("general"), o=retrieval._OUT, kb=retrieval._ranked(retrieval.MODES["belief"].weights), ob=retrieval._OUT.replace("FROM k ", "FROM kb ")),
    "admission_sweep": v.sql("SELECT CAST(threshold AS DOUBLE) AS threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM (SELECT threshold, CASE WHEN sum(t) > 0 THEN sum(t * g) / sum(t) ELSE 0.0 END AS p, CASE WHEN sum(g) > 0 THEN sum(t * g) / sum(g) ELSE 0.0 END AS r FROM (SELECT threshold, CAST(sc >= threshold AS INTEGER) AS t, g FROM x, (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS threshold)) GROUP BY 1)", x="SELECT round(greatest(0.0, least(1.0, source_credibility)), 6) AS sc, CAST(kind = 'supports' AS INTEGER) AS g FROM a WHERE kind IN ('supports', 'contradicts') AND source_credibility IS NOT NULL"),
    "retry_recommendations": v.sql("SELECT key, attempts, last_ts, status, delay, family, ready FROM rr", **_REC),
    "retry_fatigue": v.sql("SELECT family, count(*) AS candidates, CAST(sum(CAST(ready AS BIGINT)) AS BIGINT) AS ready, CAST(count(*) - sum(CAST(ready AS BIGINT)) AS BIGINT) AS waiting, CAST(sum(attempts) AS BIGINT) AS attempts, max(last_ts) AS last_ts, arg_max(key, (last_ts, key)) AS last_key, arg_max(status, (last_ts, key)) AS last_status FROM rr GROUP BY 1", **_REC),
    "source_trust_anomaly": v.sql("SELECT source, round(f, 6) AS first, round(l, 6) AS last, n AS refutations, round(greatest(CASE WHEN f - l >= 0.1 THEN 0.65 + f - l END, CASE WHEN l <= 0.49 THEN 0.75 + 0.49 - l END), 6) AS priority, CASE WHEN f - l >= 0.1 THEN 'drop' ELSE 'low_trust' END AS kind FROM (SELECT source, arg_min(credibility, (ts, event)) AS f, arg_max(credibility, (ts, event)) AS l FROM h GROUP BY 1) x JOIN (SELECT source, count(*) FILTER (WHERE outcome = 'refuted') AS n FROM fb GROUP BY 1) y USING (source) WHERE f - l >= 0.1 OR l <= 0.49", fb=_SRC, h=_HIST),
    "content_fingerprint": f"SELECT fp, count(*) AS n, min(write_id) AS first FROM (SELECT DISTINCT write_id, CASE WHEN coalesce({_FP}, '') = '' THEN '' ELSE sha256({_FP}) END AS fp FROM write_requests) GROUP BY 1",
    "labels": v.sql("SELECT label, count(*) AS nodes, round(avg(CASE mem_type WHEN 'episodic' THEN 0.08 WHEN 'semantic' THEN 0.02 WHEN 'procedural' THEN 0.001 WHEN 'working' THEN 999.0 ELSE 0.05 END), 6) AS decay FROM (SELECT DISTINCT ns, id, mem_type, label FROM (SELECT ns, id, mem_type, trim(unnest(labels)) AS label FROM latest) WHERE label <> '') GROUP BY 1"),
    "node_source_join": v.sql("SELECT l.ns, count(*) AS nodes, count(credibility) AS known, round(avg(credibility), 6) AS credibility FROM latest l LEFT JOIN cr ON cr.ns = l.ns AND cr.source_id = trim(l.source_id) GROUP BY 1", cr=_CR),
}
