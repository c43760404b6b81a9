"""Queries of belief, credibility and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import beta
from factloom.functions.score import clamp, neutral
from factloom.operators import epistemics as ep
from factloom.operators import graph, search, temporal
from factloom.plans import retrieval
from factloom.sources import views as v
from factloom.sources.tables import table


def _nodes(spark, d):
    return temporal.latest(v.nodes(spark, d))


def _edges(spark, d):
    return graph.active(v.edges(spark, d), v.now())


def _votes(spark, d):
    """Assertions as weighted votes; a credibility that is missing counts 0.5, one out of range its nearest bound."""
    a = v.assertions(spark, d).where("claim is not null and source is not null")
    c = F.coalesce(clamp(F.col("source_credibility")), F.lit(0.5))
    return a.select("assertion_id", "claim", "source", "domain", c.alias("credibility"), (c * ep.epistemic_weight(F.col("epistemic"))).alias("weight"), ep.vote_value(F.col("kind")).alias("value"), "asserted_at")


def _consensus(spark: SparkSession, d: str) -> DataFrame:
    return ep.weighted_consensus(_votes(spark, d), ["claim"])


def _propagation(spark: SparkSession, d: str) -> DataFrame:
    votes = _votes(spark, d)
    return ep.feedback_propagation(votes, ep.weighted_consensus(votes, ["claim"]), 0.3)


def _resolve(spark: SparkSession, d: str) -> DataFrame:
    return ep.resolve_truth(_nodes(spark, d), _edges(spark, d), v.sources(spark, d))


def _credibility(spark: SparkSession, d: str) -> DataFrame:
    return ep.credibility_table(v.sources(spark, d), v.now())


def _domain(spark: SparkSession, d: str) -> DataFrame:
    """Credibility per source and domain: the share of its positions with which the claim's consensus agrees, else its own mean."""
    votes = _votes(spark, d).where("value <> 0.5")
    t = ep.weighted_consensus(_votes(spark, d), ["claim"]).select("claim", "truth")
    right = (F.col("value") >= 0.5) == (F.col("truth") >= 0.5)
    g = votes.join(t, "claim").where("domain is not null").groupBy("source", "domain").agg((1.0 + F.sum(right.cast("int"))).alias("alpha"), (1.0 + F.sum((~right).cast("int"))).alias("beta"))
    return g.select("source", "domain", F.round(beta.mean(F.col("alpha"), F.col("beta")), 6).alias("credibility"))


def _observed(spark: SparkSession, d: str) -> DataFrame:
    """Bayesian updates from all outcomes, weighted by how firm the claim is."""
    votes = _votes(spark, d).where("value <> 0.5")
    t = ep.weighted_consensus(_votes(spark, d), ["claim"])
    w = beta.observation_weight(F.col("confidence"), F.col("sources"), F.lit(False))
    return ep.observed(votes.join(t, "claim").select("source", ((F.col("value") >= 0.5) == (F.col("truth") >= 0.5)).alias("right"), w.alias("weight")))


def _shifted(spark: SparkSession, d: str) -> DataFrame:
    a, b = beta.shifted(F.col("alpha"), F.col("beta"), F.lit(-0.2))
    return v.sources(spark, d).select("id", F.round(a, 6).alias("alpha"), F.round(b, 6).alias("beta"))


def _ucb(spark: SparkSession, d: str) -> DataFrame:
    return ep.ucb_rank(v.sources(spark, d))


def _thompson(spark: SparkSession, d: str) -> DataFrame:
    return ep.thompson(v.sources(spark, d))


def _belief_diff(spark: SparkSession, d: str) -> DataFrame:
    return ep.belief_diff(_nodes(spark, d), _edges(spark, d))


def _health(spark: SparkSession, d: str) -> DataFrame:
    return ep.health(temporal.valid_nodes(v.nodes(spark, d), v.now()), _edges(spark, d))


def _density(spark: SparkSession, d: str) -> DataFrame:
    q, n, e = retrieval._parts(spark, d)
    near = search.topk(q.select(F.col("retrieve_id").alias("id"), F.col("ns").alias("scope"), "vec"), e.select(F.col("write_id").alias("id"), F.col("ns").alias("scope"), "vec"), 10)
    near = near.join(e.select(F.col("write_id").alias("row"), "ns", F.col("node_id").alias("id")), "row").select("query", "ns", "id", "similarity")
    return ep.density(near, n, v.now()).withColumnRenamed("query", "retrieve_id")


def _entries(spark, d):
    return v.vectors(spark, d).select(F.col("write_id").alias("id"), "ns", "vec")


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    return ep.gaps(_entries(spark, d))


def _gap_report(spark: SparkSession, d: str) -> DataFrame:
    return ep.gap_report(ep.gaps(_entries(spark, d)), temporal.valid_nodes(v.nodes(spark, d), v.now()))


def _grounding(spark: SparkSession, d: str) -> DataFrame:
    q = v.requests(spark, d).select(F.col("retrieve_id").alias("id"), F.col("ns").alias("scope"), "vec")
    return ep.grounding(q, _entries(spark, d).select("id", F.col("ns").alias("scope"), "vec"))


def _active(spark: SparkSession, d: str) -> DataFrame:
    return ep.active_learning(temporal.valid_nodes(v.nodes(spark, d), v.now()), _edges(spark, d), v.now())


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return ep.support_matrix(_nodes(spark, d), _edges(spark, d))


def _echo(spark: SparkSession, d: str) -> DataFrame:
    return ep.echo_chambers(_nodes(spark, d), _edges(spark, d), 1, 0.1)


def feedback(spark: SparkSession, d: str) -> DataFrame:
    """Events as feedback: purchases validate, errors refute, clicks are useful, views are stale."""
    kind = F.when(F.col("event_type") == "purchase", "validated").when(F.col("event_type") == "error", "refuted").when(F.col("event_type") == "click", "useful").when(F.col("event_type") == "view", "stale")
    return table(spark, d, "events").select(F.col("event_id").alias("event"), "ts", "user_id", F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"), kind.alias("outcome"), "value").where("outcome is not null")


def _timeline(spark: SparkSession, d: str) -> DataFrame:
    return ep.trust_history(feedback(spark, d)).withColumn("credibility", F.round("credibility", 6))


def _drops(spark: SparkSession, d: str) -> DataFrame:
    return ep.credibility_drops(ep.trust_history(feedback(spark, d)), 0.01)


def _bursts(spark: SparkSession, d: str) -> DataFrame:
    """Daily totals of all users' feedback as snapshots."""
    h = feedback(spark, d).groupBy(F.col("user_id").cast("string").alias("source"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("source").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return ep.activity_bursts(h.select("source", "ts", total.alias("total")), 2.0)


def _outcomes(spark, d):
    return v.assertions(spark, d).where("kind in ('supports', 'contradicts') and source_credibility is not null").select(clamp(F.col("source_credibility")).alias("predicted"), (F.col("kind") == "supports").cast("int").alias("actual"))


def _calibration(spark: SparkSession, d: str) -> DataFrame:
    return ep.calibration(_outcomes(spark, d))


def _bins(spark: SparkSession, d: str) -> DataFrame:
    return ep.calibration_bins(_outcomes(spark, d)).select("bin", "n", F.round("p", 6).alias("predicted"), F.round("a", 6).alias("actual"))


def _platt(spark: SparkSession, d: str) -> DataFrame:
    return ep.platt(_outcomes(spark, d)).groupBy(F.round("predicted", 2).alias("predicted")).agg(F.round(F.avg("calibrated"), 6).alias("calibrated"))


def _isotonic(spark: SparkSession, d: str) -> DataFrame:
    return ep.isotonic(_outcomes(spark, d)).groupBy(F.round("predicted", 2).alias("predicted")).agg(F.round(F.avg("calibrated"), 6).alias("calibrated"))


def _score_report(spark: SparkSession, d: str) -> DataFrame:
    return ep.quantiles(_nodes(spark, d).select("ns", neutral(F.col("confidence")).alias("c")), "c", ["ns"])


BOUNDS = [0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def _histogram(spark: SparkSession, d: str) -> DataFrame:
    return ep.histogram(_nodes(spark, d).select(clamp(F.col("confidence")).alias("c")), "c", BOUNDS)


def _audit(spark: SparkSession, d: str) -> DataFrame:
    n = v.nodes(spark, d)
    return ep.audit(temporal.latest(n), _edges(spark, d), v.sources(spark, d), n)


def _narrative(spark: SparkSession, d: str) -> DataFrame:
    return ep.narrative(_audit(spark, d))


QUERIES = {
    "consensus": _consensus, "feedback_propagation": _propagation, "resolve_truth": _resolve, "source_credibility": _credibility, "domain_credibility": _domain, "bayesian_update": _observed, "update_credibility": _shifted,
    "ucb_rank": _ucb, "thompson_sample": _thompson, "belief_diff": _belief_diff, "health": _health, "density": _density, "knowledge_gaps": _gaps, "gap_report": _gap_report, "grounding": _grounding, "active_learning": _active,
    "support_matrix": _matrix, "echo_chambers": _echo, "trust_timeline": _timeline, "source_anomaly_drop": _drops, "source_anomaly_burst": _bursts, "calibration": _calibration, "calibration_bins": _bins, "platt_fit": _platt, "isotonic_fit": _isotonic,
    "score_report": _score_report, "histogram": _histogram, "audit": _audit, "narrative": _narrative,
}

_NOW = f"TIMESTAMP '{v.AS_OF}'"
_ACT = f"SELECT * FROM e WHERE valid_from <= {_NOW} AND (valid_until IS NULL OR {_NOW} <= valid_until) AND (invalidated_at IS NULL OR {_NOW} < invalidated_at) AND src IS NOT NULL AND dst IS NOT NULL"
_VALID = f"SELECT * FROM n WHERE valid_from <= {_NOW} AND (valid_until IS NULL OR {_NOW} <= valid_until) QUALIFY row_number() OVER (PARTITION BY ns, id ORDER BY version_no DESC) = 1"
_N5 = "(CASE WHEN confidence IS NULL OR confidence = 0 THEN 0.5 ELSE confidence END)"
_EFF = "coalesce(list_filter(list_transform(labels, lambda l: CASE WHEN l IN ('moderator', 'admin') THEN 1.0 WHEN l IN ('flagged', 'troll') THEN 0.05 END), lambda y: y IS NOT NULL)[1], CASE WHEN alpha + beta = 0 THEN 0.5 ELSE alpha / (alpha + beta) END)"
_VOTE = """SELECT assertion_id, claim, source, domain, cr, cr * (CASE epistemic WHEN 'observation' THEN 0.6 WHEN 'inference' THEN 0.8 ELSE 1.0 END) AS w, CASE kind WHEN 'supports' THEN 1.0 WHEN 'contradicts' THEN 0.0 ELSE 0.5 END AS val
FROM (SELECT *, coalesce(greatest(0.0, least(1.0, source_credibility)), 0.5) AS cr FROM a WHERE claim IS NOT NULL AND source IS NOT NULL)"""


def _cons(key: str, src: str) -> str:
    return f"""SELECT {key}, round(CASE WHEN w > 0 THEN wv / w ELSE 0.5 END, 6) AS truth, round(CASE WHEN w > 0 THEN 1 - least(4 * (cvv - 2 * wv / w * cv + wv / w * wv / w * c) / w, 1.0) ELSE 0.0 END, 6) AS confidence, sources FROM (
SELECT {key}, sum(w) AS w, sum(w * val) AS wv, sum(cr) AS c, sum(cr * val) AS cv, sum(cr * val * val) AS cvv, count(*) AS sources FROM {src} GROUP BY {key})"""


_TRUTH = _cons("claim", "vo")
_SIDE = f"SELECT l.ns, l.id, {_N5} AS conf, source_id, coalesce(supporters, 0) AS supporters FROM latest l LEFT JOIN (SELECT ns, dst, count(*) AS supporters FROM act WHERE edge_type = 'supports' GROUP BY 1, 2) s ON s.ns = l.ns AND s.dst = l.id"
_SRC = "SELECT event_id AS event, ts, user_id, 'src' || (user_id % 20) AS source, CASE event_type WHEN 'purchase' THEN 'validated' WHEN 'error' THEN 'refuted' WHEN 'click' THEN 'useful' WHEN 'view' THEN 'stale' END AS outcome FROM events WHERE event_type IN ('purchase', 'error', 'click', 'view')"
_HIST = "SELECT source, ts, event, alpha, beta, alpha / (alpha + beta) AS credibility FROM (SELECT source, ts, event, CAST(1 + sum(CASE WHEN outcome = 'validated' THEN 1 ELSE 0 END) OVER o AS DOUBLE) AS alpha, CAST(1 + sum(CASE WHEN outcome = 'refuted' THEN 1 ELSE 0 END) OVER o AS DOUBLE) AS beta FROM fb WHERE outcome IN ('validated', 'refuted') WINDOW o AS (PARTITION BY source ORDER BY ts, event ROWS UNBOUNDED PRECEDING))"
_OUTC = "SELECT greatest(0.0, least(1.0, source_credibility)) AS predicted, CAST(kind = 'supports' AS INTEGER) AS actual FROM a WHERE kind IN ('supports', 'contradicts') AND source_credibility IS NOT NULL"
_BINS = "SELECT CAST(least(floor(predicted * 10), 9) AS BIGINT) AS bin, count(*) AS n, avg(predicted) AS p, avg(CAST(actual AS DOUBLE)) AS act FROM oc GROUP BY 1"
_MAT = "SELECT act.ns, x.source_id AS a, y.source_id AS b, count(*) AS n FROM act JOIN latest x ON x.ns = act.ns AND x.id = act.src JOIN latest y ON y.ns = act.ns AND y.id = act.dst WHERE edge_type = 'supports' AND x.source_id <> y.source_id GROUP BY 1, 2, 3"
_GAPSQL = dict(
    en="SELECT write_id AS id, ns, vec FROM v", sm="SELECT * FROM en QUALIFY row_number() OVER (PARTITION BY ns ORDER BY id) <= 20",
    pr="SELECT * FROM (SELECT a.id AS a, b.id AS b, a.ns, round(list_cosine_similarity(a.vec, b.vec), 9) AS s, list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] + z[2]) / 2) AS mid FROM sm a JOIN sm b ON a.ns = b.ns AND a.id < b.id) WHERE s >= 0.1 AND s < 0.6 + 1e-9",
    nr="SELECT a, b, ns, s, sim FROM (SELECT p.a, p.b, p.ns, p.s, x.id, round(list_cosine_similarity(p.mid, x.vec), 9) AS sim FROM pr p JOIN en x ON x.ns = p.ns) WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY sim DESC, id) <= 5",
    gp="SELECT pr.ns, pr.a, pr.b, round(pr.s, 6) AS similarity, coalesce(dn, 0.0) AS density FROM pr LEFT JOIN (SELECT a, b, round(avg(sim), 6) AS dn FROM nr GROUP BY 1, 2) g ON g.a = pr.a AND g.b = pr.b WHERE coalesce(dn, 0.0) < 0.5",
)
_UP = "SELECT ns, dst AS id, src AS parent FROM act WHERE edge_type = 'derived_from' AND src <> dst QUALIFY row_number() OVER (PARTITION BY ns, dst ORDER BY greatest(coalesce(weight, 0.0), 1e-9) DESC, src, id) = 1"
_AUD = dict(
    act=_ACT, up=_UP,
    w="SELECT ns, id, id AS cur, 0 AS steps, [id] AS path FROM latest UNION ALL SELECT w.ns, w.id, up.parent, w.steps + 1, list_append(w.path, up.parent) FROM w JOIN up ON up.ns = w.ns AND up.id = w.cur JOIN latest l ON l.ns = w.ns AND l.id = up.parent WHERE NOT list_contains(w.path, up.parent) AND w.steps < 10",
    dp="SELECT ns, id, max(steps) AS depth FROM w GROUP BY 1, 2", su="SELECT ns, dst AS id, count(*) AS supporters FROM act WHERE edge_type = 'supports' GROUP BY 1, 2",
    co="SELECT ns, id, count(*) AS contradictors FROM (SELECT ns, dst AS id FROM act WHERE edge_type = 'contradicts' UNION ALL SELECT ns, src FROM act WHERE edge_type = 'contradicts') GROUP BY 1, 2",
    hi="SELECT ns, id, count(*) AS versions, arg_max_null(confidence, version_no) - arg_min_null(confidence, version_no) AS trend FROM n GROUP BY 1, 2",
    sc=f"SELECT ns, external_id, round({_EFF}, 6) AS credibility FROM s",
    au="SELECT l.ns, l.id, l.source_id, l.confidence, sc.credibility, coalesce(supporters, 0) AS supporters, coalesce(contradictors, 0) AS contradictors, coalesce(depth, 0) AS depth, versions, round(trend, 6) AS trend FROM latest l LEFT JOIN sc ON sc.ns = l.ns AND sc.external_id = l.source_id LEFT JOIN su ON su.ns = l.ns AND su.id = l.id LEFT JOIN co ON co.ns = l.ns AND co.id = l.id LEFT JOIN dp ON dp.ns = l.ns AND dp.id = l.id LEFT JOIN hi ON hi.ns = l.ns AND hi.id = l.id",
)
_le = [f"CAST(sum(CASE WHEN c <= {b} THEN 1 ELSE 0 END) AS BIGINT) AS le_{i}" for i, b in enumerate(BOUNDS)]
_pct = lambda p: "CAST(CASE " + " ".join(f"WHEN le_{i} >= ceil({p} * n) THEN {b}" for i, b in enumerate(BOUNDS)) + " END AS DOUBLE)"
_AGE = "exp(-0.001 * greatest(0.0, (epoch_us({t}) - epoch_us({x})) / 3600000000.0))"
SQL = {
    "consensus": v.sql(_TRUTH, vo=_VOTE),
    "feedback_propagation": v.sql("SELECT vo.source, round(sum(CASE WHEN (val >= 0.5) = (truth >= 0.5) THEN confidence ELSE 0.0 END), 6) AS alpha, round(sum(CASE WHEN (val >= 0.5) = (truth >= 0.5) THEN 0.0 ELSE confidence END), 6) AS beta, count(*) AS claims FROM vo JOIN t USING (claim) WHERE val <> 0.5 AND confidence >= 0.3 GROUP BY 1", vo=_VOTE, t=_TRUTH),
    "resolve_truth": v.sql(_cons("ns, id", "vo"), act=_ACT, sc=f"SELECT ns, external_id, {_EFF} AS cr FROM s", vo="SELECT act.ns, act.dst AS id, coalesce(sc.cr, 0.5) AS cr, coalesce(sc.cr, 0.5) AS w, CASE edge_type WHEN 'supports' THEN 1.0 ELSE 0.0 END AS val FROM act JOIN latest l ON l.ns = act.ns AND l.id = act.src LEFT JOIN sc ON sc.ns = act.ns AND sc.external_id = l.source_id WHERE edge_type IN ('supports', 'contradicts')"),
    "source_credibility": v.sql(
        f"SELECT id, ns, round(eff, 6) AS effective, round(m, 6) AS mean, round(va, 6) AS variance, round(greatest(0.0, eff - z * sqrt(va)), 6) AS low, round(least(1.0, eff + z * sqrt(va)), 6) AS high, round((1 + (alpha - 1) * f) / (2 + (alpha - 1) * f + (beta - 1) * f), 6) AS decayed FROM x",
        x=f"SELECT *, {_EFF} AS eff, CASE WHEN alpha + beta = 0 THEN 0.5 ELSE alpha / (alpha + beta) END AS m, CASE WHEN alpha + beta = 0 THEN 0.25 ELSE alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)) END AS va, CASE WHEN claims_asserted < 10 THEN 1.96 * 1.5 ELSE 1.96 END AS z, exp(-0.001 * greatest(0.0, (epoch_us({_NOW}) - epoch_us(updated_at)) / 3600000000.0)) AS f FROM s"),
    "domain_credibility": v.sql("SELECT source, domain, round((1.0 + sum(CAST(r AS INTEGER))) / (2.0 + count(*)), 6) AS credibility FROM (SELECT vo.source, vo.domain, (val >= 0.5) = (truth >= 0.5) AS r FROM vo JOIN t USING (claim) WHERE val <> 0.5 AND domain IS NOT NULL) GROUP BY 1, 2", vo=_VOTE, t=_TRUTH),
    "bayesian_update": v.sql("SELECT source, round(1 + sum(CASE WHEN r THEN w ELSE 0.0 END), 6) AS alpha, round(1 + sum(CASE WHEN r THEN 0.0 ELSE w END), 6) AS beta FROM (SELECT vo.source, (val >= 0.5) = (truth >= 0.5) AS r, greatest(0.1, least(10.0, (0.5 + confidence) * (CASE WHEN sources > 1 THEN 1 + 0.2 * least(sources - 1, 5) ELSE 1.0 END))) AS w FROM vo JOIN t USING (claim) WHERE val <> 0.5) GROUP BY 1", vo=_VOTE, t=_TRUTH),
    "update_credibility": v.sql("SELECT id, round(greatest(1.0, alpha), 6) AS alpha, round(greatest(1.0, beta + 2.0), 6) AS beta FROM s"),
    "ucb_rank": v.sql("SELECT id, round(m + sqrt(2 * ln(total) / greatest(claims_asserted, 1)), 6) AS ucb, round(m, 6) AS mean FROM x, (SELECT greatest(sum(claims_asserted), 1) AS total FROM s)", x=f"SELECT *, {_EFF} AS m FROM s"),
    "belief_diff": v.sql("SELECT c.id, c.ns, c.src, c.dst, c.weight, a.conf AS conf_a, a.source_id AS source_id_a, a.supporters AS supporters_a, b.conf AS conf_b, b.source_id AS source_id_b, b.supporters AS supporters_b, round(abs(a.conf - b.conf), 6) AS gap FROM act c JOIN sd a ON a.ns = c.ns AND a.id = c.src JOIN sd b ON b.ns = c.ns AND b.id = c.dst WHERE c.edge_type = 'contradicts' AND c.src <> c.dst", act=_ACT, sd=_SIDE),
    "health": v.sql(f"SELECT ns, nodes, sources, conflicts, round(c, 6) AS confidence, round(greatest(0.0, least(1.0, 0.35 * c + 0.25 + 0.2 * (1 - conflicts / nodes) + 0.2 * least(1.0, sources / nodes))), 6) AS overall FROM (SELECT vn.ns, count(*) AS nodes, avg({_N5}) AS c, count(x.id) AS conflicts, count(DISTINCT nullif(source_id, '')) AS sources FROM vn LEFT JOIN (SELECT DISTINCT ns, src AS id FROM act WHERE edge_type = 'contradicts') x ON x.ns = vn.ns AND x.id = vn.id GROUP BY 1)", act=_ACT, vn=_VALID),
    "density": v.sql(f"SELECT retrieve_id, count(*) AS local, round(avg(sim), 6) AS similarity, round(min(sim), 6) AS least, round(avg(c), 6) AS confidence, round(stddev_pop(c), 6) AS spread, round(avg(fr), 6) AS freshness, round(avg(sim), 6) < 0.5 OR count(*) < 3 AS sparse FROM (SELECT k.retrieve_id, k.sim, {_N5} AS c, {_AGE.format(t=_NOW, x='valid_from')} AS fr FROM k JOIN latest l ON l.ns = k.ns AND l.id = k.node_id) GROUP BY 1",
                     c0="SELECT q.retrieve_id, q.ns, v.write_id, v.node_id, round(list_cosine_similarity(q.vec, v.vec), 9) AS sim FROM q JOIN v ON q.ns = v.ns", k="SELECT * FROM c0 WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY retrieve_id ORDER BY sim DESC, write_id) <= 10"),
    "knowledge_gaps": v.sql("SELECT * FROM gp", **_GAPSQL),
    "gap_report": v.sql("SELECT x.ns, nodes, coalesce(g, 0) AS gaps, round(greatest(0.0, 1 - coalesce(g, 0) / nodes), 6) AS coverage FROM (SELECT ns, count(*) AS nodes FROM vn GROUP BY 1) x LEFT JOIN (SELECT ns, count(*) AS g FROM gp GROUP BY 1) y ON x.ns = y.ns", vn=_VALID, **_GAPSQL),
    "grounding": v.sql("SELECT q.retrieve_id AS claim, k.write_id AS best, round(sim, 6) AS similarity, coalesce(round(sim, 6) >= 0.7, false) AS grounded FROM q LEFT JOIN (SELECT * FROM c0 QUALIFY row_number() OVER (PARTITION BY retrieve_id ORDER BY sim DESC, write_id) = 1) k ON k.retrieve_id = q.retrieve_id", c0="SELECT q.retrieve_id, v.write_id, round(list_cosine_similarity(q.vec, v.vec), 9) AS sim FROM q JOIN v ON q.ns = v.ns"),
    "active_learning": v.sql(f"SELECT ns, id, 'low_confidence' AS kind, round(1 - c, 6) AS priority FROM x WHERE c < 0.4 UNION ALL SELECT ns, id, 'refresh_stale', round(1 - l / 168, 6) FROM x WHERE l > 0 AND l < 168 UNION ALL SELECT x.ns, x.id, 'verify_claim', 0.7 FROM x WHERE c >= 0.7 AND age > 720 AND EXISTS (SELECT 1 FROM act WHERE edge_type = 'contradicts' AND act.ns = x.ns AND act.src = x.id)",
                             act=_ACT, vn=_VALID, x=f"SELECT ns, id, {_N5} AS c, (epoch_us(valid_until) - epoch_us({_NOW})) / 3600000000.0 AS l, (epoch_us({_NOW}) - epoch_us(valid_from)) / 3600000000.0 AS age FROM vn"),
    "support_matrix": v.sql("SELECT * FROM m", act=_ACT, m=_MAT),
    "echo_chambers": v.sql("SELECT *, round(mutual / (mutual + 8.0), 6) AS confidence FROM (SELECT x.ns, x.a AS seed, count(*) AS partners, CAST(sum(x.n + y.n) AS BIGINT) AS mutual FROM m x JOIN m y ON x.ns = y.ns AND x.a = y.b AND x.b = y.a WHERE x.a < x.b GROUP BY 1, 2) WHERE round(mutual / (mutual + 8.0), 6) >= 0.1", act=_ACT, m=_MAT),
    "trust_timeline": v.sql("SELECT source, ts, event, alpha, beta, round(credibility, 6) AS credibility FROM h", fb=_SRC, h=_HIST),
    "source_anomaly_drop": v.sql("SELECT source, round(dr, 6) AS drop, round(least(2 * dr, 1.0), 6) AS severity FROM (SELECT source, (sum(credibility) - arg_max(credibility, (ts, event))) / (count(*) - 1) - arg_max(credibility, (ts, event)) AS dr FROM h GROUP BY 1 HAVING count(*) >= 2) WHERE round(dr, 6) >= 0.01", fb=_SRC, h=_HIST),
    "source_anomaly_burst": v.sql("SELECT source, round(rate, 6) AS rate, round(bl, 6) AS baseline, round(least(1.0, rate / bl / 5), 6) AS severity FROM (SELECT source, CAST(sum(CASE WHEN back = 1 THEN step END) AS BIGINT) AS rate, avg(CASE WHEN back > 2 THEN step END) AS bl, count(*) AS n FROM t2 GROUP BY 1) WHERE n >= 4 AND bl > 0 AND rate > 2.0 * bl",
        fb=_SRC, t1="SELECT source, ts, sum(n) OVER (PARTITION BY source ORDER BY ts) AS total FROM (SELECT CAST(user_id AS VARCHAR) AS source, date_trunc('day', ts) AS ts, count(*) AS n FROM fb GROUP BY 1, 2)", t2="SELECT source, ts, total - lag(total) OVER (PARTITION BY source ORDER BY ts) AS step, row_number() OVER (PARTITION BY source ORDER BY ts DESC) AS back FROM t1"),
    "calibration": v.sql("SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(p - act)) / sum(n), 6) AS ece, round(max(abs(p - act)), 6) AS mce, (SELECT round(avg(pow(predicted - actual, 2)), 6) FROM oc) AS brier FROM b", oc=_OUTC, b=_BINS),
    "calibration_bins": v.sql("SELECT bin, n, round(p, 6) AS predicted, round(act, 6) AS actual FROM b", oc=_OUTC, b=_BINS),
    "score_report": v.sql("SELECT ns, count(*) AS n, min(c) AS min, max(c) AS max, round(avg(c), 6) AS mean, max(CASE WHEN i = floor(0.5 * (k - 1)) THEN c END) AS p50, max(CASE WHEN i = floor(0.95 * (k - 1)) THEN c END) AS p95 FROM (SELECT ns, c, row_number() OVER (PARTITION BY ns ORDER BY c) - 1 AS i, count(*) OVER (PARTITION BY ns) AS k FROM x) GROUP BY 1", x=f"SELECT ns, {_N5} AS c FROM latest"),
    "histogram": v.sql(f"SELECT *, {_pct(0.5)} AS p50, {_pct(0.95)} AS p95 FROM (SELECT count(c) AS n, {', '.join(_le)} FROM x)", x="SELECT greatest(0.0, least(1.0, confidence)) AS c FROM latest"),
    "audit": v.sql("SELECT * FROM au", recursive=True, **_AUD),
    "narrative": v.sql(f"""SELECT ns, id, 'Held with ' || (CASE WHEN {_N5} >= 0.9 THEN 'very high' WHEN {_N5} >= 0.7 THEN 'high' WHEN {_N5} >= 0.5 THEN 'moderate' ELSE 'low' END) || ' confidence, from ' || (CASE WHEN credibility IS NULL THEN 'an unknown source' WHEN credibility >= 0.8 THEN 'a highly credible source' WHEN credibility >= 0.5 THEN 'a moderately credible source' ELSE 'a source of low credibility' END)
|| '. Supported by ' || supporters || ' and contradicted by ' || contradictors || '. ' || (CASE WHEN trend > 0 THEN 'Confidence has risen.' WHEN trend < 0 THEN 'Confidence has fallen.' ELSE 'Confidence is stable.' END) AS narrative FROM au""", recursive=True, **_AUD),
}
