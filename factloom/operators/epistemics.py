"""What is believed, by whom, how firmly: consensus, truth, credibility, conflict, gaps, calibration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import beta
from factloom.functions.score import clamp, neutral
from factloom.functions.temporal import hours_between
from factloom.operators import graph, search

# What an assertion weighs by its epistemic type.
EPISTEMIC = {"assertion": 1.0, "observation": 0.6, "inference": 0.8}


def vote_value(kind: Column) -> Column:
    return F.when(kind == "supports", 1.0).when(kind == "contradicts", 0.0).otherwise(0.5)


def epistemic_weight(kind: Column) -> Column:
    out = F.lit(1.0)
    for k, w in EPISTEMIC.items():
        out = F.when(kind == k, w).otherwise(out)
    return out


def weighted_consensus(votes: DataFrame, key: list[str], credibility: str = "credibility", weight: str = "weight", value: str = "value") -> DataFrame:
    """(key, truth, confidence, sources): weighted mean of the values; without weight 0.5 and 0.

    The spread is taken around that mean with the credibilities as weights, so one pass of sums is enough."""
    c, w, v = F.col(credibility), F.col(weight), F.col(value)
    g = votes.groupBy(*key).agg(F.sum(w).alias("w"), F.sum(w * v).alias("wv"), F.sum(c).alias("c"), F.sum(c * v).alias("cv"), F.sum(c * v * v).alias("cvv"), F.count("*").alias("sources"))
    p = F.col("wv") / F.col("w")
    spread = (F.col("cvv") - 2 * p * F.col("cv") + p * p * F.col("c")) / F.col("w")
    some = F.col("w") > 0
    return g.select(*key, F.round(F.when(some, p).otherwise(0.5), 6).alias("truth"), F.round(F.when(some, 1 - F.least(4 * spread, F.lit(1.0))).otherwise(0.0), 6).alias("confidence"), "sources")


def credibility_table(sources: DataFrame, t: Column) -> DataFrame:
    """Each source's mean, variance, 95 % interval and mean after forgetting until t."""
    labels, a, b = F.col("labels"), F.col("alpha"), F.col("beta")
    low, high = beta.interval(labels, a, b, F.col("claims_asserted"))
    da, db = beta.decayed(a, b, F.col("updated_at"), t)
    r = lambda c, n: F.round(c, 6).alias(n)
    return sources.select("id", "ns", r(beta.effective(labels, a, b), "effective"), r(beta.mean(a, b), "mean"), r(beta.variance(a, b), "variance"), r(low, "low"), r(high, "high"), r(beta.mean(da, db), "decayed"))


def thompson(sources: DataFrame, seed: int = 0) -> DataFrame:
    """One draw of each source's credibility from its Beta distribution."""

    def draw(pdfs):
        for pdf in pdfs:
            rngs = [np.random.default_rng([seed, int.from_bytes(i.encode()[-8:], "little")]) for i in pdf.id]
            yield pd.DataFrame({"id": pdf.id, "sample": [r.beta(max(a, 1e-9), max(b, 1e-9)) for r, a, b in zip(rngs, pdf.alpha, pdf.beta)]})

    return sources.where("id is not null").select("id", "alpha", "beta").mapInPandas(draw, "id string, sample double")


def ucb_rank(sources: DataFrame, explore: float = 1.0) -> DataFrame:
    """Sources by mean credibility plus an allowance for those seldom observed."""
    total = sources.agg(F.greatest(F.sum("claims_asserted"), F.lit(1)).alias("total"))
    m = beta.effective(F.col("labels"), F.col("alpha"), F.col("beta"))
    bonus = explore * F.sqrt(2 * F.log("total") / F.greatest("claims_asserted", F.lit(1)))
    return sources.join(F.broadcast(total)).select("id", F.round(m + bonus, 6).alias("ucb"), F.round(m, 6).alias("mean"))


def observed(outcomes: DataFrame) -> DataFrame:
    """(source, alpha, beta): Bayesian updates from a uniform prior; weight of each outcome within (0, 10]."""
    w = F.when(F.col("weight") > 0, F.least("weight", F.lit(10.0))).otherwise(1.0)
    return outcomes.groupBy("source").agg(F.round(1 + F.sum(F.when(F.col("right"), w).otherwise(0.0)), 6).alias("alpha"), F.round(1 + F.sum(F.when(F.col("right"), 0.0).otherwise(w)), 6).alias("beta"))


def resolve_truth(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Consensus on each node from incoming supports and contradicts edges, weighted by the credibility of the asserting node's source."""
    e = edges.where(F.col("edge_type").isin("supports", "contradicts")).select("ns", F.col("src").alias("from"), F.col("dst").alias("id"), vote_value(F.col("edge_type")).alias("value"))
    n = nodes.select("ns", F.col("id").alias("from"), F.col("source_id").alias("external_id"))
    s = sources.select("ns", "external_id", beta.effective(F.col("labels"), F.col("alpha"), F.col("beta")).alias("credibility"))
    v = e.join(n, ["ns", "from"]).join(s, ["ns", "external_id"], "left").withColumn("credibility", F.coalesce("credibility", F.lit(0.5)))
    return weighted_consensus(v.withColumn("weight", F.col("credibility")), ["ns", "id"])


def feedback_propagation(votes: DataFrame, truth: DataFrame, least: float = 0.7) -> DataFrame:
    """(source, alpha, beta) gained where a claim's truth is firm: agreeing sources are validated, others refuted, by its confidence."""
    firm = truth.where(F.col("confidence") >= least).select("claim", "truth", "confidence")
    v = votes.where(F.col("value") != 0.5).join(firm, "claim")
    agree = (F.col("value") >= 0.5) == (F.col("truth") >= 0.5)
    return v.groupBy("source").agg(F.round(F.sum(F.when(agree, F.col("confidence")).otherwise(0.0)), 6).alias("alpha"), F.round(F.sum(F.when(agree, 0.0).otherwise(F.col("confidence"))), 6).alias("beta"), F.count("*").alias("claims"))


def belief_diff(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Both sides of each contradicts edge: confidence, source, supporters, and the gap of confidence."""
    n = nodes.select("ns", "id", neutral(F.col("confidence")).alias("conf"), "source_id")
    sup = edges.where("edge_type = 'supports'").groupBy("ns", F.col("dst").alias("id")).agg(F.count("*").alias("supporters"))
    side = n.join(sup, ["ns", "id"], "left").withColumn("supporters", F.coalesce("supporters", F.lit(0)))
    one = lambda x, end: side.select("ns", F.col("id").alias(end), *[F.col(c).alias(f"{c}_{x}") for c in ("conf", "source_id", "supporters")])
    e = edges.where("edge_type = 'contradicts' and src <> dst").select("id", "ns", "src", "dst", "weight")
    return e.join(one("a", "src"), ["ns", "src"]).join(one("b", "dst"), ["ns", "dst"]).withColumn("gap", F.round(F.abs(F.col("conf_a") - F.col("conf_b")), 6))


def health(valid: DataFrame, edges: DataFrame) -> DataFrame:
    """Per namespace: mean confidence, share of nodes in conflict, source diversity and the overall score."""
    against = edges.where("edge_type = 'contradicts'").select("ns", F.col("src").alias("id")).distinct().withColumn("against", F.lit(1))
    n = valid.join(against, ["ns", "id"], "left")
    g = n.groupBy("ns").agg(F.count("*").alias("nodes"), F.avg(neutral(F.col("confidence"))).alias("c"), F.count("against").alias("conflicts"), F.countDistinct(F.nullif("source_id", F.lit(""))).alias("sources"))
    share, div = F.col("conflicts") / F.col("nodes"), F.least(F.lit(1.0), F.col("sources") / F.col("nodes"))
    return g.select("ns", "nodes", "sources", "conflicts", F.round("c", 6).alias("confidence"), F.round(clamp(0.35 * F.col("c") + 0.25 + 0.2 * (1 - share) + 0.2 * div), 6).alias("overall"))


def density(near: DataFrame, nodes: DataFrame, t: Column) -> DataFrame:
    """Per query of a top-k result (query, ns, id, similarity): count, mean and least similarity, mean and spread of confidence, freshness."""
    n = nodes.select("ns", "id", neutral(F.col("confidence")).alias("c"), F.exp(-0.001 * F.greatest(F.lit(0.0), hours_between(F.col("valid_from"), t))).alias("fresh"))
    g = near.join(n, ["ns", "id"]).groupBy("query")
    g = g.agg(F.count("*").alias("local"), F.avg("similarity").alias("s"), F.min("similarity").alias("least"), F.avg("c").alias("c"), F.stddev_pop("c").alias("spread"), F.avg("fresh").alias("fresh"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return g.select("query", "local", r("s", "similarity"), r("least", "least"), r("c", "confidence"), r("spread", "spread"), r("fresh", "freshness"), ((F.round("s", 6) < 0.5) | (F.col("local") < 3)).alias("sparse"))


def gaps(entries: DataFrame, sample: int = 20, low: float = 0.1, high: float = 0.6, sparse: float = 0.5, k: int = 5) -> DataFrame:
    """(ns, a, b, similarity, density): midpoints between loosely related entries around which the k nearest are far.

    entries: id bigint, ns, vec. Of each namespace the first `sample` entries by id are paired: the operator's own report
    samples, search covers all entries."""
    from factloom.functions.vector import midpoint

    some = entries.withColumn("_n", F.row_number().over(Window.partitionBy("ns").orderBy("id"))).where(F.col("_n") <= sample).select("ns", "id", "vec")
    pairs = search.pairs_within(some.select("id", F.col("ns").alias("scope"), "vec"), low, high + 1e-9)
    side = lambda x: some.select(F.col("id").alias(x), F.col("ns").alias(f"ns_{x}"), F.col("vec").alias(f"v{x}"))
    mid = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "similarity", F.col("ns_a").alias("ns"), midpoint(F.col("va"), F.col("vb")).alias("vec")).withColumn("id", F.xxhash64("a", "b"))
    near = search.topk(mid.select("id", F.col("ns").alias("scope"), "vec"), entries.select("id", F.col("ns").alias("scope"), "vec"), k)
    d = near.groupBy(F.col("query").alias("id")).agg(F.round(F.avg("similarity"), 6).alias("density"))
    return mid.drop("vec").join(d, "id", "left").withColumn("density", F.coalesce("density", F.lit(0.0))).where(F.col("density") < sparse).select("ns", "a", "b", F.round("similarity", 6).alias("similarity"), "density")


def gap_details(found: DataFrame, entries: DataFrame, nodes: DataFrame, t: Column, most: int = 10, k: int = 5) -> DataFrame:
    """(ns, rank, a, b, density, confidence, age_hours): of each namespace the `most` sparsest gaps, with the mean confidence of the nodes around
    the midpoint (unknown 0.5) and the age of the oldest of them.

    found: of gaps. entries: also node_id."""
    from factloom.functions.vector import midpoint

    top = found.withColumn("rank", F.row_number().over(Window.partitionBy("ns").orderBy("density", "a", "b"))).where(F.col("rank") <= most)
    side = lambda x: entries.select(F.col("id").alias(x), F.col("vec").alias(f"v{x}"))
    mid = top.join(side("a"), "a").join(side("b"), "b").select("ns", "rank", "a", "b", "density", midpoint(F.col("va"), F.col("vb")).alias("vec"), F.xxhash64("a", "b").alias("id"))
    near = search.topk(mid.select("id", F.col("ns").alias("scope"), "vec"), entries.select("id", F.col("ns").alias("scope"), "vec"), k)
    n = nodes.select("ns", F.col("id").alias("node_id"), neutral(F.col("confidence")).alias("c"), F.greatest(F.lit(0.0), hours_between(F.col("valid_from"), t)).alias("age"))
    around = near.join(entries.select(F.col("id").alias("row"), "ns", "node_id"), "row").join(n, ["ns", "node_id"], "left")
    g = around.groupBy(F.col("query").alias("id")).agg(F.round(F.avg(F.coalesce("c", F.lit(0.5))), 6).alias("confidence"), F.round(F.coalesce(F.max("age"), F.lit(0.0)), 6).alias("age_hours"))
    return mid.drop("vec").join(g, "id", "left").select("ns", F.col("rank").cast("bigint").alias("rank"), "a", "b", "density", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("age_hours", F.lit(0.0)).alias("age_hours"))


def contradiction_severity(gap: Column, weight: Column) -> Column:
    """high, medium or low by the gap of confidence and the weight of the contradiction (0 or null counts 1)."""
    w = F.when(F.coalesce(weight, F.lit(0.0)) == 0, 1.0).otherwise(weight)
    return F.when((gap >= 0.5) | (w >= 0.9), "high").when((gap >= 0.2) | (w >= 0.5), "medium").otherwise("low")


def gap_report(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per namespace: gaps, nodes and coverage max(0, 1 - gaps / nodes)."""
    n = nodes.groupBy("ns").agg(F.count("*").alias("nodes"))
    g = found.groupBy("ns").agg(F.count("*").alias("gaps"))
    return n.join(g, "ns", "left").select("ns", "nodes", F.coalesce("gaps", F.lit(0)).alias("gaps"), F.round(F.greatest(F.lit(0.0), 1 - F.coalesce("gaps", F.lit(0)) / F.col("nodes")), 6).alias("coverage"))


def grounding(claims: DataFrame, entries: DataFrame, least: float = 0.7) -> DataFrame:
    """(claim, best, similarity, grounded): whether the nearest entry is near enough. claims, entries: id, scope, vec."""
    near = search.topk(claims, entries, 1, -1.0, strict=False)
    out = claims.select(F.col("id").alias("query")).distinct().join(near, "query", "left")
    return out.select(F.col("query").alias("claim"), F.col("row").alias("best"), F.round("similarity", 6).alias("similarity"), F.coalesce(F.round("similarity", 6) >= least, F.lit(False)).alias("grounded"))


def acquisitions(suggested: DataFrame, budget: int = 10) -> DataFrame:
    """(ns, rank, id, kind, priority): of each namespace the first suggestions by priority, then kind and id; a budget of 0 or less means 10."""
    n = F.row_number().over(Window.partitionBy("ns").orderBy(F.desc("priority"), "kind", "id"))
    return suggested.withColumn("rank", n.cast("bigint")).where(F.col("rank") <= (budget if budget > 0 else 10)).select("ns", "rank", "id", "kind", "priority")


def active_learning(valid: DataFrame, edges: DataFrame, t: Column) -> DataFrame:
    """(ns, id, kind, priority): what to acquire: support for weak claims, what expires soon, old firm claims in conflict."""
    against = edges.where("edge_type = 'contradicts'").select("ns", F.col("src").alias("id")).distinct().withColumn("against", F.lit(True))
    c, left, age = neutral(F.col("confidence")), hours_between(t, F.col("valid_until")), hours_between(F.col("valid_from"), t)
    one = lambda cond, kind, p: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.round(p, 6).alias("priority")))
    said = F.array(one(c < 0.4, "low_confidence", 1 - c), one((left > 0) & (left < 168), "refresh_stale", 1 - left / 168), one((c >= 0.7) & (age > 720) & F.col("against"), "verify_claim", F.lit(0.7)))
    return valid.join(against, ["ns", "id"], "left").select("ns", "id", F.explode(F.array_compact(said)).alias("s")).select("ns", "id", "s.*")


def support_matrix(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ns, a, b, n): how often nodes of source a support nodes of source b."""
    who = nodes.where("source_id is not null").select("ns", "id", "source_id")
    e = edges.where("edge_type = 'supports'").select("ns", "src", "dst")
    m = e.join(who.select("ns", F.col("id").alias("src"), F.col("source_id").alias("a")), ["ns", "src"]).join(who.select("ns", F.col("id").alias("dst"), F.col("source_id").alias("b")), ["ns", "dst"])
    return m.where("a <> b").groupBy("ns", "a", "b").agg(F.count("*").alias("n"))


def echo_chambers(nodes: DataFrame, edges: DataFrame, least: int = 2, alert: float = 0.3) -> DataFrame:
    """(ns, seed, partners, mutual, confidence): a source and the sources after it by name that it supports and that support it, each
    `least` times or more."""
    m = support_matrix(nodes, edges)
    both = m.alias("x").join(m.alias("y"), (F.col("x.ns") == F.col("y.ns")) & (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a")))
    both = both.where((F.col("x.n") >= least) & (F.col("y.n") >= least) & (F.col("x.a") < F.col("x.b"))).select(F.col("x.ns").alias("ns"), F.col("x.a").alias("seed"), F.col("x.b").alias("b"), (F.col("x.n") + F.col("y.n")).alias("n"))
    g = both.groupBy("ns", "seed").agg(F.count("*").alias("partners"), F.sum("n").alias("mutual"))
    return g.withColumn("confidence", F.round(F.col("mutual") / (F.col("mutual") + 8.0), 6)).where(F.col("confidence") >= alert)


def trust_history(feedback: DataFrame) -> DataFrame:
    """(source, ts, event, alpha, beta, credibility) after each validation or refutation, from a uniform prior."""
    w = Window.partitionBy("source").orderBy("ts", "event").rowsBetween(Window.unboundedPreceding, 0)
    a = 1.0 + F.sum(F.when(F.col("outcome") == "validated", 1).otherwise(0)).over(w)
    b = 1.0 + F.sum(F.when(F.col("outcome") == "refuted", 1).otherwise(0)).over(w)
    h = feedback.where(F.col("outcome").isin("validated", "refuted")).select("source", "ts", "event", a.alias("alpha"), b.alias("beta"))
    return h.withColumn("credibility", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def credibility_drops(history: DataFrame, least: float) -> DataFrame:
    """(source, drop, severity): how far the last credibility lies below the mean of those before."""
    last = F.max_by("credibility", F.struct("ts", "event"))
    g = history.groupBy("source").agg(F.count("*").alias("n"), F.sum("credibility").alias("s"), last.alias("last")).where("n >= 2")
    drop = (F.col("s") - F.col("last")) / (F.col("n") - 1) - F.col("last")
    return g.select("source", F.round(drop, 6).alias("drop"), F.round(F.least(2 * drop, F.lit(1.0)), 6).alias("severity")).where(F.col("drop") >= least)


def activity_bursts(snapshots: DataFrame, factor: float = 3.0) -> DataFrame:
    """(source, rate, baseline, severity) of sources whose observations since the last snapshot but one exceed `factor` times the mean before.

    snapshots: source, ts, total (alpha + beta); four or more are needed, for a mean before the last two."""
    w = Window.partitionBy("source").orderBy("ts")
    s = snapshots.withColumn("step", F.col("total") - F.lag("total").over(w)).withColumn("back", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("ts"))))
    g = s.groupBy("source").agg(F.sum(F.when(F.col("back") == 1, F.col("step"))).alias("rate"), F.avg(F.when(F.col("back") > 2, F.col("step"))).alias("baseline"), F.count("*").alias("n"))
    g = g.where((F.col("n") >= 4) & (F.col("baseline") > 0) & (F.col("rate") > factor * F.col("baseline")))
    return g.select("source", F.round("rate", 6).alias("rate"), F.round("baseline", 6).alias("baseline"), F.round(F.least(F.lit(1.0), F.col("rate") / F.col("baseline") / 5), 6).alias("severity"))


# --- calibration: (predicted double, actual 0 or 1)


def calibration_bins(outcomes: DataFrame, bins: int = 10) -> DataFrame:
    i = F.least(F.floor(F.col("predicted") * bins), F.lit(bins - 1)).alias("bin")
    return outcomes.groupBy(i).agg(F.count("*").alias("n"), F.avg("predicted").alias("p"), F.avg(F.col("actual").cast("double")).alias("a"))


def calibration(outcomes: DataFrame, bins: int = 10) -> DataFrame:
    """One row: n, Brier score, expected and maximal calibration error."""
    b = calibration_bins(outcomes, bins)
    err = F.abs(F.col("p") - F.col("a"))
    e = b.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * err) / F.sum("n"), 6).alias("ece"), F.round(F.max(err), 6).alias("mce"))
    brier = outcomes.agg(F.round(F.avg(F.pow(F.col("predicted") - F.col("actual"), 2)), 6).alias("brier"))
    return e.join(F.broadcast(brier))


def platt_fit(outcomes: DataFrame, steps: int = 1000, rate: float = 0.01, least: int = 50, digits: int = 4) -> tuple[float, float] | None:
    """Slope and intercept by gradient descent; None for fewer than `least` outcomes.

    Outcomes are first summed over predictions rounded to `digits`: at most 20001 cells reach the driver."""
    cells = outcomes.groupBy(F.round("predicted", digits).alias("p"), F.col("actual").cast("int").alias("y")).agg(F.count("*").alias("n")).toPandas()
    n = cells.n.sum()
    if n < least:
        return None
    x, y, w = (cells[c].to_numpy(float) for c in ("p", "y", "n"))
    a = b = 0.0
    for _ in range(steps):
        e = w * (1 / (1 + np.exp(-(a * x + b))) - y)
        a, b = a - rate * (e * x).sum() / n, b - rate * e.sum() / n
    return float(a), float(b)


def platt(outcomes: DataFrame, **options) -> DataFrame:
    """outcomes with `calibrated`; unchanged predictions where nothing could be fitted."""
    ab = platt_fit(outcomes, **options)
    return outcomes.withColumn("calibrated", F.col("predicted") if ab is None else 1 / (1 + F.exp(-(ab[0] * F.col("predicted") + ab[1]))))


def isotonic_fit(outcomes: DataFrame, digits: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the monotone regression: pooled adjacent violators over predictions rounded to `digits`, a knot at the middle of each block."""
    cells = outcomes.groupBy(F.round("predicted", digits).alias("p")).agg(F.count("*").alias("n"), F.sum(F.col("actual").cast("double")).alias("y")).toPandas().sort_values("p")
    blocks: list[list[float]] = []  # sum, count, first position
    at = 0
    for n, y in zip(cells.n, cells.y):
        blocks.append([y, n, at])
        at += n
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] > blocks[-1][0] * blocks[-2][1]:
            y2, n2, _ = blocks.pop()
            blocks[-1][0] += y2
            blocks[-1][1] += n2
    ends = np.cumsum(cells.n.to_numpy())
    middle = [min(int(s + n // 2), int(ends[-1]) - 1) for _, n, s in blocks] if blocks else []
    return cells.p.to_numpy()[np.searchsorted(ends, middle, side="right")] if blocks else np.zeros(0), np.array([y / n for y, n, _ in blocks])


def isotonic(outcomes: DataFrame, digits: int = 4) -> DataFrame:
    x, y = isotonic_fit(outcomes, digits)

    if not len(x):
        return outcomes.withColumn("calibrated", F.col("predicted"))
    # few knots: the stretch is found by counting those below, and interpolated
    p, xs, ys = F.col("predicted"), F.array(*map(F.lit, x.tolist())), F.array(*map(F.lit, y.tolist()))
    i = F.size(F.filter(xs, lambda k: k <= p))
    at = lambda a, j: F.element_at(a, F.greatest(F.lit(1), F.least(F.lit(len(x)), j)))
    x0, x1, y0, y1 = at(xs, i), at(xs, i + 1), at(ys, i), at(ys, i + 1)
    return outcomes.withColumn("calibrated", F.when(i == 0, float(y[0])).when((i >= len(x)) | (x1 <= x0), y0).otherwise(y0 + (y1 - y0) * (p - x0) / (x1 - x0)))


# --- reports


def quantiles(df: DataFrame, value: str, key: list[str], shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """count, min, max, mean and nearest-rank quantiles: element int(p (n - 1)) of the sorted values.

    Equal values are counted before any sorting, so a key that holds many rows costs its distinct values only."""
    c = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*key)
    r = c.withColumn("_upto", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    pick = [F.min(F.when(F.col("_upto") > F.floor(p * (F.col("_n") - 1)), F.col(value))).alias(f"p{int(p * 100)}") for p in shares]
    return r.groupBy(*key).agg(F.sum("_c").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.sum(F.col(value) * F.col("_c")) / F.sum("_c"), 6).alias("mean"), *pick)


def histogram(df: DataFrame, value: str, bounds: list[float], shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """One row: count, cumulative buckets le_0.. and for each share the first bound that holds it."""
    cum = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"le_{i}") for i, b in enumerate(bounds)]
    g = df.agg(F.count(value).alias("n"), *cum)
    out = []
    for p in shares:
        c = F.lit(None).cast("double")
        for i in reversed(range(len(bounds))):
            c = F.when(F.col(f"le_{i}") >= F.ceil(p * F.col("n")), float(bounds[i])).otherwise(c)
        out.append(c.alias(f"p{int(p * 100)}"))
    return g.select("*", *out)


def audit(nodes: DataFrame, edges: DataFrame, sources: DataFrame, versions: DataFrame) -> DataFrame:
    """Each node with its source's credibility, supporters, contradictors (both directions), provenance depth, versions and trend of confidence."""
    e = edges.select("ns", "src", "dst", "edge_type")
    sup = e.where("edge_type = 'supports'").groupBy("ns", F.col("dst").alias("id")).agg(F.count("*").alias("supporters"))
    con = e.where("edge_type = 'contradicts'")
    con = con.select("ns", F.col("dst").alias("id")).unionByName(con.select("ns", F.col("src").alias("id"))).groupBy("ns", "id").agg(F.count("*").alias("contradictors"))
    hist = versions.groupBy("ns", "id").agg(F.count("*").alias("versions"), F.min_by("confidence", "version_no").alias("first"), F.max_by("confidence", "version_no").alias("last"))
    s = sources.select("ns", F.col("external_id").alias("source_id"), F.round(beta.effective(F.col("labels"), F.col("alpha"), F.col("beta")), 6).alias("credibility"))
    depth = graph.provenance_depth(nodes, edges)
    out = nodes.select("ns", "id", "source_id", "confidence").join(s, ["ns", "source_id"], "left").join(sup, ["ns", "id"], "left").join(con, ["ns", "id"], "left").join(depth, ["ns", "id"], "left").join(hist, ["ns", "id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("ns", "id", "source_id", "confidence", "credibility", zero("supporters"), zero("contradictors"), zero("depth"), "versions", F.round(F.col("last") - F.col("first"), 6).alias("trend"))


def narrative(audited: DataFrame) -> DataFrame:
    """A sentence or two about each audited node."""
    c = neutral(F.col("confidence"))
    band = F.when(c >= 0.9, "very high").when(c >= 0.7, "high").when(c >= 0.5, "moderate").otherwise("low")
    trust = F.when(F.col("credibility").isNull(), "an unknown source").when(F.col("credibility") >= 0.8, "a highly credible source").when(F.col("credibility") >= 0.5, "a moderately credible source").otherwise("a source of low credibility")
    trend = F.when(F.col("trend") > 0, "Confidence has risen.").when(F.col("trend") < 0, "Confidence has fallen.").otherwise("Confidence is stable.")
    text = F.concat_ws(" ", F.concat(F.lit("Held with "), band, F.lit(" confidence, from "), trust, F.lit(".")), F.concat(F.lit("Supported by "), F.col("supporters").cast("string"), F.lit(" and contradicted by "), F.col("contradictors").cast("string"), F.lit(".")), trend)
    return audited.select("ns", "id", text.alias("narrative"))
