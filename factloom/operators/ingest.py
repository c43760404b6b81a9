"""Writing in batches: deduplication, admission, conflicts, feedback."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.score import clamp, neutral
from factloom.functions.temporal import overlap
from factloom.functions.text import fingerprint
from factloom.operators import search
from factloom.operators.graph import components
from factloom.session import cut


def dedup(writes: DataFrame, latest_valid: DataFrame) -> DataFrame:
    """(write_id, fp, node_id, reason, first) of writes that ask for deduplication: `deduplicated` onto the valid node of the same fingerprint,
    `repeats` an earlier write of the batch, otherwise null. first: the first write of the batch with the fingerprint. Blank contents have no fingerprint and are never repeats."""
    w = writes.where(F.coalesce("dedup", F.lit(False))).select("write_id", "ns", "received_at", F.nullif(fingerprint("content"), F.lit("")).alias("fp")).distinct()
    n = latest_valid.where("fingerprint is not null and fingerprint <> ''").groupBy("ns", F.col("fingerprint").alias("fp")).agg(F.min("id").alias("node_id"))
    # a repeat is told by the first of its fingerprint; blanks are numbered by nothing and stay where they are
    first = w.where("fp is not null").groupBy("ns", "fp").agg(F.min(F.struct(F.coalesce("received_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), "write_id")).alias("first"))
    spread = F.coalesce("fp", F.concat(F.lit("#"), F.col("write_id").cast("string")))
    j = w.withColumn("key", spread).join(first.select("ns", F.col("fp").alias("key"), F.col("first.write_id").alias("first")), ["ns", "key"], "left").join(n.withColumnRenamed("fp", "key"), ["ns", "key"], "left")
    reason = F.when(F.col("node_id").isNotNull(), "deduplicated").when(F.col("first") != F.col("write_id"), "repeats")
    return j.select("write_id", "fp", "node_id", reason.alias("reason"), "first")


def admission(credibility: Column, most_similar: Column, threshold: float) -> tuple[Column, Column]:
    """(admitted, reason): sources not to be trusted, what is nearly known, and what isn't worth its novelty are rejected."""
    thr = threshold or 0.25
    reason = F.when(credibility <= 0.05, "low_credibility").when(most_similar >= 0.95, "near_duplicate").when(credibility * (1 - most_similar) < thr, "below_threshold").otherwise("admitted")
    return reason == "admitted", reason


def admit(writes: DataFrame, corpus: DataFrame, credibility: DataFrame, threshold: float = 0.25, near: search.Search = search.topk) -> DataFrame:
    """Gate of a batch against what is already stored. writes: write_id, ns, source_id, vec; corpus: write_id, ns, vec; credibility: ns, source_id,
    credibility (0.5 where unknown). Result: write_id, most_similar, credibility, admitted, reason, multiplier."""
    side = lambda df: df.select(F.col("write_id").alias("id"), F.col("ns").alias("scope"), "vec")
    near = near(side(writes), side(corpus), 1).select(F.col("query").alias("write_id"), F.col("similarity").alias("most"))
    w = writes.select("write_id", "ns", "source_id").join(near, "write_id", "left").join(credibility, ["ns", "source_id"], "left")
    most, cred = F.coalesce("most", F.lit(0.0)), F.coalesce("credibility", F.lit(0.5))
    ok, reason = admission(cred, most, threshold)
    return w.select("write_id", F.round(most, 6).alias("most_similar"), F.round(cred, 6).alias("credibility"), ok.alias("admitted"), reason.alias("reason"), F.when(ok, F.round(cred, 6)).alias("multiplier"))


def first_independent(ids: DataFrame, pairs: DataFrame, whole: int = 100_000) -> DataFrame:
    """(id, leader): ids taken in order unless an earlier taken one is their neighbour, which then is their leader (the least of
    them). pairs: (a, b), a < b.

    What isn't linked can't matter, so each connected component of up to `whole` pairs is settled at once, by one task; larger
    ones are settled in rounds over all tasks, in each of which every id follows whose earlier neighbours are settled."""
    ids = ids.select("id").distinct()
    asked = lambda x: ids.select(F.col("id").alias(x))
    pairs = cut(pairs.select("a", "b").distinct().join(asked("a"), "a", "left_semi").join(asked("b"), "b", "left_semi"))
    of = cut(components(pairs.select(F.lit("").alias("ns"), F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("id").alias("a"), "component"))
    placed = pairs.join(of, "a")
    size = placed.groupBy("component").agg(F.count("*").alias("n"))
    large = size.where(F.col("n") > whole)
    small = placed.join(large, "component", "left_anti")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        before: dict[int, list[int]] = {}
        for a, b in zip(pdf.a.tolist(), pdf.b.tolist()):
            before.setdefault(b, []).append(a)
            before.setdefault(a, [])
        leader: dict[int, int] = {}
        for i in sorted(before):
            leader[i] = min((a for a in before[i] if leader[a] == a), default=i)
        return pd.DataFrame({"id": list(leader), "leader": list(leader.values())}, dtype="int64")

    led = small.groupBy("component").applyInPandas(greedy, "id bigint, leader bigint")
    if not large.isEmpty():
        rest = placed.join(large.select("component"), "component", "left_semi").select("a", "b")
        led = led.unionByName(_in_rounds(rest.select(F.col("a").alias("id")).unionByName(rest.select(F.col("b").alias("id"))).distinct(), rest))
    return ids.join(led, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))


def _in_rounds(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """first_independent in rounds: each settles every id whose earlier neighbours are all settled."""
    undecided, decided = cut(ids.select("id").distinct()), None
    pairs = cut(pairs.select("a", "b").distinct())
    while not undecided.isEmpty():
        blocked = pairs.join(undecided.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        led = None
        if decided is not None:
            led = pairs.join(decided.where("id = leader").select(F.col("id").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
        free = undecided.join(blocked, "id", "left_anti")
        new = free.withColumn("leader", F.col("id")) if led is None else free.join(led, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))
        # a follower is settled as soon as it has a leader; only then may those after it go on
        if led is not None:
            new = new.unionByName(undecided.join(led, "id").join(free, "id", "left_anti").select("id", "leader"))
        new = cut(new)
        decided = new if decided is None else cut(decided.unionByName(new))
        undecided = cut(undecided.join(new.select("id"), "id", "left_anti"))
    if decided is None:
        return ids.select("id", F.col("id").alias("leader"))
    best = pairs.join(decided.where("id = leader").select(F.col("id").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("best"))
    return decided.join(best, "id", "left").select("id", F.when(F.col("id") == F.col("leader"), F.col("id")).otherwise(F.least("leader", "best")).alias("leader"))


def admit_in_order(writes: DataFrame, credibility: DataFrame, threshold: float = 0.25) -> DataFrame:
    """(write_id, admitted, reason): one write after the other, each seeing those admitted before it in its namespace. A sequential
    reading for small namespaces; `admit` with first_independent is the one for large ones."""
    w = writes.select("write_id", "ns", "source_id", "vec", "received_at").join(credibility, ["ns", "source_id"], "left").withColumn("credibility", F.coalesce("credibility", F.lit(0.5)))
    thr = threshold or 0.25

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["received_at", "write_id"])
        x = np.stack(pdf.vec.to_numpy()).astype(float)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        kept: list[int] = []
        out = []
        for i, c in enumerate(pdf.credibility):
            most = max(0.0, float(np.round((x[kept] @ x[i]).max(), 9))) if kept else 0.0
            why = "low_credibility" if c <= 0.05 else "near_duplicate" if most >= 0.95 else "below_threshold" if c * (1 - most) < thr else "admitted"
            out.append(why)
            if why == "admitted":
                kept.append(i)
        return pd.DataFrame({"write_id": pdf.write_id, "admitted": [o == "admitted" for o in out], "reason": out})

    return w.groupBy("ns").applyInPandas(run, "write_id bigint, admitted boolean, reason string")


def label_jaccard(a: Column, b: Column) -> Column:
    """Shared part of two label sets; 0 where one is null or empty."""
    n = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def contradiction_score(labels_a: Column, labels_b: Column, text_a: Column, text_b: Column) -> Column:
    j = label_jaccard(labels_a, labels_b)
    said = lambda t: F.coalesce(t, F.lit("")) != ""
    score = F.least(F.lit(1.0), 0.6 * j + F.when(said(text_a) & said(text_b), 0.2).otherwise(0.0))
    return F.when((j == 0) | (F.coalesce(text_a, F.lit("")) == F.coalesce(text_b, F.lit(""))), 0.0).otherwise(score)


def conflict_candidates(new: DataFrame, stored: DataFrame, k: int = 5, low: float = 0.3, high: float = 0.95, near: search.Search = search.topk) -> DataFrame:
    """(candidate, existing, similarity, weight): contradictions between new entries and their k nearest stored ones: related but not the
    same, with a shared label and validity in common. Both: id, ns, vec, labels, text, valid_from, valid_until."""
    side = lambda df: df.select("id", F.col("ns").alias("scope"), "vec")
    near = near(side(new), side(stored), k).where((F.col("similarity") >= low) & (F.col("similarity") < high))
    of = lambda df, x: df.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("labels", "text", "valid_from", "valid_until")])
    p = near.select("query", "row", "similarity").join(of(new, "query"), "query").join(of(stored, "row"), "row")
    p = p.where(overlap(F.col("valid_from_query"), F.col("valid_until_query"), F.col("valid_from_row"), F.col("valid_until_row")))
    w = contradiction_score(F.col("labels_query"), F.col("labels_row"), F.col("text_query"), F.col("text_row"))
    return p.withColumn("weight", F.round(w, 6)).where("weight >= 0.5").select(F.col("query").alias("candidate"), F.col("row").alias("existing"), F.round("similarity", 6).alias("similarity"), "weight")


def is_interference(existing: Column, candidate: Column, supporters: Column) -> Column:
    """A weak claim against a firm one with two supporters or more."""
    return (neutral(existing) >= 0.8) & (neutral(candidate) < 0.4) & (supporters >= 2)


def confidence_after(conflicts: DataFrame) -> DataFrame:
    """(ns, id, confidence, after, conflicts): contradicted nodes lose weight * candidate confidence * 0.3 for each conflict that isn't
    interference, down to 0.1. conflicts: ns, id, confidence, weight, candidate_confidence, supporters."""
    lost = F.when(is_interference(F.col("confidence"), F.col("candidate_confidence"), F.col("supporters")), 0.0).otherwise(F.col("weight") * F.coalesce("candidate_confidence", F.lit(0.0)) * 0.3)
    g = conflicts.groupBy("ns", "id", "confidence").agg(F.sum(lost).alias("lost"), F.count("*").alias("conflicts"))
    return g.select("ns", "id", "confidence", F.round(F.when(F.col("lost") > 0, F.greatest(F.lit(0.1), F.coalesce("confidence", F.lit(0.0)) - F.col("lost"))).otherwise(F.col("confidence")), 6).alias("after"), "conflicts")


# What a feedback does to confidence and utility; None sets nothing, a refutation sets confidence to 0.05.
FEEDBACK = {"validated": (0.15, 0.05), "refuted": (None, -0.2), "useful": (0.0, 0.15), "stale": (-0.1, -0.25)}


def feedback_fold(feedback: DataFrame, confidence: float = 0.5, utility: float = 0.5) -> DataFrame:
    """(id, confidence, utility, events): all feedback on a node in order of (ts, event), clamped to [0, 1] after each.

    feedback: id, ts, event, outcome. Each step is x -> min(high, max(low, x + shift)), and such steps compose to one of the same form. So
    the steps of a node are first composed day by day, then the days, and no list is as long as a node's history."""
    far = 1e9
    step = lambda low, high, shift: F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(shift).alias("shift"))
    none = step(-far, far, 0.0)
    c, u = none, none
    for kind, (dc, du) in FEEDBACK.items():
        hit = F.col("outcome") == kind
        c = F.when(hit, step(0.05, 0.05, 0.0) if dc is None else none if dc == 0 else step(0.0, 1.0, dc)).otherwise(c)
        u = F.when(hit, step(0.0, 1.0, du)).otherwise(u)

    def after(f: Column, g: Column) -> Column:
        bound = lambda x: F.least(g["high"], F.greatest(g["low"], x + g["shift"]))
        return F.struct(bound(f["low"]).alias("low"), bound(f["high"]).alias("high"), (f["shift"] + g["shift"]).alias("shift"))

    def composed(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
        s = df.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*order, "c", "u"))).alias("s"), F.sum("n").alias("n"))
        one = lambda x: F.aggregate(F.transform("s", lambda y: y[x]), none, after)
        return s.select(*key, one("c").alias("c"), one("u").alias("u"), "n")

    steps = feedback.select("id", F.to_date("ts").alias("day"), "ts", "event", c.alias("c"), u.alias("u"), F.lit(1).cast("bigint").alias("n"))
    whole = composed(composed(steps, ["id", "day"], ["ts", "event"]), ["id"], ["day"])
    at = lambda x, start: F.round(F.least(F.col(f"{x}.high"), F.greatest(F.col(f"{x}.low"), start + F.col(f"{x}.shift"))), 6)
    return whole.select("id", at("c", confidence).alias("confidence"), at("u", utility).alias("utility"), F.col("n").alias("events"))


def rate_bursts(events: DataFrame, key: list[str], seconds: int, least: int) -> DataFrame:
    """Windows of so many seconds in which a key has more than `least` events."""
    g = events.groupBy(*key, F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > least)
    return g.select(*key, F.col("w.start").cast("timestamp_ntz").alias("start"), "n", F.round(F.least(F.lit(1.0), F.col("n") / (2.0 * max(least, 1))), 6).alias("severity"))


def budget(events: DataFrame, key: list[str], seconds: int, most: int) -> DataFrame:
    """Events with `within`: whether they are among the first `most` of their key in their time slice."""
    slot = F.window("ts", f"{seconds} seconds")["start"]
    n = F.row_number().over(Window.partitionBy(*key, "slot").orderBy("ts", "event"))
    return events.withColumn("slot", slot).withColumn("within", n <= most).drop("slot")


def claims(rows: DataFrame, content: str, labels: dict[str, str], relations: dict[str, str], ns: str = "default") -> tuple[DataFrame, DataFrame]:
    """Node and edge rows from a table: content column, label columns (column -> label prefix) and relation columns (column -> edge type).

    Ids are the fingerprints of the contents; blank contents give nothing."""
    fp = lambda c: F.nullif(fingerprint(F.col(c).cast("string")), F.lit(""))
    base = rows.withColumn("_id", fp(content)).where("_id is not null")
    tags = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(p + ":"), F.col(c).cast("string"))) for c, p in labels.items()])) if labels else F.array().cast("array<string>")
    nodes = base.select(F.lit(ns).alias("ns"), F.col("_id").alias("id"), F.col(content).cast("string").alias("content"), tags.alias("labels")).dropDuplicates(["id"])
    parts = [F.struct(F.lit(t).alias("edge_type"), fp(c).alias("dst")) for c, t in relations.items()]
    edges = base.select(F.lit(ns).alias("ns"), F.col("_id").alias("src"), F.explode(F.array(*parts)).alias("x")).select("ns", "src", "x.*").where("dst is not null").distinct() if parts else base.select(F.lit(ns).alias("ns"), F.col("_id").alias("src"), F.lit("").alias("edge_type"), F.lit("").alias("dst")).limit(0)
    return nodes, edges


def extract(texts: DataFrame, extractor: Callable[[str], list[dict]]) -> DataFrame:
    """(id, name, text, label, error) of what a callable finds in each text; a failure gives one row with its message in `error`. texts: id
    bigint, text. Null and empty texts give nothing."""

    def run(pdfs):
        for pdf in pdfs:
            rows = []
            for i, t in zip(pdf.id, pdf.text):
                try:
                    rows += [(i, x.get("name"), x.get("text", t), x.get("label"), None) for x in (extractor(t) if t else [])]
                except Exception as e:
                    rows.append((i, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["id", "name", "text", "label", "error"])

    return texts.select("id", "text").mapInPandas(run, "id bigint, name string, text string, label string, error string")


def ingest_text(texts: DataFrame, extractor: Callable[[str], list[dict]], admitted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Extracted entities whose text passes a gate (a function from entities to those kept)."""
    return admitted(extract(texts, extractor).where("error is null").drop("error"))
