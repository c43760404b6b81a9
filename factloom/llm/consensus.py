"""Consensus from several annotators' labels (problem 4): latent ability and difficulty.

An annotator j of ability a_j labels an item i of ease e_i > 0 rightly with probability 1 / (1 + exp(-a_j e_i)); a below zero
is an annotator who is mostly wrong. Gradient expectation-maximisation: given the abilities, each item's ease and
posterior follow from its own labels alone, so items need no state between rounds; given these, every annotator's
gradient and curvature are sums over items, which batches pre-aggregate. Up to Glad.annotators, one number an annotator
goes through the driver in a round; above, abilities are a table that is joined with the votes. Priors: a ~ N(1, 1), log e ~ N(0, spread²).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.keys import trimmed, uuid_key
from factloom.session import cut

#: The two positions, as fixed by the test data.
SUPPORTS, CONTRADICTS = "supports", "contradicts"


@dataclass(frozen=True)
class Glad:
    """rounds, tolerance: of the fit, until no ability moves by more. inner: steps for an item's ease. spread: of log ease. annotators: most
    for which the abilities (8 bytes each) are sent to all tasks; more are kept as a table and joined with their votes."""

    rounds: int = 40
    inner: int = 6
    spread: float = 0.5
    tolerance: float = 2e-3
    annotators: int = 1_000_000


def positions(assertions: DataFrame) -> DataFrame:
    """(claim, source, vote): each source's last position on each claim, vote 1 supports, -1 contradicts.

    The last assertion by (asserted_at, assertion_id, type) counts; a null time is the earliest. If it is no position, the
    source has none. Letter case and outer white space of the type don't count. Rows without claim or source
    are left out, repeated rows do no harm."""
    t = F.lower(trimmed("assertion_type"))
    # a number in the order of the types, so that no text is carried along
    code = F.when(t > SUPPORTS, 4).when(t == SUPPORTS, 3).when(t > CONTRADICTS, 2).when(t == CONTRADICTS, 1).when(t.isNotNull(), 0).otherwise(-1)
    a = assertions.select(uuid_key("claim_id").alias("claim"), uuid_key("source_id").alias("source"), F.struct("asserted_at", "assertion_id", code.alias("t")).alias("x"))
    a = a.where("claim is not null and source is not null").groupBy("claim", "source").agg(F.max("x").alias("last"))
    vote = F.when(F.col("last.t") == 3, 1).when(F.col("last.t") == 1, -1)
    return a.select("claim", "source", vote.cast("tinyint").alias("vote")).where("vote is not null")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _votes(b: pa.RecordBatch, ability: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Item of each vote, annotator, +1 or -1, and the annotator's ability: of the array, or else of the column beside."""
    who = b.column("who")
    offsets = who.offsets.to_numpy()
    item = np.repeat(np.arange(b.num_rows), np.diff(offsets))
    flat = who.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    number = flat >> 1
    if ability is not None:
        return item, number, np.where(flat & 1, 1.0, -1.0), ability[number]
    own = b.column("ability")
    at = own.offsets.to_numpy()
    return item, number, np.where(flat & 1, 1.0, -1.0), own.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]


def settle(item: np.ndarray, a: np.ndarray, vote: np.ndarray, n: int, prior: float, p: Glad) -> tuple[np.ndarray, np.ndarray]:
    """Ease and posterior log-odds of each of n items, given the ability behind each vote, by gradient steps on log ease."""
    pull = np.bincount(item, vote * a, n)
    size = np.maximum(np.bincount(item, a * a, n), 1e-9)
    log_ease = np.zeros(n)
    for _ in range(p.inner):
        ease = np.exp(log_ease)
        right = _sigmoid((prior + ease * pull)[item] * vote)
        grad = np.bincount(item, (right - _sigmoid(a * ease[item])) * a, n) * ease - log_ease / p.spread**2
        log_ease = np.clip(log_ease + grad / (1 / p.spread**2 + 0.25 * size * ease * ease), -3, 3)
    ease = np.exp(log_ease)
    return ease, prior + ease * pull


_SUMS = "who bigint, g double, h double"


def _sums(held, prior: float, p: Glad):
    """Gradient and curvature of each annotator, summed batch by batch; annotator -1 has the expected number of `supports` and the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            item, who, vote, a = _votes(b, held.value if held else None)
            ease, odds = settle(item, a, vote, b.num_rows, prior, p)
            e = ease[item]
            s = _sigmoid(a * e)
            ids, at = np.unique(who, return_inverse=True)
            grad, curve = np.bincount(at, (_sigmoid(odds[item] * vote) - s) * e), np.bincount(at, s * (1 - s) * e * e)
            yield pa.RecordBatch.from_pydict({"who": pa.array([*ids.tolist(), -1], pa.int64()), "g": pa.array([*grad, float(_sigmoid(odds).sum())]), "h": pa.array([*curve, float(b.num_rows)])})

    return run


def _prior(right: float, count: float) -> float:
    mean = np.clip((right + 1) / (count + 2), 1e-3, 1 - 1e-3)
    return float(np.log(mean / (1 - mean)))


@dataclass
class Fit:
    """Votes by claim (claim, who: 2 * annotator + [supports]; ability beside, where there are very many annotators), the numbers of the
    annotators (source, number, n), and what was fitted: abilities as a broadcast array, or as a table (number, ability)."""

    items: DataFrame
    number: DataFrame
    prior: float = 0.0
    held: object | None = None
    table: DataFrame | None = None


def fit(assertions: DataFrame, p: Glad) -> Fit:
    """Abilities of all annotators and the prior log-odds of `supports`. A claim's list is as long as its sources at most."""
    sc = assertions.sparkSession.sparkContext
    votes = cut(positions(assertions))
    number = cut(votes.groupBy("source").agg(F.count("*").alias("n")).withColumn("number", F.monotonically_increasing_id()))
    n = number.count()
    few = n <= p.annotators
    if few:  # numbered from 0 without gaps, in order of their names
        rows = sorted(((r.source, r.n) for r in number.collect()), key=lambda r: r[0])
        number = assertions.sparkSession.createDataFrame([(s, c, i) for i, (s, c) in enumerate(rows)], "source string, n bigint, number bigint")
    who = F.col("number") * 2 + (F.col("vote") > 0).cast("bigint")
    items = cut(votes.join(number, "source").groupBy("claim").agg(F.sort_array(F.collect_list(who)).alias("who")))
    if not n:
        return Fit(items, number, held=sc.broadcast(np.ones(0)))
    return _fit_array(items, number, n, p) if few else _fit_table(items, number, p)


def _fit_array(items: DataFrame, number: DataFrame, n: int, p: Glad) -> Fit:
    """The abilities go through the driver, 8 bytes each."""
    sc = items.sparkSession.sparkContext
    ability, prior = np.ones(n), 0.0
    for _ in range(p.rounds):
        held = sc.broadcast(ability)
        got = items.mapInArrow(_sums(held, prior, p), _SUMS).groupBy("who").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas().sort_values("who")
        held.unpersist()
        one, share = got[got.who >= 0], got[got.who < 0]
        grad, curve = np.zeros(n), np.zeros(n)
        grad[one.who], curve[one.who] = one.g, one.h
        step = np.clip((grad + 1 - ability) / (curve + 1), -1, 1)
        ability = np.clip(ability + step, -6, 6)
        prior = _prior(share.g.iloc[0], share.h.iloc[0])
        if np.abs(step).max() < p.tolerance:
            break
    return Fit(items, number, prior, held=sc.broadcast(ability))


def _beside(items: DataFrame, table: DataFrame) -> DataFrame:
    """Items with each vote's ability beside it, in the same order."""
    one = items.select("claim", F.explode("who").alias("who")).withColumn("number", F.shiftright("who", 1)).join(table, "number")
    both = one.groupBy("claim").agg(F.sort_array(F.collect_list(F.struct("who", "ability"))).alias("x"))
    return both.select("claim", F.transform("x", lambda x: x["who"]).alias("who"), F.transform("x", lambda x: x["ability"]).alias("ability"))


def _fit_table(items: DataFrame, number: DataFrame, p: Glad) -> Fit:
    """The abilities stay in a table; only three sums a round reach the driver."""
    table, prior = number.select("number", F.lit(1.0).alias("ability")), 0.0
    for _ in range(p.rounds):
        got = cut(_beside(items, table).mapInArrow(_sums(None, prior, p), _SUMS).groupBy("who").agg(F.sum("g").alias("g"), F.sum("h").alias("h")))
        step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.coalesce("g", F.lit(0.0)) + 1 - F.col("ability")) / (F.coalesce("h", F.lit(0.0)) + 1)))
        new = cut(table.join(got.withColumnRenamed("who", "number"), "number", "left").select("number", F.greatest(F.lit(-6.0), F.least(F.lit(6.0), F.col("ability") + step)).alias("ability"), F.abs(step).alias("step")))
        share = got.where("who < 0").first()
        prior = _prior(share.g, share.h)
        table = new.select("number", "ability")
        if new.agg(F.max("step")).first()[0] < p.tolerance:
            break
    return Fit(items, number, prior, table=table)


def consensus(assertions: DataFrame, least_sources: int = 3, p: Glad = Glad()) -> DataFrame:
    """(claim, consensus, probability, ease, sources, agreement) of each claim with positions of `least_sources` sources or more.

    probability: of the consensus. agreement: share of the sources that hold it. At even odds the consensus
    is supports. An empty table gives an empty result."""
    f = fit(assertions, p)
    prior, held = f.prior, f.held

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            item, _, vote, a = _votes(b, held.value if held else None)
            ease, odds = settle(item, a, vote, b.num_rows, prior, p)
            yes = odds >= 0
            n = np.bincount(item, minlength=b.num_rows)
            agree = np.bincount(item, (vote > 0) == yes[item], b.num_rows) / np.maximum(n, 1)
            keep = pa.array(n >= least_sources)
            t = pa.RecordBatch.from_arrays([b.column("claim"), pa.array(np.where(yes, SUPPORTS, CONTRADICTS)), pa.array(_sigmoid(np.abs(odds))), pa.array(ease), pa.array(n, pa.int64()), pa.array(agree)], ["claim", "consensus", "probability", "ease", "sources", "agreement"])
            yield t.filter(keep)

    items = f.items if held else _beside(f.items, f.table)
    return items.mapInArrow(label, "claim string, consensus string, probability double, ease double, sources bigint, agreement double")


def reliability(assertions: DataFrame, p: Glad = Glad()) -> DataFrame:
    """(source, positions, ability, accuracy): accuracy is the probability of being right on an item of ease 1."""
    f = fit(assertions, p)
    table = f.table
    if table is None:
        table = assertions.sparkSession.createDataFrame([(i, float(a)) for i, a in enumerate(f.held.value)], "number bigint, ability double")
    return f.number.join(table, "number").select("source", F.col("n").alias("positions"), "ability", (1 / (1 + F.exp(-F.col("ability")))).alias("accuracy"))


def agreement(assertions: DataFrame) -> DataFrame:
    """One row: claims with two or more positions, their positions, observed and expected agreement of two positions of a
    claim, and Krippendorff's alpha for nominal labels; null where nothing can be expected."""
    c = positions(assertions).groupBy("claim").agg(F.count("*").alias("n"), F.sum((F.col("vote") > 0).cast("bigint")).alias("s")).where("n >= 2")
    t = c.agg(
        F.count("*").alias("claims"), F.coalesce(F.sum("n"), F.lit(0)).alias("positions"), F.coalesce(F.sum("s"), F.lit(0)).alias("s"),
        F.sum(2.0 * F.col("s") * (F.col("n") - F.col("s")) / (F.col("n") - 1)).alias("apart"),
    )
    n, s = F.col("positions"), F.col("s")
    observed = F.col("apart") / F.nullif(n, F.lit(0))
    expected = 2.0 * s * (n - s) / F.nullif(n * (n - 1), F.lit(0))
    return t.select("claims", "positions", F.round(1 - observed, 9).alias("observed"), F.round(1 - expected, 9).alias("expected"), F.round(1 - observed / F.when(expected > 0, expected), 9).alias("alpha"))
