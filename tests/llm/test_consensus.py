"""Consensus: accuracy on simulated sources, among them colluding liars; the rules of positions."""

from datetime import datetime, timedelta

import numpy as np
import pytest

pytest.importorskip("factloom.llm")
from factloom.llm import consensus  # noqa: E402

SCHEMA = "assertion_id bigint, claim_id string, source_id string, assertion_type string, asserted_at timestamp_ntz"
T0 = datetime(2025, 1, 1)


def test_beats_the_majority(spark):
    rng = np.random.default_rng(0)
    skill = np.concatenate([np.full(14, 0.9), np.full(8, 0.5), np.full(12, 0.15)])
    truth = rng.random(600) < 0.5
    rows, majority = [], []
    for c in range(600):
        who = rng.choice(len(skill), 9, replace=False)
        right = rng.random(9) < skill[who]
        says = np.where(right, truth[c], ~truth[c])
        majority.append((says.mean() > 0.5) == truth[c])
        rows += [(len(rows) + i, f"c{c}", f"s{w}", "supports" if y else "contradicts", T0) for i, (w, y) in enumerate(zip(who, says))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = consensus.consensus(df).collect()
    accuracy = np.mean([(r.consensus == "supports") == truth[int(r.claim[1:])] for r in got])
    assert len(got) == 600 and accuracy > 0.95 and accuracy > np.mean(majority) + 0.2
    rel = {r.source: r.accuracy for r in consensus.reliability(df).collect()}
    assert np.mean([rel[f"s{i}"] for i in range(14)]) > 0.85 and abs(np.mean([rel[f"s{i}"] for i in range(14, 22)]) - 0.5) < 0.1 and np.mean([rel[f"s{i}"] for i in range(22, 34)]) < 0.25
    assert all(0.5 <= r.probability <= 1 and 0 <= r.agreement <= 1 for r in got)


def test_positions(spark):
    u = "8f2c7f15-90b6-4fe2-9952-e8011511ee10"
    h = lambda n: T0 + timedelta(hours=n)
    rows = [(1, u, "s", " Supports", h(0)), (2, u.upper(), "s", "CONTRADICTS ", h(1)), (3, u, "t", "supports", h(1)), (4, u, "t", "abstains", h(2)), (5, u, "v", "supports", h(1)), (6, u, "v", "contradicts", h(1)), (6, u, "v", "contradicts", h(1)), (7, u, "w", "supports", None), (8, u, "w", "contradicts", h(0)), (9, None, "s", "supports", h(0)), (10, u, None, "supports", h(0)), (11, u, " ", "supports", h(0)), (12, u, "x", None, h(0)), (13, u, "y", "unknown", h(0))]
    got = consensus.positions(spark.createDataFrame(rows, SCHEMA))
    assert {(r.claim, r.source): r.vote for r in got.collect()} == {(u, "s"): -1, (u, "v"): -1, (u, "w"): -1}


def test_small_and_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert consensus.consensus(none).collect() == [] and consensus.reliability(none).collect() == []
    assert consensus.agreement(none).first()[:] == (0, 0, None, None, None)
    two = spark.createDataFrame([(1, "c", "a", "supports", T0), (2, "c", "b", "supports", T0)], SCHEMA)
    assert consensus.consensus(two).collect() == []
    assert [r.consensus for r in consensus.consensus(two, least_sources=2).collect()] == ["supports"]


def test_extra_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, "c", s, "contradicts", T0) for i, s in enumerate("abc")], SCHEMA).withColumns({"claim": F.lit(1), "source": F.lit(2), "vote": F.lit("x"), "who": F.lit(0)})
    assert [(r.claim, r.consensus) for r in consensus.consensus(df).collect()] == [("c", "contradicts")]


def test_agreement_is_krippendorffs(spark):
    rows = [("a", "1", 1), ("a", "2", 1), ("a", "3", 0), ("b", "1", 0), ("b", "2", 0), ("c", "1", 1)]
    df = spark.createDataFrame([(i, c, s, "supports" if v else "contradicts", T0) for i, (c, s, v) in enumerate(rows)], SCHEMA)
    r = consensus.agreement(df).first()
    # coincidences: a has 2 of 3 pairs apart, b none; 5 values, 2 of them supports
    observed, expected = (2 * 2 * 1 / 2) / 5, 2 * 2 * 3 / (5 * 4)
    assert (r.claims, r.positions) == (2, 5) and abs(r.alpha - (1 - observed / expected)) < 1e-9


def test_abilities_as_a_table_give_the_same(spark):
    """More annotators than are sent to the tasks: the same fit over a joined table."""
    rng = np.random.default_rng(5)
    skill, truth = rng.random(20), rng.random(80) < 0.5
    rows = [(c * 100 + i, f"c{c}", f"s{w}", "supports" if (rng.random() < skill[w]) == truth[c] else "contradicts", T0) for c in range(80) for i, w in enumerate(rng.choice(20, 5, replace=False))]
    df = spark.createDataFrame(rows, SCHEMA)
    few, many = consensus.Glad(rounds=6), consensus.Glad(rounds=6, annotators=3)
    one, other = ({r.claim: (r.consensus, round(r.probability, 6), r.sources) for r in consensus.consensus(df, p=p).collect()} for p in (few, many))
    assert one == other and len(one) == 80
    a, b = ({r.source: (r.positions, round(r.ability, 6)) for r in consensus.reliability(df, p=p).collect()} for p in (few, many))
    assert a == b and len(a) == 20
