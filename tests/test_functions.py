"""Formulas: fixed orders, clamps, parities with plain Python."""

import math
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import beta, keys, sm2, text, vector
from factloom.functions.score import MODES, decay_alpha, score, session_factor
from factloom.functions.temporal import edge_active, expiry_class, overlap, valid_at

NOW = datetime(2026, 5, 30, 12)
CASES = [("trusted", 0.72, 0.30, 12, 0.95), ("poison", 0.98, 0.30, 5 / 60, 0.05), ("useful", 0.68, 1.0, 3, 0.65), ("fresh", 0.74, 0.40, 5 / 60, 0.60), ("old", 0.80, 0.80, 240, 0.90)]
SCHEMA = "name string, sim double, utility double, confidence double, valid_from timestamp_ntz, valid_until timestamp_ntz"
t = lambda x: F.lit(x).cast("timestamp_ntz")


def scored(spark, rows, w):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.name: r.s for r in df.select("name", score(F.col("sim"), t(NOW), w).alias("s")).collect()}


@pytest.mark.parametrize("mode,order", [("belief", ["trusted", "useful", "fresh", "old", "poison"]), ("agent", ["useful", "fresh", "poison", "trusted", "old"])])
def test_golden_order(spark, mode, order):
    rows = [(n, s, u, c, NOW - timedelta(hours=h), None) for n, s, u, h, c in CASES]
    got = scored(spark, rows, MODES[mode].weights)
    assert sorted(got, key=lambda n: -got[n].score) == order
    assert round(got["trusted"].score, 4) == (0.7980 if mode == "belief" else 0.6392)
    for s in got.values():
        assert abs(sum(s.breakdown) - s.score) < 1e-12


def test_score_rules(spark):
    rows = [("zero", 0.5, None, 0.0, NOW, None), ("none", 0.5, None, None, NOW, None), ("gone", 0.9, 1.0, 0.9, NOW - timedelta(days=2), NOW - timedelta(days=1)), ("later", 0.9, 1.0, 0.9, NOW + timedelta(days=1), None), ("edge", 0.9, 1.0, 0.9, NOW, NOW), ("wild", 7.0, -3.0, 9.0, NOW, None)]
    got = scored(spark, rows, MODES["general"].weights)
    assert got["zero"].confidence_score == got["none"].confidence_score == 0.5 and got["none"].utility_score == 1.0
    assert got["gone"].score == got["later"].score == 0 and got["edge"].score > 0
    assert (got["wild"].similarity_score, got["wild"].utility_score, got["wild"].confidence_score) == (1.0, 0.0, 1.0)


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_small_columns(spark):
    d = lambda h: t(NOW + timedelta(hours=h))
    r = one(spark, decay_alpha(F.lit("working")), decay_alpha(F.lit(None).cast("string")), session_factor(F.lit(0.9)), session_factor(F.lit(1.0)), session_factor(F.lit(0.5)), expiry_class(d(5), d(0)), expiry_class(d(100), d(0)), expiry_class(d(-1), d(0)), expiry_class(d(999), d(0)), overlap(d(0), d(5), d(5), F.lit(None)), overlap(d(0), d(4), d(5), F.lit(None)))
    assert r[:2] == (999.0, 0.05) and abs(r[2] - 0.75) < 1e-9 and abs(r[3] - 0.5) < 1e-9 and r[4] == 1.0
    assert r[5:] == ("imminent", "approaching", "expired", None, True, False)


def test_validity_bounds(spark):
    df = spark.createDataFrame([(NOW, NOW + timedelta(hours=1), None), (NOW, None, NOW + timedelta(hours=1))], "valid_from timestamp_ntz, valid_until timestamp_ntz, invalidated_at timestamp_ntz")
    end = t(NOW + timedelta(hours=1))
    assert [tuple(r) for r in df.select(valid_at(end), valid_at(end, closed=False), edge_active(end)).collect()] == [(True, False, True), (True, True, False)]


def test_beta(spark):
    f, l = F.lit, lambda *x: F.array(*map(F.lit, x)).cast("array<string>")  # noqa: E741
    low, high = beta.interval(l(), f(8.0), f(2.0), f(20))
    low2, high2 = beta.interval(l(), f(8.0), f(2.0), f(5))
    a, b = beta.shifted(f(3.0), f(2.0), f(-0.5))
    r = one(spark, beta.mean(f(0.0), f(0.0)), beta.variance(f(0.0), f(0.0)), beta.effective(l("verified", "flagged", "admin"), f(9.0), f(1.0)), beta.effective(l("admin"), f(1.0), f(9.0)), low, high, low2, high2, a, b, beta.observation_weight(f(1.0), f(9), f(True)), beta.observation_weight(f(-9.0), f(1), f(False)))
    s = math.sqrt(16 / (100 * 11))
    assert r[:4] == (0.5, 0.25, 0.05, 1.0)
    assert abs(r[4] - (0.8 - 1.96 * s)) < 1e-12 and r[5] == 1.0 and abs(r[6] - (0.8 - 2.94 * s)) < 1e-12 and r[8:10] == (3.0, 7.0)
    assert abs(r[10] - 1.5 * 2 * 1.3) < 1e-12 and r[11] == 0.1


def plain_sm2(qs):
    e, d, n = 2.5, 0, 0
    for q in qs:
        q = max(0, min(5, q))
        e = max(1.3, e + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))
        n = 0 if q < 3 else n + 1
        d = 1 if n <= 1 else 6 if n == 2 else math.floor(d * e + 0.5)
    return e, d, n


def test_sm2_fold(spark):
    seqs = [[], [5], [5, 4, 3], [5, 5, 5, 5, 1, 5], [9, -2, 3, 3, 3, 3]]
    df = spark.createDataFrame([(s,) for s in seqs], "q array<int>")
    got = [r.s for r in df.select(sm2.fold(F.col("q")).alias("s")).collect()]
    for s, g in zip(seqs, got):
        e, d, n = plain_sm2(s)
        assert abs(g.easiness - e) < 1e-9 and (g.interval_days, g.repetitions) == (d, n)


def test_vectors(spark):
    f = lambda *x: F.array(*map(F.lit, x)).cast("array<double>")
    r = one(spark, vector.cosine_similarity(f(1.0, 0.0), f(1.0, 1.0)), vector.cosine_similarity(f(1.0), f(1.0, 1.0)), vector.cosine_similarity(f(0.0, 0.0), f(1.0, 1.0)), vector.midpoint(f(1.0, 0.0), f(0.0, 1.0)), vector.usable(f(1.0, float("nan")), 2), vector.usable(F.lit(None).cast("array<double>"), 2), vector.usable(f(0.0, 0.0), 2), vector.usable(f(0.0, 2.0), 2))
    assert abs(r[0] - 0.5**0.5) < 1e-12 and r[1] == r[2] == 0 and abs(r[3][0] - 0.5**0.5) < 1e-12 and r[4:] == (False, False, False, True)


def test_uuid_spellings(spark):
    u = "8f2c7f15-90b6-4fe2-9952-e8011511ee10"
    said = [u, u.upper(), f"{{{u}}}", f"urn:uuid:{u}", f"URN:UUID:{u.upper()}", u.replace("-", ""), f"  {u}\n", "{" + u, u + "}", u[:-1], " X y ", "", "  ", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, x string")
    got = [r.k for r in df.select("i", keys.uuid_key("x").alias("k")).orderBy("i").collect()]
    assert got == [u] * 7 + ["{" + u, u + "}", u[:-1], "X y", None, None, None]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=20))
def test_normal_form(spark, texts):
    import regex

    def plain(s):
        kept = "".join(c for c in s.replace("Σ", "σ").lower() if regex.match(r"[\p{L}\p{Nd}]", c) or regex.match(r"\p{White_Space}", c))
        return regex.sub(r"\p{White_Space}+", " ", kept).strip(" ")

    texts = [s for s in texts if all(not 0xD800 <= ord(c) <= 0xDFFF and len(c.lower()) == 1 and ord(c) < 0x2C00 for c in s)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    got = [r.n for r in df.select("i", text.normalised("s").alias("n")).orderBy("i").collect()]
    assert got == [plain(s) for s in texts]
