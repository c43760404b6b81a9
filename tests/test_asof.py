"""Attributes as of event time and missing references, against brute force and odd inputs."""

import random
from datetime import datetime, timedelta

import pytest

from factloom.operators import asof, timeline

T0 = datetime(2025, 1, 1)
VERSIONS = "ns string, id string, version_no bigint, valid_from timestamp_ntz, valid_until timestamp_ntz, tx_time timestamp_ntz, note string"
EVENTS = "event string, ns string, entity string, at timestamp_ntz"
CHILDREN = "child string, endpoint string, target string, scope string, ref string, at timestamp_ntz"
PARENTS = "target string, scope string, key string, begin bigint, until bigint"
A, B = "8f2c7f15-90b6-4fe2-9952-e8011511ee10", "794065fd-c74b-4ee1-b026-45141d89aa97"


def hour(h):
    return None if h is None else T0 + timedelta(hours=h)


def best(versions, ns, entity, t):
    ok = [v[2] for v in versions if v[0] == ns and v[1] == entity and v[5] is not None and v[5] <= t and (v[3] or v[5]) <= t and (v[4] is None or t <= v[4])]
    return max(ok, default=None)


@pytest.mark.parametrize("hot", [False, True])
def test_versions_match_brute_force(spark, hot):
    """With one entity holding most rows, the scan crosses partitions and still carries what is open."""
    r = random.Random(5)
    keys = [A] if hot else [A, B, "not-a-uuid"]
    versions = []
    for k in keys:
        for n in range(1, 120 if hot else 15):
            tx = r.choice([None, *[r.randrange(300) for _ in range(9)]])
            versions.append(("x", k, n, hour(r.choice([None, r.randrange(300)])), hour(r.choice([None, r.randrange(300)])), hour(tx), "n"))
    versions += versions[:5]
    events = [(f"e{i}", "x", r.choice(keys), hour(r.randrange(-5, 310))) for i in range(400)]
    want = {(e, k, best(versions, "x", k, t)) for e, _, k, t in events} - {(e, k, None) for e, _, k, _ in events}
    got = asof.versions_at_events(spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS))
    assert {(x.event, x.entity, x.version_no) for x in got.collect()} == want


def test_spellings_nulls_and_attributes(spark):
    versions = spark.createDataFrame([("x", A, 1, None, None, hour(0), "one"), ("x", A, 1, None, None, hour(0), "one"), ("x", A, 2, hour(5), hour(8), hour(1), "two"), ("x", B, 1, None, None, None, "never"), (None, A, 3, None, None, hour(0), "nowhere")], VERSIONS)
    events = [("a", "x", "{" + A + "}", hour(6)), ("b", "x", "urn:uuid:" + A.upper(), hour(8)), ("c", "x", f" {A.replace('-', '')}\t", hour(9)), ("d", "x", B, hour(9)), ("e", None, A, hour(9)), ("f", "x", None, hour(9)), ("g", "x", A, None), ("h", "y", A, hour(9)), ("a", "x", "{" + A + "}", hour(6))]
    got = asof.versions_at_events(spark.createDataFrame(events, EVENTS), versions, ["note"])
    assert sorted((x.event, x.version_no, x.note) for x in got.collect()) == [("a", 2, "two"), ("b", 2, "two"), ("c", 1, "one")]


def test_empty_tables(spark):
    v, e = spark.createDataFrame([], VERSIONS), spark.createDataFrame([], EVENTS)
    one = spark.createDataFrame([("a", "x", A, hour(1))], EVENTS)
    assert asof.versions_at_events(e, v).collect() == []
    assert asof.versions_at_events(one, v).collect() == []
    c, p = spark.createDataFrame([], CHILDREN), spark.createDataFrame([], PARENTS)
    assert asof.orphan_references(c, p).collect() == []
    child = spark.createDataFrame([("c", "src", "nodes", "x", A, hour(1))], CHILDREN)
    assert [(r.child, r.endpoint) for r in asof.orphan_references(child, p).collect()] == [("c", "src")]


def test_extra_columns_with_clashing_names(spark):
    from pyspark.sql import functions as F

    v = spark.createDataFrame([("x", A, 1, None, None, hour(0), "one")], VERSIONS).withColumns({"k": F.lit(1), "ts": F.lit("t"), "event": F.lit(2), "found": F.lit(3)})
    e = spark.createDataFrame([("a", "x", A, hour(1))], EVENTS).withColumns({"number": F.lit(1), "until": F.lit(2), "kind": F.lit(0), "version_no": F.lit(9)})
    assert [r.version_no for r in asof.versions_at_events(e, v).collect()] == [1]


def test_orphans(spark):
    us = lambda h: int((hour(h) - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    parents = [("nodes", "x", A, us(1), us(5)), ("nodes", "x", A, us(10), None), ("sources", "*", B, us(3), None), ("nodes", "x", "free", None, None)]
    rows = [("1", A, 0, True), ("2", A, 1, False), ("3", A, 5, False), ("4", A, 6, True), ("5", A.upper(), 50, False), ("6", "free", 9, True), ("7", "unknown", 9, True), ("8", " ", 9, None), ("9", None, 9, None), ("10", A, None, True)]
    children = [(c, "src", "nodes", "x", ref, hour(h)) for c, ref, h, _ in rows] + [("11", "dst", "sources", "*", B, hour(2)), ("12", "dst", "sources", "*", B, hour(3)), ("13", "src", "nodes", None, A, hour(20)), ("1", "src", "nodes", "x", A, hour(0))]
    got = asof.orphan_references(spark.createDataFrame(children, CHILDREN), spark.createDataFrame(parents, PARENTS))
    assert {r.child for r in got.collect()} == {c for c, _, _, orphan in rows if orphan} | {"11", "13"}
    assert got.count() == len({c for c, _, _, orphan in rows if orphan}) + 2
    months = {(r.target, r.month): r.orphans for r in asof.orphan_counts(got).collect()}
    assert months == {("nodes", "2025-01"): 5, ("nodes", None): 1, ("sources", "2025-01"): 1}


def test_found_rows_survive_a_union(spark):
    """Which partition inherits what doesn't depend on where the result stands in a plan."""
    versions = spark.createDataFrame([("x", A, n, hour(n), None, hour(0), "n") for n in range(1, 300)], VERSIONS)
    events = spark.createDataFrame([(f"e{i}", "x", A, hour(i)) for i in range(1, 200)], EVENTS)
    line = timeline.Line(asof._changes(asof.version_spans(versions)).unionByName(events.selectExpr("ns||'\x1f'||entity as k", "unix_micros(cast(at as timestamp)) as ts", "1 as kind", "event as tie"), allowMissingColumns=True))
    got = line.counted(lambda kind, ts, c, top, has: kind == timeline.EVENT, ["tie"])
    both = spark.range(7).selectExpr("'x' as tie", "id as c", "id as top").union(got).where("tie <> 'x'")
    assert {(r.tie, r.c, r.top) for r in both.collect()} == {(f"e{i}", i, i) for i in range(1, 200)}


def test_many_versions_of_one_entity(spark, monkeypatch):
    """Blocks of changes: with small blocks, many are looked up above them."""
    monkeypatch.setattr(timeline, "BLOCK", 3)
    r = random.Random(9)
    versions = [("x", A, n, hour(b), hour(b + r.choice([0, 1, 30, 3000])) if r.random() < 0.9 else None, hour(b), "n") for n in range(1, 400) for b in [r.randrange(3000)]]
    events = [(f"e{i}", "x", A, hour(r.randrange(-5, 6000))) for i in range(500)]
    want = {(e, best(versions, "x", A, t)) for e, _, _, t in events}
    got = asof.versions_at_events(spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS))
    assert {(x.event, x.version_no) for x in got.collect()} == {w for w in want if w[1] is not None}
