"""Graph, search, ingest, maintenance and calibration operators on small inputs, against plain Python."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import score
from factloom.operators import compaction, epistemics, evaluation, graph, ingest, replication, retrieve, review, search, temporal
from factloom.plans import maintenance
from factloom.sources import store

T0 = datetime(2025, 1, 1)
EDGE = "id string, ns string, src string, dst string, edge_type string, weight double, valid_from timestamp_ntz, valid_until timestamp_ntz, invalidated_at timestamp_ntz"
NODE = "ns string, id string, version_no bigint, labels array<string>, source_id string, confidence double, utility double, mem_type string, tx_time timestamp_ntz, valid_from timestamp_ntz, valid_until timestamp_ntz"
at = lambda h: F.lit(T0 + timedelta(hours=h)).cast("timestamp_ntz")


def edges(spark, pairs, kind="supports", weight=1.0):
    return spark.createDataFrame([(f"{a}-{b}", "x", a, b, kind, weight, T0, None, None) for a, b in pairs], EDGE)


def nodes(spark, ids, conf=0.5):
    return spark.createDataFrame([("x", i, 1, ["A"], "s", conf, 1.0, None, T0, T0, None) for i in ids], NODE)


def seeds(spark, *ids):
    return spark.createDataFrame([("x", i) for i in ids], "ns string, id string")


def test_walk_levels_and_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "b")])
    got = {r.id: r.depth for r in graph.walk(seeds(spark, "a", "a"), e, 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    assert graph.walk(seeds(spark), e, 3).count() == 0


def test_walk_paths_prefers_heavier_edges(spark):
    e = edges(spark, [("a", "b"), ("a", "c")]).unionByName(edges(spark, [("b", "d")], weight=0.1)).unionByName(edges(spark, [("c", "d")], weight=0.9))
    got = {r.id: r.path for r in graph.walk_paths(seeds(spark, "a"), e, 3).collect()}
    assert got["d"] == ["a", "c", "d"] and got["a"] == ["a"]


def test_active_edges(spark):
    rows = [("1", "x", "a", "b", "t", 0.5, T0, None, None), ("2", "x", "a", "b", "t", None, T0, T0 + timedelta(hours=1), None), ("3", "x", "a", "b", "t", 0.9, T0, None, T0 + timedelta(hours=1)), ("4", "x", None, "b", "t", 0.9, T0, None, None)]
    e = spark.createDataFrame(rows, EDGE)
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(graph.active(e, at(1))) == {"1", "2"} and ids(graph.active(e, at(2))) == {"1"} and ids(graph.active(e, at(0), min_weight=0.6)) == {"3"}


def test_chain_stops_at_cycle_and_multiplies(spark):
    e = edges(spark, [("b", "a")], weight=0.5).unionByName(edges(spark, [("c", "b")], weight=0.8)).unionByName(edges(spark, [("a", "c")], weight=0.9))
    got = {r.id: (r.steps, r.compound, r.path) for r in graph.chains(nodes(spark, "abcz", 0.9), e).collect()}
    assert got["a"][0] == 2 and got["a"][2] == ["a", "b", "c"] and abs(got["a"][1] - 0.9 * 0.5 * 0.9 * 0.8 * 0.9) < 1e-12
    assert got["z"] == (0, 0.9, ["z"])


def test_components_match_union_find(spark):
    r = random.Random(3)
    pairs = [(f"{r.randrange(150):03}", f"{r.randrange(150):03}") for _ in range(110)] + [(f"{i:03}", f"{i + 1:03}") for i in range(200, 240)] + [("500", f"{i:03}") for i in range(501, 560)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {x.id: x.component for x in graph.components(edges(spark, pairs)).collect()}
    assert got == {k: find(k) for k in parent}


def test_topological_order():
    order = graph.topological_order({"c": ["b", "elsewhere"], "b": ["a"], "a": []})
    assert order == ["a", "b", "c"]
    for bad in ({"a": ["b"], "b": ["a"]}, {"a": ["a"]}):
        with pytest.raises(ValueError):
            graph.topological_order(bad)


def entries(spark, x, scopes=None, schema="id bigint, scope string, vec array<double>"):
    return spark.createDataFrame([(i, scopes[i] if scopes else "x", v.tolist()) for i, v in enumerate(x)], schema)


def test_topk_is_exact_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 64)
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((300, 8)), rng.standard_normal((20, 8))
    x[10] = x[11]
    got = {}
    for r in search.topk(entries(spark, q), entries(spark, x), 7, -1.0, strict=False).collect():
        got.setdefault(r.query, {})[r["rank"]] = r.row
    u = lambda y: y / np.sqrt((y * y).sum(1, keepdims=True))
    s = np.round(u(q) @ u(x).T, 9)
    for i in range(20):
        want = sorted(range(300), key=lambda j: (-s[i, j], j))[:7]
        assert [got[i][n] for n in range(1, 8)] == want
    assert search.topk(entries(spark, q), entries(spark, x[:0]), 7).count() == 0
    assert search.topk(entries(spark, q, ["y"] * 20), entries(spark, x), 7).count() == 0


REQUEST = "retrieve_id bigint, ns string, vec array<double>, top_k int, labels array<string>, t timestamp_ntz"


def crowded(spark):
    """60 near entries of expired or unlabelled nodes hide 3 farther ones that are valid and labelled A, and 70 valid ones of label B."""
    kinds = [("old", 60, 0.0, ["A"], T0 - timedelta(hours=1)), ("a", 3, 0.5, ["A", "C"], None), ("b", 70, 0.2, ["B"], None)]
    made = [(f"{k}{i:02}", labels, end, [1.0, far + i * 1e-4]) for k, n, far, labels, end in kinds for i in range(n)]
    n = spark.createDataFrame([("x", i, 1, labels, "s", 0.5, 1.0, None, T0 - timedelta(days=1), T0 - timedelta(days=1), end) for i, labels, end, _ in made], NODE)
    e = spark.createDataFrame([(j, "x", i, vec) for j, (i, _, _, vec) in enumerate(made)], "write_id bigint, ns string, node_id string, vec array<double>")
    return n, e


def test_retrieve_filters_before_the_cut(spark):
    n, e = crowded(spark)
    w = score.MODES["general"].weights
    q = spark.createDataFrame([(1, "x", [1.0, 0.0], 20, ["A"], T0), (2, "x", [1.0, 0.0], 60, None, T0), (3, "x", [1.0, 0.0], 5, ["Z"], T0), (4, "y", [1.0, 0.0], 5, None, T0), (5, "x", [1.0, 0.0], 5, None, None)], REQUEST)
    got = {}
    for r in retrieve.retrieve(q, n, e, w, labels=True).collect():
        got.setdefault(r.retrieve_id, []).append(r.id)
    assert sorted(got[1]) == ["a00", "a01", "a02"] and len(got[2]) == 60 and set(got) == {1, 2}


def test_candidates_match_brute_force(spark):
    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((300, 8)), rng.standard_normal((12, 8))
    r = random.Random(5)
    ends = [r.choice([None, T0, T0 + timedelta(hours=9)]) for _ in x]
    tags = [r.sample("ABC", r.randrange(4)) for _ in x]
    n = spark.createDataFrame([("x", f"{i:03}", 1, tags[i], "s", 0.5, 1.0, None, T0, T0, ends[i]) for i in range(300)], NODE)
    e = spark.createDataFrame([(i, "x", f"{i:03}", v.tolist()) for i, v in enumerate(x)], "write_id bigint, ns string, node_id string, vec array<double>")
    ask = [(i, T0 + timedelta(hours=r.randrange(3) * 6), r.sample("ABC", r.randrange(3))) for i in range(12)]
    req = spark.createDataFrame([(i, "x", q[i].tolist(), 2, want, t) for i, t, want in ask], REQUEST)
    got = {}
    for c in retrieve.allowed_candidates(req, e, n, retrieve.Fusion(candidates=6), labels=True).collect():
        got.setdefault(c.retrieve_id, set()).add(c.id)
    s = (x @ q.T).T / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)
    for i, t, want in ask:
        fit = [j for j in range(300) if s[i, j] > 0 and (ends[j] is None or t <= ends[j]) and set(want) <= set(tags[j])]
        assert got.get(i, set()) == {f"{j:03}" for j in sorted(fit, key=lambda j: -s[i, j])[:8]}


def test_retrieve_takes_the_default_for_no_top_k(spark):
    n, e = crowded(spark)
    q = spark.createDataFrame([(i, "x", [1.0, 0.0], k, None, T0) for i, k in enumerate([0, -3, None, 4])], REQUEST)
    got = retrieve.retrieve(q, n, e, score.MODES["general"].weights).groupBy("retrieve_id").count().collect()
    assert {r.retrieve_id: r["count"] for r in got} == {0: 10, 1: 10, 2: 10, 3: 4}


def test_cells_find_what_topk_finds(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((800, 64)) + 0.6 * rng.standard_normal((20, 64)).repeat(40, 0)
    q = x[::20] + 0.6 * rng.standard_normal((40, 64))
    pairs = lambda df: {(r[0], r[1]) for r in df.select(df.columns[:2]).collect()}
    true = pairs(search.topk(entries(spark, q), entries(spark, x), 10))
    for p, least in ((search.Cells(probes=60), 0.9), (search.Cells(probes=1000), 1.0)):
        assert len(true & pairs(search.topk_cells(entries(spark, q), entries(spark, x), 10, p))) >= least * len(true) == least * 400
    near = pairs(search.pairs_within(entries(spark, x), 0.4, 2.0))
    assert pairs(search.pairs_cells(entries(spark, x), 0.4, 2.0, search.Cells(probes=1000))) == near
    found = pairs(search.pairs_cells(entries(spark, x), 0.4, 2.0, search.Cells(probes=20)))
    assert found <= near and len(found) >= 0.9 * len(near)
    assert search.topk_cells(entries(spark, q), entries(spark, x[:0]), 7).count() == 0


def test_topk_in_chunks_matches_brute_force(spark, monkeypatch):
    """Several chunks of a scope, settled often, equal vectors, vectors that need eight bytes an element and such that don't."""
    monkeypatch.setattr(search, "CHUNK", 30)
    rng = np.random.default_rng(8)
    x = rng.integers(-3, 4, (300, 8)).astype(float)
    x[::7] += rng.standard_normal((43, 8))
    q = np.concatenate([x[:100], rng.standard_normal((50, 8))])
    got = {}
    for r in search.topk(entries(spark, q), entries(spark, x), 5).collect():
        got.setdefault(r.query, []).append((r["rank"], r.row))
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1), 1e-300)[:, None]
    s = np.round(unit(q) @ unit(x).T, 9)
    for i in range(150):
        assert [j for _, j in sorted(got.get(i, []))] == sorted(np.nonzero(s[i] > 0)[0], key=lambda j: (-s[i, j], j))[:5]


def moved(spark):
    """Bytes shuffled in this session."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_retrieve_in_cells_moves_little_and_keeps_all(spark, monkeypatch):
    """No more than four times the input is shuffled; with all cells looked at, and in many chunks, it is the exact search."""
    import os

    from factloom.plans import retrieval

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    before = moved(spark)
    retrieval._in_cells(spark, folder).collect()
    assert moved(spark) - before < 4 * sum(os.path.getsize(f"{folder}/{t}.parquet") for t in ("nodes", "retrieve_requests", "write_requests"))
    monkeypatch.setattr(search, "CHUNK", 50)
    q, n, e = retrieval._parts(spark, folder)
    w, rows = score.MODES["general"].weights, lambda df: sorted(map(tuple, df.collect()))
    all_ = retrieve.Fusion(cells=search.Cells(probes=1 << 20))
    assert rows(retrieve.retrieve(q, n, e, w, f=all_)) == rows(retrieve.retrieve(q, n, e, w))
    assert rows(retrieve.retrieve(q, n, e, w, f=all_, labels=True)) == rows(retrieve.retrieve(q, n, e, w, labels=True))


def test_vector_cells_recall_moves_little(spark):
    """No more than four times the input is shuffled by the exact search, that in cells and their comparison."""
    import os

    from factloom.plans import retrieval

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    before = moved(spark)
    assert retrieval._cells_recall(spark, folder).first().enough
    assert moved(spark) - before < 4 * sum(os.path.getsize(f"{folder}/{t}.parquet") for t in ("retrieve_requests", "write_requests"))


def test_vector_cells_recall_moves_rows_once(spark, monkeypatch):
    """With as many chunks of requests as at 1 GB, less than twice the input is shuffled: one search's rows, and nothing that was found."""
    import os

    from factloom.plans import retrieval

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    monkeypatch.setattr(search, "CHUNK", 50)
    before = moved(spark)
    assert retrieval._cells_recall(spark, folder).first().enough
    assert moved(spark) - before < 2 * sum(os.path.getsize(f"{folder}/{t}.parquet") for t in ("retrieve_requests", "write_requests"))


@pytest.mark.parametrize("probes", [1, 3, 1000])
def test_agreement_is_that_of_the_two_searches(spark, monkeypatch, probes):
    """Several chunks, equal vectors, similarities that are equal to two digits only, scopes of one side only."""
    monkeypatch.setattr(search, "CHUNK", 25)
    monkeypatch.setattr(search, "BLOCK", 16)
    rng = np.random.default_rng(6)
    x, q = rng.standard_normal((400, 8)), rng.standard_normal((120, 8))
    x[::9], q[::5] = x[1], q[1]
    named = lambda a, other: entries(spark, a).withColumn("scope", F.expr(f"CASE WHEN id % 40 = 39 THEN '{other}' WHEN id % 40 = 38 THEN NULL WHEN id % 3 = 0 THEN 'y' ELSE 'x' END"))
    queries, rows, p = named(q, "q"), named(x, "r"), search.Cells(probes=probes)
    true, found = {}, {}
    for r in search.topk(queries, rows, 12).collect():
        true.setdefault(r.query, []).append((-round(r.similarity + 1e-12, 2), r.row))
    for r in search.topk_cells(queries, rows, 6, p).collect():
        found.setdefault(r.query, set()).add(r.row)
    true = {i: {j for _, j in sorted(t)[:6]} for i, t in true.items()}
    want = {i: (len(t), len(t & found.get(i, set()))) for i, t in true.items()}
    same = {}
    for r in queries.collect():
        same.setdefault((r.scope, tuple(r.vec)), []).append(r.id)
    got = {r.query: r for r in search.agreement(queries, rows, 6, of=12, coarse=2, p=p).collect()}
    assert {i: (got[min(ids)].n, got[min(ids)].found) for ids in same.values() if min(ids) in got for i in ids} == want
    assert {i: r.queries for i, r in got.items()} == {min(ids): len(ids) for ids in same.values() if min(ids) in want}
    assert sum(f for _, f in want.values()) < sum(n for n, _ in want.values()) or probes == 1000
    assert search.agreement(queries, rows.limit(0), 6, of=12, coarse=2, p=p).count() == 0


def test_views_with_keys_found_apart(spark, monkeypatch):
    from factloom.sources import views

    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c"), (None, "d"), (None, "d")], "k bigint, v string")
    want = [(1, "a"), (2, "b"), (3, "c"), (None, "d")]
    for few in (1000, 1):
        monkeypatch.setattr(views, "FEW", few)
        assert sorted(map(tuple, views._once(df, "k", True).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_cells_on_the_tables(spark, folder):
    """recall@10 of the index with its own parameters against the exact search, all requests against all entries."""
    import os

    from factloom.plans import retrieval

    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    assert retrieval._cells_recall(spark, folder).first().enough


def test_first_independent_matches_greedy(spark):
    r = random.Random(7)
    for n, m in ((1, 0), (40, 60), (60, 30)):
        pairs = {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)} if n > 1 else set()
        pairs |= {(i, i + 1) for i in range(n - 1) if n == 60}
        leader = {}
        for i in range(n):
            led = [a for a, b in sorted(pairs) if b == i and leader[a] == a]
            leader[i] = min(led) if led else i
        got = ingest.first_independent(spark.range(n), spark.createDataFrame(sorted(pairs), "a bigint, b bigint"))
        assert {x.id: x.leader for x in got.collect()} == leader


def test_leader_clusters_split_above_the_largest(spark):
    x = np.concatenate([np.tile([1.0, 0, 0], (7, 1)), np.tile([0, 1.0, 0], (4, 1)), [[0, 0, 1.0]]])
    got = {}
    for r in compaction.leader_clusters(entries(spark, x, schema="id bigint, ns string, vec array<double>"), smallest=3, largest=4).collect():
        got.setdefault(r.leader, []).append(r.id)
    assert {k: sorted(v) for k, v in got.items()} == {0: [0, 1, 2, 3], 4: [4, 5, 6], 7: [7, 8, 9, 10]}


def test_admission_order(spark):
    df = spark.createDataFrame([(0.05, 0.0), (0.9, 0.95), (0.9, 0.9), (0.9, 0.1)], "c double, m double")
    ok, why = ingest.admission(F.col("c"), F.col("m"), 0.25)
    assert [r.w for r in df.select(why.alias("w")).collect()] == ["low_credibility", "near_duplicate", "below_threshold", "admitted"]


def test_admit_in_order_judges_what_was_not_admitted(spark, tmp_path):
    row = lambda i, ok, x: (i, "x", "s", None, [x] * 63 + [1.0], "", ok, datetime(2025, 5, 2))
    w = spark.createDataFrame([row(1, True, 0.0), row(2, False, 0.0), row(3, None, 1.0)], "write_id bigint, ns string, source_id string, node_id string, vector array<float>, content string, admitted boolean, received_at timestamp_ntz")
    w.write.parquet(f"{tmp_path}/write_requests.parquet")
    source = spark.createDataFrame([("i", "x", "s", [], 9.0, 1.0, T0)], "id string, ns string, external_id string, labels array<string>, alpha double, beta double, created_at timestamp_ntz")
    source.selectExpr("*", "0L as claims_asserted", "0L as claims_validated", "0L as claims_refuted", "created_at as updated_at").write.parquet(f"{tmp_path}/sources.parquet")
    got = maintenance.QUERIES["admit_in_order"](spark, str(tmp_path)).collect()
    assert {r.write_id: r.reason for r in got} == {1: "admitted", 2: "near_duplicate", 3: "admitted"}


def test_admit_in_order_sees_earlier_ones(spark):
    w = spark.createDataFrame([(1, "x", "s", [1.0, 0.0], T0), (2, "x", "s", [1.0, 0.01], T0 + timedelta(1)), (3, "x", "s", [0.0, 1.0], T0), (4, "y", "s", [1.0, 0.0], T0)], "write_id bigint, ns string, source_id string, vec array<double>, received_at timestamp_ntz")
    cred = spark.createDataFrame([("x", "s", 0.9)], "ns string, source_id string, credibility double")
    assert {r.write_id: r.reason for r in ingest.admit_in_order(w, cred).collect()} == {1: "admitted", 2: "near_duplicate", 3: "admitted", 4: "admitted"}


def test_contradiction_score(spark):
    l = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")  # noqa: E731, E741
    s = ingest.contradiction_score
    r = spark.range(1).select(s(l("a", "b"), l("b", "c"), F.lit("x"), F.lit("y")), s(l("a"), l("b"), F.lit("x"), F.lit("y")), s(l("a"), l("a"), F.lit("x"), F.lit("x")), s(l("a"), l("a"), F.lit(None), F.lit("x")), s(F.lit(None).cast("array<string>"), l("a"), F.lit("x"), F.lit("y"))).first()
    assert [round(x, 9) for x in r] == [0.4, 0.0, 0.0, 0.6, 0.0]


def test_extractor_failures_are_skipped(spark):
    def find(t):
        if t == "bad":
            raise RuntimeError
        return [{"name": w} for w in t.split()]

    df = spark.createDataFrame([(1, "a b"), (2, "bad"), (3, None), (4, "")], "id bigint, text string")
    got = ingest.extract(df, find).collect()
    assert sorted((r.id, r.name) for r in got if r.error is None) == [(1, "a"), (1, "b")]
    assert [(r.id, r.name, r.error) for r in got if r.error] == [(2, None, "RuntimeError: ")]


def test_independent_sets_of_large_components_go_in_rounds(spark):
    rng = np.random.default_rng(11)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 60, (120, 2)).tolist() if p[0] != p[1]}
    ids, links = spark.range(70), spark.createDataFrame(list(pairs), "a bigint, b bigint")
    whole = {(r.id, r.leader) for r in ingest.first_independent(ids, links).collect()}
    assert whole == {(r.id, r.leader) for r in ingest.first_independent(ids, links, whole=3).collect()} and len(whole) == 70


def test_feedback_over_days(spark):
    rng = np.random.default_rng(12)
    kinds = ["validated", "refuted", "useful", "stale"]
    rows = [(int(rng.integers(3)), T0 + timedelta(hours=int(rng.integers(900))), i, kinds[rng.integers(4)]) for i in range(300)]
    want = {}
    for i, _, _, k in sorted(rows, key=lambda r: (r[1], r[2])):
        c, u, n = want.get(i, (0.5, 0.5, 0))
        dc, du = ingest.FEEDBACK[k]
        c = 0.05 if dc is None else c if dc == 0 else min(1, max(0, c + dc))
        want[i] = (c, min(1, max(0, u + du)), n + 1)
    got = {r.id: (r.confidence, r.utility, r.events) for r in ingest.feedback_fold(spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, event bigint, outcome string")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-6 and abs(got[k][1] - want[k][1]) < 1e-6 and got[k][2] == want[k][2] for k in want)


def test_upsert_continues_numbers(spark):
    old = spark.createDataFrame([("x", "a", 1, T0, T0), ("x", "a", 2, T0, T0)], "ns string, id string, version_no bigint, tx_time timestamp_ntz, valid_from timestamp_ntz")
    new = spark.createDataFrame([("x", "a", T0, None, 2), ("x", "a", T0, T0, 1), ("x", "b", T0, None, 1)], "ns string, id string, tx_time timestamp_ntz, valid_from timestamp_ntz, seq int")
    got = temporal.upsert(old, new)
    assert sorted((r.id, r.version_no) for r in got.collect()) == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 1)]
    assert got.where("valid_from is null").count() == 0


def test_valid_nodes_do_not_fall_back(spark):
    n = spark.createDataFrame([("x", "a", 1, ["L"], "s", 0.5, 1.0, None, T0, T0, None), ("x", "a", 2, [], "s", 0.5, 1.0, None, T0, T0, None), ("x", "b", 1, None, "s", 0.5, 1.0, None, T0, T0, None)], NODE)
    assert temporal.valid_nodes(n, at(1), ["L"]).count() == 0
    assert {(r.id, r.version_no) for r in temporal.valid_nodes(n, at(1)).collect()} == {("a", 2), ("b", 1)}


def test_mmr_spreads(spark):
    ranked = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.89, 2), (1, "c", 0.5, 3), (1, "d", 0.4, 4)], "retrieve_id bigint, id string, score double, rank int")
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0])], "id string, vec array<double>")
    order = [r.id for r in retrieve.mmr(ranked, vec, 0.5, 3).orderBy("mmr_rank").collect()]
    assert order == ["a", "c", "d"]


def test_rerank_rules(spark):
    ranked = spark.createDataFrame([(1, x, 1.0, i) for i, x in enumerate("abcd", 1)], "retrieve_id bigint, id string, score double, rank int")
    said = lambda order: [r.id for r in retrieve.rerank(ranked, order).orderBy("rerank").collect()]
    assert said(lambda p: [3, 1, 1, 99]) == list("cabd") and said(None) == list("abcd") and said(lambda p: 1 / 0) == list("abcd")


def test_calibration_fits(spark):
    rng = np.random.default_rng(4)
    p = rng.random(3000)
    y = (rng.random(3000) < p**2).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "predicted double, actual int")
    before = epistemics.calibration(df).first()
    after = epistemics.calibration(epistemics.isotonic(df).select(F.col("calibrated").alias("predicted"), "actual")).first()
    assert after.ece < before.ece / 3 and after.brier <= before.brier
    x, v = epistemics.isotonic_fit(df)
    assert (np.diff(v) >= 0).all() and (np.diff(x) >= 0).all()
    a, b = epistemics.platt_fit(df)
    assert a > 0 and epistemics.platt_fit(df.limit(10)) is None
    assert epistemics.platt(df.limit(10)).where("calibrated <> predicted").count() == 0


def test_ir_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query bigint, id string, rank int")
    rel = spark.createDataFrame([(1, "b"), (1, "z"), (1, "b"), (2, "q")], "query bigint, id string")
    got = {r["query"]: r for r in evaluation.ir_metrics(ranked, rel, 2).collect()}
    assert got[1].rr == 0.5 and got[1].recall == 0.5 and got[1].hit and abs(got[1].ndcg - (1 / np.log2(3)) / (1 + 1 / np.log2(3))) < 1e-6
    assert got[2].ndcg == 0 and got[2].first_rank is None and not got[2].hit


def test_replication(spark):
    rows = spark.createDataFrame([("a", 1, T0, "p"), ("a", 2, T0, "p"), ("a", 2, T0, "q"), ("b", 1, None, "p")], "id string, version_no bigint, tx_time timestamp_ntz, origin string")
    assert {(r.id, r.origin) for r in replication.last_writer(rows, ["id"], ["version_no", "tx_time", "origin"]).collect()} == {("a", "q"), ("b", "p")}
    ev = spark.createDataFrame([("s", "1", 3.0, 1.0), ("s", "1", 3.0, 1.0), ("s", "2", 2.0, 4.0)], "k string, u string, alpha double, beta double")
    assert [(r.alpha, r.beta, r.peers) for r in replication.merge_evidence(ev, ["k"], "u").collect()] == [(4.0, 4.0, 2)]


def test_retry(spark):
    rows = [("a", T0, 1, False, 503), ("a", T0 + timedelta(hours=1), 2, True, 200), ("a", T0 + timedelta(hours=2), 3, False, 503), ("b", T0, 4, False, 404), ("b", T0, 5, False, 404), ("c", T0, 6, True, 200)]
    r = review.retry_candidates(spark.createDataFrame(rows, "key string, ts timestamp_ntz, event int, ok boolean, status int"))
    got = {x.key: x for x in review.retry_recommendations(r, at(3)).collect()}
    assert set(got) == {"a", "b"} and got["a"].attempts == 1 and got["a"].ready and not got["b"].ready and got["b"].delay == 120


def test_snapshot_round_trip(spark, tmp_path):
    n = nodes(spark, "ab").select("ns", "id", "version_no", "labels", "confidence", "tx_time", "valid_from", "valid_until")
    e = edges(spark, [("a", "b")])
    s = spark.createDataFrame([("s", "x", "ext")], "id string, ns string, external_id string")
    lines = store.snapshot(n, e, s, at(1))
    store.write_snapshot(lines, str(tmp_path / "snap"))
    back = store.read_snapshot(spark, str(tmp_path / "snap"), {"node": n.schema, "edge": e.schema, "source": s.schema}, ns="y")
    assert {(r.ns, r.id) for r in back["node"].collect()} == {("y", "a"), ("y", "b")}
    assert back["edge"].first().src == "a" and back["source"].count() == 1
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.txt").write_text('{"type": "odd"}\n')
    with pytest.raises(ValueError):
        store.read_snapshot(spark, str(tmp_path / "bad"), {"node": n.schema})


def test_event_log_and_items(spark):
    log = spark.createDataFrame([(1, T0, None), (2, T0 + timedelta(hours=1), False), (3, T0 + timedelta(hours=2), True)], "id bigint, ts timestamp_ntz, processed boolean")
    assert [r.id for r in store.events_since(log, at(0)).collect()] == [2] and store.events_since(log, at(0), True).count() == 2
    done = store.mark_processed(log, spark.createDataFrame([(2,)], "id bigint"))
    assert store.events_since(done, at(-1)).count() == 1
    items = spark.createDataFrame([("a", T0), ("b", None)], "key string, expires_at timestamp_ntz")
    assert [r.key for r in store.kv_get(items, at(1)).collect()] == ["b"] and store.kv_get(items, at(0)).count() == 2
    new = store.kv_put(items, spark.createDataFrame([("a", None)], items.schema))
    assert store.kv_get(new, at(1)).count() == 2
    assert spark.range(1).select(store.kv_expiry(at(0), F.lit(0)), store.kv_expiry(at(0), F.lit(60))).first()[:] == (None, T0 + timedelta(minutes=1))
