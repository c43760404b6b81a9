"""The handle: writing, retrieval, ingestion, labels, the language, on a small store."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.client import Engine
from factloom.operators import extract, filters, retrieve, write

T0 = datetime(2025, 3, 1)
ROWS = "write_id bigint, content string, source_id string, labels array<string>, vector array<float>, dedup boolean"


def vec(seed, dim=64):
    x = np.random.default_rng(seed).standard_normal(dim)
    return (x / np.sqrt((x * x).sum())).tolist()


def near(x, s, seed, dim=64):
    """A vector of cosine s with x."""
    y = np.array(vec(seed, dim))
    x = np.array(x)
    y -= (y @ x) * x
    return (s * x + np.sqrt(1 - s * s) * y / np.sqrt(y @ y)).tolist()


@pytest.fixture(scope="module")
def engine(spark):
    a = vec(1)
    e = Engine(spark, embed=lambda text: a)
    rows = [(1, "The valve is open", "ann", ["Fact"], a, True), (2, "The  valve is OPEN!", "bob", ["Fact"], vec(2), True), (3, "Nothing known", "ann", ["Claim"], vec(3), True), (4, None, "ann", None, None, None), (4, None, "ann", None, None, None), (5, " ", None, [], [], True)]
    e.results = {r.write_id: r for r in e.namespace("x", "belief").write(spark.createDataFrame(rows, ROWS), T0).collect()}
    return e


def test_a_batch_is_judged_once(engine):
    r = engine.results
    assert sorted(r) == [1, 2, 3, 4, 5] and r[1].reason == "admitted" and (r[2].reason, r[2].node_id) == ("repeats", r[1].node_id) and all(r[i].admitted for i in r)
    assert r[1].confidence == 0.25 and len({r[i].node_id for i in (1, 3, 4, 5)}) == 4
    assert engine.stats() | {"edges": 0} == {"nodes": 4, "edges": 0, "sources": 2, "entries": 2, "latest": 4} and engine.ping()["status"] == "ok"


def test_later_batches_see_what_is_stored(spark, engine):
    s, a = engine.namespace("x", "belief"), vec(1)
    rows = [(11, "the valve is open", "ann", ["Fact"], a, True), (12, "A copy", "ann", ["Fact"], near(a, 0.97, 7), False), (13, "The valve is closed", "ann", ["Fact"], near(a, 0.6, 8), False)]
    got = {r.write_id: r for r in s.write(spark.createDataFrame(rows, ROWS), T0 + timedelta(hours=1)).collect()}
    assert (got[11].reason, got[11].node_id) == ("deduplicated", engine.results[1].node_id)
    assert (got[12].reason, got[12].node_id, got[12].admitted) == ("near_duplicate", None, False)
    assert got[13].admitted and got[13].conflicts == [engine.results[1].node_id]
    assert [r.version_no for r in s.history(engine.results[1].node_id).collect()] == [1, 2]
    edge = engine.tables["edges"].first()
    assert (edge.src, edge.dst, edge.edge_type) == (got[13].node_id, engine.results[1].node_id, "contradicts") and edge.weight >= 0.5
    q = spark.createDataFrame([(1, a)], "retrieve_id bigint, vec array<double>")
    best = s.retrieve(q, now=T0 + timedelta(hours=2)).collect()
    assert best[0].id == engine.results[1].node_id and [r.rank for r in best] == sorted(r.rank for r in best)
    assert [r.id for r in s.stream_retrieve(q, now=T0 + timedelta(hours=2), labels=["Claim"])] == [engine.results[3].node_id][: len(list(s.stream_retrieve(q, now=T0 + timedelta(hours=2), labels=["Claim"])))]
    assert s.as_of(T0).count() == 4 and s.acquisitions(2, T0 + timedelta(hours=3)).count() == 2


def test_contents_are_embedded(spark):
    e = Engine(spark, auto_embed=True)
    got = e.namespace("x").write(spark.createDataFrame([(1, "a text", "ann", None, None, False), (2, None, "ann", None, None, False)], ROWS), T0)
    assert got.where("admitted").count() == 2 and e.tables["entries"].count() == 1
    assert [r.rank for r in e.namespace("x").search("a text", now=T0 + timedelta(hours=1)).collect()] == [1]


def test_untrusted_sources_are_kept_out(spark, engine):
    s = engine.namespace("y")
    rows = lambda i: spark.createDataFrame([(i, f"claim {i}", "troll", [], vec(i), False)], ROWS)
    assert s.write(rows(100), T0).first().admitted
    s.label_source("troll", ["flagged"], T0)
    assert s.write(rows(101), T0).first().reason == "low_credibility"


def test_ingest_text_and_language(spark, engine):
    def model(text):
        if "broken" in text:
            return "no json"
        return "```json\n" + json.dumps({"entities": [{"name": w, "type": "Word"} for w in text.split()], "relations": [{"subject": text.split()[0], "predicate": "before", "object": text.split()[-1]}, {"subject": "?", "predicate": "x", "object": "?"}]}) + "\n```"

    s = engine.namespace("z", "belief")
    texts = spark.createDataFrame([(1, "Ada Bob Cid", "ann"), (2, "broken", "ann"), (3, None, "ann")], "text_id bigint, text string, source_id string")
    got = s.ingest_text(texts, model, T0).collect()
    assert len(got) == 3 and all(r.admitted for r in got)
    edges = engine.tables["edges"].where("ns = 'z'").collect()
    assert [(e.edge_type, e.weight) for e in edges] == [("before", 0.8)]
    assert engine.tables["sources"].where("ns = 'z'").first().claims_asserted == 3
    out = engine.query('search "Ada" | in x | rerank | top 2 | return ns, id, score', T0 + timedelta(hours=5)).collect()
    assert sorted(r.score for r in out) == [0.5, 1.0] and {r.ns for r in out} == {"x"}


def test_answers_of_models(spark):
    a = spark.createDataFrame([(1, "x", '{"content": "c", "labels": ["l"], "epistemic_type": "inference", "confidence": 0.4}'), (2, "x", "```{\"content\": \"d\"}```"), (3, "x", "[1]"), (4, "x", None)], "text_id bigint, ns string, answer string")
    got = {r.text_id: (r.content, r.labels, r.confidence, r.epistemic_type, r.error is None) for r in extract.claims(a).collect()}
    assert got == {1: ("c", ["l"], 0.4, "inference", True), 2: ("d", [], 0.7, "assertion", True), 3: (None, [], None, None, False), 4: (None, [], None, None, False)}
    assert retrieve.parsed_ranking("3, 1,x, 9,3 ,2nd", 4) == [3, 1, 2, 4] and retrieve.parsed_ranking("", 2) == [1, 2]
    assert "Text 2: b" in retrieve.ranking_prompt("q", ["a", "b"])


def test_filter_trees(spark):
    n = spark.createDataFrame([("x", str(i), c, conf, s, T0, None) for i, (c, conf, s) in enumerate([("Red valve", 0.9, "ann"), ("blue pump", 0.2, None), (None, None, "bob")])], "ns string, id string, content string, confidence double, source_id string, valid_from timestamp_ntz, valid_until timestamp_ntz")
    e = spark.createDataFrame([("e", "x", "1", "0", "cites", 0.7, T0, None, T0, None)], "id string, ns string, src string, dst string, edge_type string, weight double, valid_from timestamp_ntz, valid_until timestamp_ntz, tx_time timestamp_ntz, invalidated_at timestamp_ntz")
    c = spark.createDataFrame([("x", "ann", 0.8)], "ns string, source_id string, credibility double")
    t = F.lit(T0 + timedelta(days=1)).cast("timestamp_ntz")
    ids = lambda tree: sorted(r.id for r in filters.matching(n, tree, e, c, t).collect())
    assert ids({}) == ids({"or": []}) == ids({"and": [{}]}) == ["0", "1", "2"]
    assert ids({"contentContains": "RED"}) == ["0"] and ids({"not": {"contentContains": "red"}}) == ["1", "2"]
    assert ids({"edgeTypes": ["cites"], "edgeWeightMin": 0.5}) == ["1"] == ids({"hasEdgeTo": ["0"]}) and ids({"edgeTypes": ["supports"]}) == [] == ids({"hasEdgeTo": ["2"]})
    assert ids({"sourceCredibilityMin": 0.5}) == ["0"] and ids({"not": {"sourceCredibilityMax": 0.9}}) == ["1", "2"]
    assert ids({"or": [{"confidenceMin": 0.5}, {"hasEdgeTo": ["0"]}]}) == ["0", "1"] and ids({"validToAfter": "2025-01-01"}) == []
    with pytest.raises(ValueError, match="no filter"):
        ids({"colour": "red"})


def test_edges_and_entries(spark):
    schema = "id string, ns string, src string, dst string, edge_type string, weight double, tx_time timestamp_ntz, invalidated_at timestamp_ntz"
    old = spark.createDataFrame([("a", "x", "1", "2", "cites", 0.5, T0, None), ("b", "x", "2", "3", "cites", 0.5, T0, None)], schema)
    new = spark.createDataFrame([("a", "x", "9", "9", "other", 0.9, T0, None), ("c", "x", "4", "5", "cites", 0.1, T0, None), ("c", "x", "4", "5", "cites", 0.1, T0, None)], schema)
    up = write.upsert_edges(old, new)
    assert sorted((r.id, r.src, r.edge_type, r.weight) for r in up.collect()) == [("a", "1", "cites", 0.9), ("b", "2", "cites", 0.5), ("c", "4", "cites", 0.1)]
    done, missing = write.invalidate_edges(up, spark.createDataFrame([("b",), ("z",)], "id string"), F.lit(T0).cast("timestamp_ntz"))
    assert {r.id: r.invalidated_at for r in done.collect()} == {"a": None, "b": T0, "c": None} and [r.id for r in missing.collect()] == ["z"]
    e = spark.createDataFrame([(1, "old"), (2, "kept")], "write_id bigint, content string")
    after = write.index_entries(e, spark.createDataFrame([(1, "new"), (3, "more")], "write_id bigint, content string"))
    assert sorted(map(tuple, after.collect())) == [(1, "new"), (2, "kept"), (3, "more")] and write.delete_entries(after, e).count() == 1
