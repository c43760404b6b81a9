"""Similar vectors: recall against brute force, odd vectors, copies, hot cells split into blocks."""

from dataclasses import replace

import numpy as np
import pytest

pytest.importorskip("factloom.llm")
from factloom.llm import ann  # noqa: E402

SCHEMA = "id bigint, ns string, vector array<float>"
P = ann.Index(dim=16, sample=2000, cells=32, words=16, probes=8, reach=0.4, near=0.2)


def clusters(n, each, dim, rng, spread=0.35):
    c = rng.standard_normal((n, dim))
    c /= np.sqrt((c * c).sum(1, keepdims=True))
    return np.repeat(c, each, 0) + spread / np.sqrt(dim) * rng.standard_normal((n * each, dim))


def brute(q, x, k, least):
    u = lambda y: y / np.sqrt((y * y).sum(1, keepdims=True))
    s = np.clip(u(q.astype(float)) @ u(x.astype(float)).T, -1, 1)
    out = set()
    for i in range(len(q)):
        j = [a for a in range(len(x)) if s[i, a] >= least]
        out |= {(i, a) for a in sorted(j, key=lambda a: (-s[i, a], a))[:k]}
    return out


def table(spark, x, ns="a"):
    return spark.createDataFrame([(i, ns, v.tolist()) for i, v in enumerate(x)], SCHEMA)


def pairs(df):
    return {(r["query"], r.row) for r in df.collect()}


def test_recall_and_precision(spark):
    rng = np.random.default_rng(0)
    x = clusters(60, 20, 16, rng).astype(np.float32)
    q = x[rng.choice(len(x), 80, replace=False)] + (0.05 * rng.standard_normal((80, 16))).astype(np.float32)
    want, got = brute(q, x, 10, 0.85), pairs(ann.similar(table(spark, q), table(spark, x), p=P))
    assert len(want) > 300 and len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_odd_vectors_ties_copies_and_scopes(spark):
    v = [1.0] + [0.0] * 15
    rows = [(3, "a", v), (1, "a", [2.0] + [0.0] * 15), (2, "a", v), (2, "a", v), (4, "b", v), (5, "a", None), (6, "a", []), (7, "a", v[:8]), (8, "a", [0.0] * 16), (9, "a", [float("nan")] + v[1:]), (10, "a", [float("inf")] + v[1:]), (11, None, v), (None, "a", v), (12, "a", [None] + v[1:]), (13, "a", [1e-30] + v[1:]), (14, "a", [3e38] + v[1:])]
    q = [(1, "a", v), (1, "a", v), (2, "c", v), (3, "a", None), (4, "a", [0.0] * 15 + [1.0])]
    got = ann.similar(spark.createDataFrame(q, SCHEMA), spark.createDataFrame(rows, SCHEMA), k=4, p=P)
    assert [(r["query"], r.row) for r in got.orderBy("query", "row").collect()] == [(1, 1), (1, 2), (1, 3), (1, 13)]


def test_hot_cell_is_split_not_cut(spark):
    """A third of all rows in one cell, some of them exact copies, with blocks far smaller than the cell."""
    rng = np.random.default_rng(1)
    hot = np.tile(rng.standard_normal(16), (300, 1)) + 0.02 * rng.standard_normal((300, 16))
    hot[:100] = hot[0]
    x = np.concatenate([hot, clusters(30, 20, 16, rng)]).astype(np.float32)
    q = np.concatenate([hot[::5], x[300::40]]).astype(np.float32)
    got = pairs(ann.similar(table(spark, q), table(spark, x), p=replace(P, block=16)))
    assert got == brute(q, x, 10, 0.85)


def test_empty_tables_and_extra_columns(spark):
    from pyspark.sql import functions as F

    some, none = table(spark, np.eye(16)[:3]), spark.createDataFrame([], SCHEMA)
    for a, b in ((some, none), (none, some), (none, none)):
        assert ann.similar(a, b, p=P).collect() == []
    clash = some.withColumns({"query": F.lit(1), "row": F.lit(2), "cell": F.lit("x"), "side": F.lit(None)})
    assert pairs(ann.similar(clash, clash, p=P)) == {(0, 0), (1, 1), (2, 2)}


def test_codes_lower_the_error():
    rng = np.random.default_rng(2)
    x = clusters(50, 30, 16, rng)
    c = ann.Codebooks(x.astype(np.float32), P)
    u = ann.unit(x)
    cell = (u @ c.cells.T).argmax(1)
    _, coded = c.encode(u, cell)
    _, greedy = ann.Codebooks(x.astype(np.float32), replace(P, beam=1)).encode(u, cell)
    err = lambda y: ((u - y) ** 2).sum(1).mean()
    assert err(coded) < 0.6 * err(c.cells[cell]) and err(coded) <= err(greedy) + 1e-9


def test_few_usable_vectors_among_many_others(spark):
    other = [(i, "x", [1.0, 2.0]) for i in range(2000)]
    rows = spark.createDataFrame(other + [(3000, "x", [1.0] * 64)], "id bigint, ns string, vector array<float>")
    queries = spark.createDataFrame([(1, "x", [1.0] * 64)], "id bigint, ns string, vector array<float>")
    got = ann.similar(queries, rows, p=ann.Index(sample=16)).collect()
    assert [(r.query, r.row) for r in got] == [(1, 3000)]


def test_cells_grow_with_the_rows():
    p = ann.Index()
    assert [p.of(n).cells for n in (0, 10**5, 10**6, 10**8)] == [4096, 4096, 5000, 16384]
    assert p.of(10**8).sample == 131072 and p.of(10).sample == 32768


def test_recall_with_production_parameters(spark):
    """All requests against all writes of the larger tables, as p3_found has them."""
    import os

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    read = lambda t, i: spark.read.parquet(f"{folder}/{t}.parquet").selectExpr(f"{i} as id", "ns", "vector").where("ns is not null").dropDuplicates(["id"])
    w, q = read("write_requests", "write_id"), read("retrieve_requests", "retrieve_id")
    found = pairs(ann.similar(q, w))
    want = set()
    (wi, wn, wx), (qi, qn, qx) = ((r.column("id").to_numpy()[at], np.array(r.column("ns").to_pylist())[at], x) for r in (w.toArrow(), q.toArrow()) for at, x in [ann.matrix(r.column("vector"), 64)])
    for ns in set(wn):
        a, b = np.flatnonzero(wn == ns), np.flatnonzero(qn == ns)
        want |= {(int(qi[b[i]]), int(wi[a[j]])) for i, j in brute(qx[b], wx[a], 10, 0.85)}
    assert len(want) > 15000 and len(found & want) >= 0.999 * len(want) and len(found - want) <= 0.001 * len(want)
