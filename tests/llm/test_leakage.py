"""Leaked passages against a plain search for every window."""

import random

import pytest

pytest.importorskip("factloom.llm")
from factloom.llm import leakage  # noqa: E402

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, passages array<string>"
P = leakage.Leak()


def brute(docs, items, p=P):
    """Every window looked for in every text; short passages need a heavier window of the item, or all of an item that has none."""
    out = {}
    for d, t in docs:
        norm = f" {' '.join(leakage.tokens(t or ''))} "
        for i, passages in items:
            ws = {w for s in passages or [] if s for w in leakage.windows(s, p)}
            hits = {w for w in ws if w[0] in norm}
            if any(not short for _, short in hits) or hits and hits == ws:
                out[d, i] = (len(hits), round(len(hits) / len(ws), 6))
    return out


def found(spark, docs, items, p=P):
    got = leakage.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), p)
    return {(r.doc_id, r.item_id): (r.windows, r.coverage) for r in got.collect()}


@pytest.mark.parametrize("part", [6_000_000, 1500])
def test_matches_brute_force(spark, part):
    r = random.Random(1)
    v = [f"word{i}" for i in range(50)] + ["人", "信", "頼", "版"]
    say = lambda n: " ".join(r.choice(v) for _ in range(n))
    items = [(i, [say(r.randrange(3, 40)), say(6), say(r.randrange(1, 4))]) for i in range(30)] + [(100 + i, [say(2), say(1)]) for i in range(4)]
    docs = []
    for d in range(60):
        text = say(80)
        if d % 2:
            words = r.choice(items)[1][0].split()
            a = r.randrange(len(words))
            text += ", " + "; ".join(words[a : a + 20]).upper() + ". " + say(5)
        docs.append((d, text))
    p = leakage.Leak(tokens=part)
    want = brute(docs, items, p)
    assert len(want) >= 10 and found(spark, docs, items, p) == want
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    per_doc = {r.doc_id: (r["items"], r.windows, r.coverage) for r in leakage.contamination(d, i, p).collect()}
    assert per_doc == {n: (sum(k[0] == n for k in want), sum(v[0] for k, v in want.items() if k[0] == n), max([v[1] for k, v in want.items() if k[0] == n], default=0)) for n, _ in docs}
    per_item = {r.item_id: (r.documents, r.coverage) for r in leakage.leaked_items(d, i, p).collect()}
    assert per_item == {k: (sum(x[1] == k for x in want), max(v[1] for x, v in want.items() if x[1] == k)) for k in {x[1] for x in want}}


def test_runs_of_one_and_a_half_windows_are_found():
    words = [f"w{i}" for i in range(40)]
    ws = [w for w, _ in leakage.windows(" ".join(words), P)]
    for a in range(40 - 12):
        text = f" x {' '.join(words[a : a + 12])} y "
        assert any(w in text for w in ws), a


def test_every_run_of_a_window_is_found(spark):
    words = [f"w{i}" for i in range(23)]
    items = [(1, [" ".join(words)]), (2, ["Claim BR-16701 about Chaipril was reject"]), (3, ["".join(chr(0x4E00 + i) for i in range(30))])]
    docs = [(a, f"x {' '.join(words[a : a + 8])} y") for a in range(16)]
    docs += [(100, "The claim BR-16701 about Chaipril was rejected in May"), (101, "".join(chr(0x4E00 + i) for i in range(7, 23))), (102, " ".join(words[3:7]))]
    assert set(found(spark, docs, items)) == {(a, 1) for a in range(16)} | {(100, 2), (101, 3)}


def test_offsets_are_of_the_original(spark):
    passage = "The queue that Touprain rolled isn't the turbine of Jeawu"
    text = "İİ… ​" + passage.upper().replace(" ", "  \n") + "!!"
    docs = spark.createDataFrame([(1, text)], DOCS)
    got = leakage.leaks(docs, spark.createDataFrame([(7, [passage])], ITEMS)).first()
    assert text[got.first_at :].startswith("THE") and got.coverage == 1.0


def test_odd_inputs(spark):
    docs = [(1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six"), (4, "one two three four fivesix"), (5, "x " * 60000 + "one two, three: four five six")]
    items = [(1, ["One two three; four five"]), (1, ["One two three; four five"]), (2, ["one two", "and"]), (3, None), (4, []), (5, [None, "", "..."])]
    assert found(spark, docs, items) == {(3, 1): (1, 1.0), (5, 1): (1, 1.0)}
    assert found(spark, [], items) == {} and found(spark, docs, []) == {}


def test_one_row_per_document(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "none"), (3, None)], DOCS)
    items = spark.createDataFrame([(8, ["a b c d e"]), (9, ["c d e f g", "and not this passage here"])], ITEMS)
    got = {r.doc_id: (r["items"], r.item_id, r.coverage) for r in leakage.contamination(docs, items).collect()}
    assert got == {1: (2, 8, 1.0), 2: (0, None, 0.0), 3: (0, None, 0.0)}
    per_item = {r.item_id: (r.documents, r.coverage) for r in leakage.leaked_items(docs, items).collect()}
    assert per_item == {8: (1, 1.0), 9: (1, 0.5)}


def test_stored_queries(spark):
    text = 'search "one two" | top 3\n-- a comment;\nFIND "three four" IN NAMESPACE x LIMIT 2'
    df = spark.createDataFrame([(1, text, "query"), (2, text, "digest"), (3, None, "query")], "doc_id bigint, text string, doc_kind string")
    assert [(r.item_id, r.passages) for r in leakage.stored_queries(df).collect()] == [(1, ["one two", "three four", "a comment;"])]


def test_short_answers_need_their_question(spark):
    question = "which river runs past the old mill of Gaklun"
    items = [(1, [question, "the Bamus"]), (2, ["forty two"]), (3, ["yes", "no way"])]
    docs = [(1, f"Quiz: {question}? The Bamus."), (2, "They crossed the Bamus at dawn."), (3, "Forty-two of them, yes."), (4, "No way, yes!"), (5, question)]
    want = {(1, 1): 1.0, (3, 2): 1.0, (4, 3): 1.0}
    got = found(spark, docs, items)
    assert {k: c for k, (_, c) in got.items() if k != (5, 1)} == want and 0 < got[5, 1][1] < 1


def test_own_number(spark):
    text = "which river runs past the old mill of Gaklun"
    docs, items = spark.createDataFrame([(1, text), (2, text), (None, text)], DOCS), spark.createDataFrame([(1, [text])], ITEMS)
    assert {r.doc_id for r in leakage.leaks(docs, items, own=True).collect()} == {2, None}
    assert {r.doc_id: r["items"] for r in leakage.contamination(docs, items, own=True).collect()} == {1: 0, 2: 1, None: 1}
    assert [r.documents for r in leakage.leaked_items(docs, items, own=True).collect()] == [2]


def test_planted_leaks_among_real_texts(spark, data):
    """Whole and partial passages planted into real documents: all come out, and nothing else of their items."""
    r = random.Random(3)
    real = [(x.doc_id, x.text) for x in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    items = [(i, [" ".join(f"{r.choice('bcdfgklm')}{r.choice('aeiou')}{r.choice('nrst')}{r.randrange(99)}" for _ in range(r.randrange(10, 40)))]) for i in range(40)]
    planted = {}
    docs = dict(real)
    for i, (words,) in items:
        words = words.split()
        d = r.choice([k for k, t in real if t])
        n = len(words) if i % 2 else max(8, len(words) // 3)
        a = r.randrange(len(words) - n + 1)
        docs[d] += "\n" + " — ".join(words[a : a + n]).title()
        planted[d, i] = i % 2
    got = found(spark, list(docs.items()), items)
    assert set(got) == set(planted) and all(got[k][1] == 1.0 for k, whole in planted.items() if whole)
