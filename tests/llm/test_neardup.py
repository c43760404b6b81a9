"""Near duplicates against all pairs, with crowded variants, copies and odd contents."""

import random
from dataclasses import replace
from itertools import combinations

import pytest
import regex

pytest.importorskip("factloom.llm")
from factloom.llm import neardup  # noqa: E402


def words(s):
    s = regex.sub(r"[^\p{L}\p{Nd}\p{White_Space}]", "", s.replace("Σ", "σ").lower())
    return set(regex.sub(r"\p{White_Space}+", " ", s).strip(" ").split(" "))


def brute(rows, least=0.7):
    sets = {}
    for i, s in rows:
        if i is not None and s is not None and len(words(s)) >= 8:
            sets.setdefault(i, []).append(words(s))
    return {(a, b) for a, b in combinations(sorted(sets), 2) if any(len(x & y) >= least * len(x | y) - 1e-12 for x in sets[a] for y in sets[b])}


def found(spark, rows, p=neardup.Ball()):
    df = spark.createDataFrame(rows, "id bigint, content string")
    return {(r.a, r.b) for r in neardup.all_pairs(*neardup.similar_pairs(df, p)).collect()}


def edited(base, r, vocabulary):
    w = list(base)
    for _ in range(r.randrange(1, 8)):
        i = r.randrange(len(w))
        kind = r.randrange(3)
        if kind == 0:
            w[i] = r.choice(vocabulary)
        elif kind == 1:
            w.insert(i, r.choice(vocabulary))
        elif len(w) > 8:
            del w[i]
    r.shuffle(w)
    return " ".join(w)


@pytest.mark.parametrize("vocabulary,crowd", [(4000, 256), (60, 256), (60, 3), (400, 2)])
def test_matches_all_pairs(spark, vocabulary, crowd):
    """Few words make nearly every variant crowded; the longer variants then find the pairs."""
    r = random.Random(vocabulary + crowd)
    v = [f"w{i}" for i in range(vocabulary)]
    rows = []
    for _ in range(40):
        base = [r.choice(v) for _ in range(r.randrange(8, 45))]
        rows += [(len(rows) + i, edited(base, r, v)) for i in range(r.randrange(1, 6))]
    want = brute(rows)
    assert len(want) > 30 and found(spark, rows, replace(neardup.Ball(), crowd=crowd)) == want


@pytest.mark.parametrize("long", [10, 16, 25])
def test_long_sets_meet_in_single_words(spark, long):
    r = random.Random(long)
    v = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(30):
        base = [r.choice(v) for _ in range(r.randrange(8, 45))]
        rows += [(len(rows) + i, edited(base, r, v)) for i in range(r.randrange(1, 6))]
    want = brute(rows)
    assert len(want) > 30 and found(spark, rows, replace(neardup.Ball(), long=long)) == want


def test_very_long_texts(spark):
    w = [f"w{i}" for i in range(60000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:50000])), (3, " ".join(w[:40000])), (4, " ".join(w[:9]))]
    assert found(spark, rows) == {(1, 2), (2, 3)}


@pytest.mark.parametrize("bits,block", [(1 << 3, 8192), (1 << 27, 16), (1 << 6, 8)])
def test_crowded_variants_and_large_groups(spark, bits, block):
    """A table too small to tell variants apart only extends more of them; large groups are compared block by block."""
    r = random.Random(9)
    v = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(r.sample(v, 20))) for i in range(80)] + [(100 + i, " ".join(v[:20])) for i in range(3)]
    assert found(spark, rows, replace(neardup.Ball(), crowd=2, bits=bits, block=block)) == brute(rows)


def test_odd_contents(spark):
    base = "eins zwei drei vier fünf sechs sieben acht neun zehn"
    rows = [(1, base), (2, base.upper() + "!!!"), (2, base.upper() + "!!!"), (3, "  ".join(reversed(base.split()))), (4, base + " elf"), (5, "a b c"), (6, None), (7, ""), (8, " \t "), (None, base), (9, "x " * 50000 + base), (10, "日本 語の 文章 です から これは 八つの 語を もつ"), (11, "日本 語の 文章 です から これは 八つの 語を もつ。"), (12, "eins zwei drei vier fünf sechs sieben"), (13, "...!!!"), (14, " ".join(str(i) for i in range(3000))), (15, " ".join(str(i) for i in range(2500)))]
    assert found(spark, rows) == brute(rows) >= {(1, 2), (1, 3), (1, 4), (10, 11), (14, 15)}


def test_boundary_is_exact(spark):
    a = [f"w{i}" for i in range(17)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:14] + ["x", "y", "z"])), (3, " ".join(a[:7] + ["p", "q", "r"])), (4, " ".join(a[:7] + ["p", "q", "r"] + ["s"] ))]
    assert (1, 2) in brute(rows) and found(spark, rows) == brute(rows)


def test_copies_have_one_representative(spark):
    text = "one two three four five six seven eight nine"
    df = spark.createDataFrame([(i, text) for i in range(300)] + [(500, text + " ten")], "id bigint, content string")
    pairs, members = neardup.similar_pairs(df)
    assert [(r.a, r.b) for r in pairs.collect()] == [(0, 500)]
    assert members.where("rep = 0").count() == 300 and members.count() == 301


def test_empty_and_extra_columns(spark):
    from pyspark.sql import functions as F

    assert found(spark, []) == set() and found(spark, [(1, "a b")]) == set()
    t = "one two three four five six seven eight"
    df = spark.createDataFrame([(1, t), (2, t + " nine")], "id bigint, content string").withColumns({"w": F.lit(1), "h": F.lit("x"), "a": F.lit(0), "pid": F.lit(None), "s1": F.lit(3)})
    assert [(r.a, r.b) for r in neardup.all_pairs(*neardup.similar_pairs(df)).collect()] == [(1, 2)]


def test_groups_follow_links_and_count_them(spark):
    base = "one two three four five six seven eight nine ten"
    rows = [(i, base) for i in range(5)] + [(10, base + " eleven"), (11, base + " eleven twelve thirteen"), (12, base + " eleven twelve thirteen fourteen fifteen sixteen"), (20, "alpha beta gamma delta epsilon zeta eta theta"), (30, "a b c"), (31, None)]
    df = spark.createDataFrame(rows + rows[:2], "id bigint, content string")
    got = {r.id: (r.group, r.links) for r in neardup.groups(*neardup.similar_pairs(df)).collect()}
    links = {i: sum(i in x for x in brute(rows)) for i in [0, 1, 2, 3, 4, 10, 11, 12, 20]}
    assert got == {i: (20 if i == 20 else 0, links[i]) for i in links}
    assert neardup.groups(*neardup.similar_pairs(df.where("id is null"))).collect() == []
