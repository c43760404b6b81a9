"""Parsing of both spellings; what is wrong is said with its place."""

from datetime import datetime, timedelta

import pytest

from factloom.dsl.execute import condition, hashed_vector, mode_of
from factloom.dsl.language import Both, Compare, LanguageError, Not, flattened, parse

NOW = datetime(2025, 6, 1, 12)
ask = lambda s: parse(s, NOW)


def test_both_spellings_agree():
    a = ask('search "x \\"y\\"" | where confidence > 0.5 and label = "Fact" | weight utility:high | expand cites depth 2 | top 5 | in ns1 mode agent | as_of "2025-01-02" | known_at 3 d ago | return id, source.name')
    b = ask('FIND "x \\"y\\"" RETURN id, source.name LIMIT 5 WEIGHT utility=high WHERE confidence > 0.5 AND label = "Fact" IN NAMESPACE ns1 MODE agent AS OF "2025-01-02" KNOWN AT 3d ago FOLLOW cites DEPTH 2'.replace("3d", "3 d"))
    assert a == b and a.text == 'x "y"' and a.known_at == NOW - timedelta(days=3) and a.as_of == datetime(2025, 1, 2) and a.follow == [("cites", 2)]


def test_booleans_and_operators():
    q = ask('find "t" where not (a = 1 or b is null) and c in ("x", "y") and d between 1 and 2.5 and e not like "%z%" and f is not null')
    assert q.where == Both("and", (Not(Both("or", (Compare("a", "=", 1), Compare("b", "null")))), Compare("c", "in", ("x", "y")), Compare("d", "between", (1, 2.5)), Not(Compare("e", "like", "%z%")), Not(Compare("f", "null"))))
    assert [c.field for c in flattened(q).where.parts] == ["a", "b", "c", "d", "e", "f"]


@pytest.mark.parametrize("value,want", [("now", NOW), ("today", NOW), ("yesterday", NOW - timedelta(days=1)), ("last week", NOW - timedelta(days=7)), ("2 mo ago", NOW - timedelta(days=60)), ("-3", -3), ('"s"', "s"), ("1.5", 1.5)])
def test_values(value, want):
    assert ask(f'search "t" | where x = {value}').where.value == want


@pytest.mark.parametrize("text,hint", [("FIND 'test'", "double quotes"), ('search "t" | wher x = 1', "'where'"), ('find "t" weight utilty=high', "'utility'"), ('find "t" weight utility=hihg', "'high'"), ('find "t" limit x', "1:16"), ('search "t', "closed"), ('find "t" where (a = 1', "')'"), ('find "t" where a', "comparison"), ('find "t" as of "soon"', "not a time"), ("", "search"), ('search "t" | top -1', "0 or more")])
def test_errors_name_place_or_hint(text, hint):
    with pytest.raises(LanguageError, match=hint.replace("(", r"\(").replace(")", r"\)")):
        ask(text)


def test_unknown_names():
    with pytest.raises(LanguageError, match="no field 'colour'"):
        condition(Compare("colour", "=", 1))
    with pytest.raises(LanguageError, match="no mode"):
        mode_of(ask('search "t" | in n mode odd'))


def test_conditions_on_labels(spark):
    df = spark.createDataFrame([(1, ["A", "B"]), (2, ["C"]), (3, None)], "id int, labels array<string>")
    ids = lambda s: [r.id for r in df.where(condition(ask(f'find "t" where {s}').where)).orderBy("id").collect()]
    assert ids('label = "A"') == [1] and ids('label != "A"') == [2] and ids('label in ("C", "B")') == [1, 2] and ids('label like "C%"') == [2] and ids("label is null") == [3]


def test_hashed_vector():
    a = hashed_vector("x")
    assert a == hashed_vector("x") != hashed_vector("y") and abs(sum(x * x for x in a) - 1) < 1e-9 and len(a) == 64
