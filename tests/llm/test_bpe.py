"""Ids of texts against two public libraries with the same vocabulary."""

import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("factloom.llm")
tiktoken = pytest.importorskip("tiktoken")
from factloom.llm import bpe  # noqa: E402

try:
    RAW = open(f"{bpe.FOLDER}/{bpe.RANKS}", "rb").read()
except OSError:
    pytest.skip("no vocabulary files here", allow_module_level=True)
OWN = bpe.Encoder(RAW)
THEIRS = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=300).filter(lambda s: not any(0xD800 <= ord(c) <= 0xDFFF for c in s)))
def test_any_text(s):
    assert OWN.encode(s) == THEIRS.encode_ordinary(s)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abeinrst '\n1é人", max_size=200))
def test_texts_with_many_merges(s):
    assert OWN.encode(s) == THEIRS.encode_ordinary(s)


@pytest.mark.parametrize("s", ["a" * 5000, "ab" * 3000, "é" * 4000, "人" * 3000, "x" + " " * 3000, "<|endoftext|> is text", "\x00\x01﻿​", "abc" * 7 + "\n" * 100])
def test_long_pieces(s):
    assert OWN.encode(s) == THEIRS.encode_ordinary(s)


def test_every_token_is_reached():
    assert all(OWN.merge(k) == (v,) for k, v in OWN.ranks.items())


def test_memory_is_bounded():
    e = bpe.Encoder(RAW, remembered=5)
    s = " ".join(f"word{i}" for i in range(200))
    assert e.encode(s) == THEIRS.encode_ordinary(s) and len(e.memory) <= 5


def test_table(spark):
    from pyspark.sql import functions as F

    rows = [(1, "hello world"), (2, ""), (3, None), (4, "hello world"), (4, "hello world"), (5, "é" * 30000), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = bpe.token_ids(df)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert sorted((r.doc_id or 0, r.ids) for r in got.collect()) == sorted((i or 0, THEIRS.encode_ordinary(t or "")) for i, t in rows)
    assert bpe.token_ids(df.limit(0)).collect() == []


def test_other_vocabulary(spark):
    path = f"{bpe.FOLDER}/byte_bpe_multi_50k.tiktoken"
    raw = open(path, "rb").read()
    theirs = tiktoken.Encoding("multi", pat_str=bpe.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, special_tokens={})
    s = "Der Knoten läuft, これは版です, узел 42"
    assert bpe.Encoder(raw).encode(s) == theirs.encode_ordinary(s)
