from __future__ import annotations

from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm.tokenizer import PATTERN, RANKS, Encoder, decode_ids, encode_texts, load_ranks, merge

pytestmark = pytest.mark.skipif(not Path(RANKS).exists(), reason="the vocabulary isn't here")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(load_ranks(Path(RANKS).read_bytes()))


@pytest.fixture(scope="module")
def other():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(Path(RANKS).read_bytes()), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_equals_another_implementation(encoder, other, text):
    ids = encoder.encode(text)
    assert ids == other.encode_ordinary(text) and encoder.decode(ids) == text


def test_special_strings_and_long_pieces(encoder, other):
    for text in ("<|endoftext|> it's", "a" * 30_000, "é" * 5000, " " * 1000 + "x", "\U0001f600‍" * 300, "don't  stop\n\n\tnow"):
        assert encoder.encode(text) == other.encode_ordinary(text)


def test_stale_entries_are_skipped():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4, b"abc": 5}
    assert merge(b"abc", ranks) == [5] and merge(b"bc", ranks) == [4] and merge(b"aab", ranks) == [0, 3] and merge(b"cab", ranks) == [2, 3]


def test_rows(spark, encoder):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (None, "a", "x"), (1, "hello world", "x"), (4, "z" * 200_000, "x")], "doc_id long, text string, ids string")
    out = encode_texts(df)
    assert out.schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    got = [(r.doc_id, r.ids) for r in out.collect()]
    assert len(got) == 6 and got[0] == got[4] == (1, encoder.encode("hello world"))
    assert (2, []) in got and (3, []) in got and (None, encoder.encode("a")) in got
    back = {r.doc_id: r.text for r in decode_ids(out).collect()}
    assert back[4] == "z" * 200_000 and back[2] == ""
    assert encode_texts(df.limit(0)).count() == 0


def test_no_shuffle(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert "Exchange" not in encode_texts(df)._jdf.queryExecution().executedPlan().toString()
