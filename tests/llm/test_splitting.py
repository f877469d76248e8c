from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm.splitting import BLANK, CLAUSE, INSIDE, SENTENCE, cores, pieces, split_items, strength
from tests.conftest import rows


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,;!?éé\U0001f600-1)", min_size=0, max_size=400), st.integers(20, 80), st.integers(0, 19))
def test_pieces_cover_and_overlap(text, limit, overlap):
    text = " ".join(text.split())
    got = pieces(text, limit, overlap)
    if not text:
        assert got == []
        return
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(0 < b - a <= limit for a, b in got)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert b - c == min(overlap, b) and d > b
    if len(text) > limit:
        assert [a for a, _ in cores(text, limit, overlap)][1:] == [b for _, b in cores(text, limit, overlap)][:-1]


def test_strengths():
    assert strength("End. ", "Next") == SENTENCE and strength("end, ", "next") == CLAUSE and strength("plain ", "word") == BLANK and strength("half", "word") == INSIDE
    assert strength("Dr. ", "Who") == BLANK and strength("z.B. ", "So") == BLANK and strength("(Fig. ", "12") == BLANK and strength("said.” ", "Then") == SENTENCE
    assert strength("word ", "2. ") == CLAUSE and strength("word ", "- ") == CLAUSE and strength("end. ", "lower") == CLAUSE


def test_sentences_stay_whole_if_they_can():
    text = " ".join(f"Sentence number {i} has some words in it." for i in range(40))
    for a, b in cores(text, 200, 40):
        assert text[a:b].rstrip().endswith(".") and text[a] == "S"


def test_rows(spark):
    long_text = "A sentence with words. " * 200
    data = [
        (1, long_text, 5, "x"), (1, long_text, 5, "x"), (2, "short", 0, "x"), (3, None, None, "x"), (4, "   \n\t ", 0, "x"), (None, long_text, 0, "x"),
        (5, "y" * 4000, 0, "x"), (6, "\U0001f600" * 1501, 0, "x"), (7, "a \n\n b" + " \t " * 3000, 0, "x"), (8, "z" * 1500, 0, "x"), (9, " " * 10 + "w" * 1501 + "\n", 0, "x"),
    ]
    df = spark.createDataFrame(data, "item_id long, text string, startIndex int, pieceIndex string")
    out = split_items(df)
    assert {r.item_id for r in out.collect()} == {1, 5, 6, 9}
    first = out.where("item_id = 1").orderBy("pieceIndex").collect()
    clean = long_text.strip()
    assert all(r.text == clean[r.startIndex : r.endIndex] for r in first) and [r.pieceIndex for r in first] == list(range(len(first)))
    assert [len(r.text) for r in out.where("item_id = 5").orderBy("pieceIndex").collect()][0] <= 1500
    assert split_items(df.limit(0)).count() == 0 and len(rows(out)) == out.count()
    with pytest.raises(ValueError):
        split_items(df, 100, 100)
