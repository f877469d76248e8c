from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.operators.chunking import chunk_at_sentences, chunk_documents, chunk_metadata, chunk_statistics, cut_at_sentences
from tests.conftest import rows


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", f"u{i}", t) for i, t in enumerate(texts)], "docId string, pdfUri string, text string")


def spans(df):
    return [(r.docId, r.chunkIndex, r.chunkStartIndex, r.chunkEndIndex) for r in df.orderBy("docId", "chunkIndex").collect()]


def test_windows(spark):
    df = chunk_documents(docs(spark, "x" * 1500, "Short text", "", None, " \n\t ", "a  b"))
    assert spans(df) == [("d0", 0, 0, 1500), ("d0", 1, 1250, 1500), ("d1", 0, 0, 10), ("d5", 0, 0, 3)]
    assert [r.chunkText for r in df.where("docId IN ('d1', 'd5')").orderBy("docId").collect()] == ["Short text", "a b"]


def test_small_windows_overlap(spark):
    sentence = "This is a sentence of eighty-one characters, which ends with a blank after it. ab "
    got = spans(chunk_documents(docs(spark, sentence * 10, "A" * 500), 100, 20))
    first = [g for g in got if g[0] == "d0"]
    assert len(first) > 1 and first[1][2] < first[0][3]
    assert all(b - a <= 100 for _, _, a, b in got)


def test_ids_and_hashes(spark):
    r = chunk_documents(docs(spark, "Short text")).first()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (r.chunkContentHash, r.chunkId, r.sectionPath) == (sha("Short text"), sha("d0:0:0:10"), "u0")


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 400), st.integers(1, 120), st.integers(0, 150))
def test_closed_form_equals_the_loop(spark, n, window, overlap):
    want, at = [], 0
    while at < n:
        want.append((at, min(at + window, n)))
        at += max(1, window - overlap)
    got = [(a, b) for _, _, a, b in spans(chunk_documents(docs(spark, "y" * n), window, overlap))]
    assert got == want
    assert [(a, b) for a, b, _ in cut_at_sentences("y" * n, window, overlap)] == want


def test_sentence_cuts():
    # cut after the last sentence end at or beyond 60 % of the window
    text = "One two three four five. Six seven eight nine. " + "X" * 60
    assert cut_at_sentences(text, 50, 10)[0] == (0, 46, text[:46])
    # the next window begins the overlap before the cut
    assert cut_at_sentences(text, 50, 10)[1][0] == 36
    # no sentence end far enough: the whole window
    assert cut_at_sentences("Hi. " + "x" * 100, 50, 10)[0][1] == 50
    # a mark at the end of the window counts, even in mid-sentence
    assert cut_at_sentences("a" * 39 + ".b" + "c" * 40, 40, 0)[0][1] == 40
    assert cut_at_sentences(None) == cut_at_sentences("") == []


def test_sentence_cuts_as_rows(spark):
    got = chunk_at_sentences(docs(spark, "Short text", None, "A b. " * 400), 100, 20)
    assert got.where("docId = 'd1'").count() == 0
    assert all(r.chunkEndIndex - r.chunkStartIndex == len(r.chunkText) <= 100 for r in got.collect())


def test_metadata_and_statistics(spark):
    chunks = spark.createDataFrame([("d", 0, "x" * 10), ("d", 1, "x" * 15), ("d", 2, "x" * 5), ("e", 0, "x" * 5)], "docId string, chunkIndex int, chunkText string")
    assert rows(chunk_statistics(chunks)) == [("d", 3, 5, 15, 10.0, 30), ("e", 1, 5, 5, 5.0, 5)]
    assert chunk_statistics(chunks.limit(0)).count() == 0
    meta = {r.id: r.metadata for r in chunk_metadata(chunks.where("docId = 'd'")).collect()}
    assert meta["chunk_2"] == {"chunk_id": "chunk_2", "position": "2", "total_chunks": "3"} and set(meta) == {"chunk_1", "chunk_2", "chunk_3"}


@pytest.mark.parametrize("cut", [chunk_documents, chunk_at_sentences])
def test_no_shuffle(spark, cut):
    plan = cut(docs(spark, "abc"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
