from __future__ import annotations

import pytest

from cairn.operators.current import current_rows
from cairn.operators.delta import changed_documents, chunks_to_embed, duplicate_keys, prune_stale, upsert
from cairn.operators.metrics import ratio, run_counts, size_of
from cairn.operators.snapshot import retrieval_index
from tests.conftest import rows


def test_changed_documents(spark):
    new = spark.createDataFrame([("a", "1", "x"), ("b", "2", "x"), ("c", "3", "x"), (None, "4", "x"), ("d", None, "x")], "docId string, contentHash string, extra string")
    old = spark.createDataFrame([("a", "1", "q"), ("b", "0", "q"), (None, "4", "q"), ("d", None, "q")], "docId string, contentHash string, extra string")
    assert [r[:2] for r in rows(changed_documents(new, old))] == [("b", "2"), ("c", "3"), ("d", None), (None, "4")]
    assert changed_documents(new, None).count() == 5


def test_chunks_to_embed_by_model(spark):
    chunks = spark.createDataFrame([("c1", "h1"), ("c2", "h2")], "chunkId string, chunkContentHash string")
    held = spark.createDataFrame([("c1", "h1", "m", "1"), ("c2", "old", "m", "1"), ("c2", "h2", "other", "1")], "chunkId string, chunkContentHash string, modelName string, modelVersion string")
    assert rows(chunks_to_embed(chunks, held, "m", "1")) == [("c2", "h2")]
    assert rows(chunks_to_embed(chunks, held, "other", "1")) == [("c1", "h1")]
    assert chunks_to_embed(chunks, held, "m", "2").count() == 2


def test_upsert_by_name_and_null_keys(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "t")], "k int, v string")
    source = spark.createDataFrame([("B", 2), ("C", 3), ("s", None)], "v string, k int")
    assert rows(upsert(target, source, ["k"])) == [(1, "a"), (2, "B"), (3, "C"), (None, "s"), (None, "t")]
    assert upsert(None, source, ["k"]).count() == 3
    twice = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "k int")
    assert rows(duplicate_keys(twice, ["k"])) == [(1, 2)]


def test_prune_stale(spark):
    stored = spark.createDataFrame([("d1", "c1"), ("d1", "c2"), ("d2", "c3")], "docId string, chunkId string")
    changed = spark.createDataFrame([("d1",)], "docId string")
    fresh = spark.createDataFrame([("d1", "c1")], "docId string, chunkId string")
    assert rows(prune_stale(stored, changed, fresh)) == [("d1", "c1"), ("d2", "c3")]


def test_current_rows(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("a", 2, "new"), ("b", None, "only"), (None, 9, "lost"), ("c", 1, "x"), ("c", 1, "y")], "k string, ts int, v string")
    assert rows(current_rows(df, ["k"], "ts", ["k", "v"])) == [("a", "new"), ("b", "only"), ("c", "y")]
    assert current_rows(df.limit(0), ["k"], "ts", ["k", "v"]).count() == 0


def test_retrieval_index_filters(spark):
    chunks = spark.createDataFrame([("c", "d", "text", "path", "h")], "chunkId string, docId string, chunkText string, sectionPath string, chunkContentHash string")
    docs = spark.createDataFrame([("d", "t", "en", "extra")], "docId string, title string, language string, chunkText string")
    vectors = spark.createDataFrame([("c", "h", "m", "1", [0.5]), ("c", "stale", "n", "1", [0.25])], "chunkId string, chunkContentHash string, modelName string, modelVersion string, embedding array<float>")
    assert retrieval_index(chunks, docs, vectors).count() == 2
    assert [r.embedder for r in retrieval_index(chunks, docs, vectors, match_hash=True).collect()] == ["m"]
    assert [r.embedder for r in retrieval_index(chunks, docs, vectors, model="n", version="1").collect()] == ["n"]


def test_metrics(spark):
    assert (ratio(1, 0), ratio(1, 2)) == (0.0, 0.5)
    empty = spark.createDataFrame([], "length long")
    assert rows(size_of(empty)) == [(0, 0)]
    row = run_counts(empty, empty, empty, empty).first()
    assert row.noop_run and row.docs_skipped_ratio == row.embeddings_reuse_ratio == 0.0
    four = spark.range(4).selectExpr("id AS length")
    row = run_counts(four, four.limit(1), four, four.limit(3)).first().asDict()
    assert row == {"docs_scanned": 4, "bytes_scanned": 6, "docs_new_or_changed": 1, "chunks_new_or_changed": 4, "embeddings_new": 3, "embeddings_reused": 1, "docs_skipped_ratio": pytest.approx(0.75), "embeddings_reuse_ratio": pytest.approx(0.25), "noop_run": False}
