from __future__ import annotations

import urllib.error

import pytest

from cairn.operators.embedding import HashEmbedder, HttpEmbedder, embed_chunks, hash_embeddings, service_url
from tests.conftest import rows


class Service(HttpEmbedder):
    """Answers from a list; an exception in it is raised."""

    def __init__(self, answers, **options):
        super().__init__("http://nowhere", **options)
        object.__setattr__(self, "answers", list(answers))
        object.__setattr__(self, "calls", [])

    def _post(self, path, body):
        self.calls.append((path, body))
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a


def data(*vectors):
    return {"data": [{"index": i, "embedding": v} for i, v in enumerate(vectors)]}


def test_order_and_batches():
    s = Service([{"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}])
    assert s.embed(["a", "b"], "m") == [[1.0], [2.0]] and len(s.calls) == 1
    s = Service([data(*[[float(i)] for i in range(10)]), data([10.0])])
    assert len(s.embed(["x"] * 11, "m")) == 11 and [len(c[1]["input"]) for c in s.calls] == [10, 1]
    s = Service([])
    assert s.embed([], "m") == [] and s.calls == []
    s = Service([data(*[[0.0]] * 11)])
    assert len(s.embed(["x"] * 11, "m", batching=False)) == 11


def test_retries_only_timeouts():
    waits = []
    s = Service([TimeoutError(), urllib.error.URLError(TimeoutError()), data([1.0])], sleep=waits.append)
    assert s.embed(["a"], "m") == [[1.0]] and len(s.calls) == 3 and waits == [5.0, 10.0]
    s = Service([TimeoutError()] * 3, sleep=waits.append)
    with pytest.raises(RuntimeError):
        s.embed(["a"], "m")
    s = Service([ValueError("no")], sleep=waits.append)
    with pytest.raises(ValueError):
        s.embed(["a"], "m")
    assert len(s.calls) == 1


def test_chat_roles():
    s = Service([{"choices": [{"message": {"content": "hello"}}]}])
    assert s.chat([("system", "a"), ("odd", "b")], "m") == "hello"
    assert [m["role"] for m in s.calls[0][1]["messages"]] == ["system", "user"] and s.calls[0][1]["temperature"] == 0.1


def test_service_url(monkeypatch):
    monkeypatch.delenv("EMBEDDING_HOST", raising=False)
    assert service_url() == "http://localhost:11434" and service_url("h:1") == "http://h:1"
    monkeypatch.setenv("EMBEDDING_HOST", "http://e:2/")
    assert service_url("h:1") == "http://e:2"


def chunks(spark):
    return spark.createDataFrame([(f"c{i}", f"h{i}", t) for i, t in enumerate(["a", "b", "", "a"])], "chunkId string, chunkContentHash string, chunkText string")


def test_both_ways_agree(spark):
    assert rows(embed_chunks(chunks(spark), HashEmbedder(), "m", "1")) == rows(hash_embeddings(chunks(spark), "m", "1"))
    assert embed_chunks(chunks(spark), HashEmbedder(), "m", "1", parallelism=2).rdd.getNumPartitions() == 2


def test_missing_vectors_are_an_error(spark):
    class Short:  # in here, so that workers get it by value
        def embed(self, texts, model):
            return [[0.0]] * (len(texts) - 1)

    with pytest.raises(Exception, match="vectors for"):
        embed_chunks(chunks(spark), Short(), "m", "1").collect()
