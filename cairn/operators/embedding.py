"""Vectors of chunks, from a service or a deterministic stand-in."""

from __future__ import annotations

import hashlib
import json
import os
import socket
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "chunkId string, chunkContentHash string, modelName string, modelVersion string, embedding array<float>"


def hash_vector(text: str) -> list[float]:
    """Sixteen numbers from the digest of a text, each exact in single precision."""
    digest = hashlib.sha256(text.encode("utf-8")).hexdigest()
    return [int(digest[i : i + 4], 16) / 65536.0 for i in range(0, 64, 4)]


@dataclass(frozen=True)
class HashEmbedder:
    """Needs no service: equal texts have equal vectors."""

    def embed(self, texts: Sequence[str], model: str) -> list[list[float]]:
        return [hash_vector(t) for t in texts]


def service_url(configured: str | None = None, env: str = "EMBEDDING_HOST") -> str:
    """The service's address: the environment's, else the configured one, else this host."""
    host = os.environ.get(env) or configured or "http://localhost:11434"
    return host.rstrip("/") if "://" in host else f"http://{host.rstrip('/')}"


@dataclass(frozen=True)
class HttpEmbedder:
    """A service with the public ``/v1/embeddings`` and ``/v1/chat/completions`` interface.

    Timeouts are tried again, twice, after 5 and 10 seconds; other errors are raised at once.
    """

    url: str
    timeout: float = 180.0
    most: int = 10
    attempts: int = 3
    backoff: float = 5.0
    pause: float = 0.0
    sleep: Callable[[float], None] = field(default=time.sleep, compare=False)

    def _post(self, path: str, body: dict) -> dict:
        request = urllib.request.Request(f"{self.url}/v1/{path}", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def _retried(self, path: str, body: dict) -> dict:
        for attempt in range(1, self.attempts + 1):
            try:
                return self._post(path, body)
            except urllib.error.URLError as e:
                if not isinstance(e.reason, (TimeoutError, socket.timeout)):
                    raise
            except TimeoutError:
                pass
            if attempt < self.attempts:
                self.sleep(self.backoff * attempt)
        raise RuntimeError(f"the service timed out {self.attempts} times")

    def embed(self, texts: Sequence[str], model: str, batching: bool = True) -> list[list[float]]:
        """Vectors in the texts' order; no texts make no call."""
        out: list[list[float]] = []
        step = self.most if batching else max(1, len(texts))
        for at in range(0, len(texts), step):
            if at and self.pause:
                self.sleep(self.pause)
            data = self._retried("embeddings", {"model": model, "input": list(texts[at : at + step])})["data"]
            out += [d["embedding"] for d in sorted(data, key=lambda d: d.get("index", 0))]
        return out

    def chat(self, messages: Sequence[tuple[str, str]], model: str, temperature: float = 0.1) -> str:
        """The answer's text. Roles other than user, system and assistant count as user."""
        known = ("user", "system", "assistant")
        body = {"model": model, "temperature": temperature, "messages": [{"role": r if r in known else "user", "content": c} for r, c in messages]}
        return self._retried("chat/completions", body)["choices"][0]["message"]["content"]


def embed_chunks(chunks: DataFrame, embedder, model: str, version: str, batch: int = 2, parallelism: int | None = None) -> DataFrame:
    """Rows of the embeddings table.

    Each task calls the embedder with ``batch`` texts at a time. ``parallelism`` bounds the calls
    made at once over the whole cluster, as that many tasks. An answer with another number of
    vectors than texts is an error, as rows would be lost.
    """
    rows = chunks.select("chunkId", "chunkContentHash", F.coalesce("chunkText", F.lit("")).alias("chunkText"))
    if parallelism:
        rows = rows.repartition(parallelism)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, vectors = frame["chunkText"].tolist(), []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                got = embedder.embed(part, model)
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                vectors += got
            yield pd.DataFrame({"chunkId": frame["chunkId"], "chunkContentHash": frame["chunkContentHash"], "modelName": model, "modelVersion": version, "embedding": vectors})

    return rows.mapInPandas(run, _SCHEMA)


def hash_embeddings(chunks: DataFrame, model: str, version: str) -> DataFrame:
    """What :class:`HashEmbedder` gives, as native expressions."""
    digest = F.sha2("chunkText", 256)
    parts = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (F.conv(F.substring(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("int") / F.lit(65536.0)).cast("float"))
    return chunks.select("chunkId", "chunkContentHash", F.lit(model).alias("modelName"), F.lit(version).alias("modelVersion"), parts.alias("embedding"))
