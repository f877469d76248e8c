"""The retrieval index: chunks with their documents and vectors, as one immutable table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval_index(chunks: DataFrame, docs: DataFrame, embeddings: DataFrame, at: Column | None = None, model: str | None = None, version: str | None = None, match_hash: bool = False) -> DataFrame:
    """One row per chunk, model and version.

    By default vectors of all models are joined, also those of earlier content; ``model`` and
    ``version`` keep one, ``match_hash`` only vectors of the present content.
    """
    if model is not None:
        embeddings = embeddings.where(F.col("modelName") == model)
    if version is not None:
        embeddings = embeddings.where(F.col("modelVersion") == version)
    vectors = embeddings.select("chunkId", F.col("chunkContentHash").alias("vectorHash"), "modelName", "modelVersion", "embedding")
    joined = chunks.join(docs.select("docId", "title", "language"), "docId").join(vectors, "chunkId")
    if match_hash:
        joined = joined.where(F.col("vectorHash") == F.col("chunkContentHash"))
    return joined.select(
        "chunkId", "docId", "chunkText", "sectionPath", "title", "language", "embedding",
        F.col("modelName").alias("embedder"), F.col("modelVersion").alias("embedder_ver"), F.col("chunkContentHash").alias("contentHash"),
        (F.current_timestamp() if at is None else at).alias("version_ts"),
    )
