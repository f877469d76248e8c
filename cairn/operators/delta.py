"""Change detection by stored hashes, and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_documents(docs: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Documents whose (docId, contentHash) isn't stored; all of them on a first run.

    A null key or hash never equals a stored one, so such a row counts as changed. Only the two
    hash columns of the stored table are read.
    """
    if stored is None:
        return docs
    return docs.join(stored.select("docId", "contentHash"), ["docId", "contentHash"], "left_anti").select(docs.columns)


def stored_hashes(stored: DataFrame) -> DataFrame:
    return stored.select("docId", "contentHash").distinct()


def chunks_to_embed(chunks: DataFrame, stored: DataFrame | None, model: str, version: str) -> DataFrame:
    """Chunks without a vector of this content by this model and version."""
    if stored is None:
        return chunks
    own = stored.where((F.col("modelName") == model) & (F.col("modelVersion") == version)).select("chunkId", "chunkContentHash")
    return chunks.join(own, ["chunkId", "chunkContentHash"], "left_anti").select(chunks.columns)


def upsert(target: DataFrame | None, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target with the source's rows in place of those with the same key, by column name.

    Null keys match nothing: both sides' rows with one stay. Nothing is deleted. The source must
    hold a key once, which :func:`duplicate_keys` checks.
    """
    if target is None:
        return source
    return target.join(source.select(*keys), keys, "left_anti").select(target.columns).unionByName(source.select(target.columns))


def duplicate_keys(source: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a source holds more than once: an upsert of them would be ambiguous."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return source.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def stale_chunks(stored: DataFrame, changed: DataFrame, fresh: DataFrame, key: str = "chunkId") -> DataFrame:
    """Stored chunks that a changed document no longer has."""
    ids = changed.select("docId").distinct()
    return stored.join(ids, "docId", "left_semi").join(fresh.select(key), key, "left_anti").select(stored.columns)


def prune_stale(stored: DataFrame, changed: DataFrame, fresh: DataFrame, key: str = "chunkId") -> DataFrame:
    """Stored chunks without those that a changed document no longer has."""
    return stored.join(stale_chunks(stored, changed, fresh, key).select(key), key, "left_anti").select(stored.columns)
