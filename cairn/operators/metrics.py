"""Counts and ratios of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ratio(part, whole):
    """0.0 for an empty whole; numbers or columns."""
    if isinstance(part, (int, float)):
        return float(part) / whole if whole else 0.0
    return F.when(whole > 0, part.cast("double") / whole).otherwise(0.0)


def size_of(df: DataFrame, length: str = "length") -> DataFrame:
    """``(docs, bytes)`` in one pass; an empty table has 0 of both."""
    return df.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(length), F.lit(0)).cast("long").alias("bytes"))


def run_counts(docs: DataFrame, changed: DataFrame, chunks: DataFrame, embedded: DataFrame, length: str = "length") -> DataFrame:
    """One row of a run's counts: four aggregates of one row each, added up."""
    names = ["docs_scanned", "bytes_scanned", "docs_new_or_changed", "chunks_new_or_changed", "embeddings_new"]
    count = F.count(F.lit(1))

    def part(df: DataFrame, **columns) -> DataFrame:
        return df.agg(*[columns.get(n, F.lit(0)).cast("long").alias(n) for n in names])

    parts = [part(docs, docs_scanned=count, bytes_scanned=F.coalesce(F.sum(length), F.lit(0))), part(changed, docs_new_or_changed=count), part(chunks, chunks_new_or_changed=count), part(embedded, embeddings_new=count)]
    row = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).agg(*[F.sum(n).alias(n) for n in names])
    reused = F.col("chunks_new_or_changed") - F.col("embeddings_new")
    return row.select(
        "*",
        reused.alias("embeddings_reused"),
        ratio(F.col("docs_scanned") - F.col("docs_new_or_changed"), F.col("docs_scanned")).alias("docs_skipped_ratio"),
        ratio(reused, F.col("chunks_new_or_changed")).alias("embeddings_reuse_ratio"),
        ((F.col("docs_new_or_changed") == 0) & (F.col("embeddings_new") == 0)).alias("noop_run"),
    )
