"""Bounded samples that no single task has to sort or hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = 1 << 40


def hash_sample(df: DataFrame, key: str, rows: int, within: str | None = None) -> DataFrame:
    """About ``rows`` of ``df``, of each value of ``within`` if that is given; all where there are fewer.

    A row is taken if the hash of its ``key`` is below a threshold that follows from the count, so
    the same rows are taken every time, each task decides by itself, and nothing is sorted.
    ``within`` should have few values, as each one's count comes to the driver.
    """
    drawn = F.pmod(F.xxhash64(key), F.lit(_SPACE))
    below = lambda n: F.lit(_SPACE if n <= rows else int(_SPACE * (rows / n)))
    if within is None:
        return df.where(drawn < below(df.count()))
    out = None
    for r in df.where(F.col(within).isNotNull()).groupBy(within).count().collect():
        out = (F if out is None else out).when(F.col(within) == r[0], below(r[1]))
    return df.where(F.lit(False) if out is None else drawn < out)
