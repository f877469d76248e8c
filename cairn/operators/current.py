"""Current rows: of several deliveries of a key, the one that counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_rows(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row per ``keys``: the row with the greatest ``order``.

    An aggregate, not a window: it combines on the map side, so a key that is delivered very
    often costs one row per map task in the shuffle. Rows with a null key have no identity and
    are left out; a null ``order`` counts as the earliest; of rows equal in it the greatest
    column values count. Extra columns are ignored.
    """
    rest = [c for c in columns if c not in keys and c != order]
    best = F.max(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("_best")
    present = [F.col(k).isNotNull() for k in keys]
    cond: Column = present[0]
    for p in present[1:]:
        cond = cond & p
    picked = df.where(cond).groupBy(*keys).agg(best)
    return picked.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in columns])
