"""Joins with a key that very many rows share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that the rows of one key are spread over.
SALTS = 8


def spread_join(left: DataFrame, right: DataFrame, on: list[str], by: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``left.join(right, on, how)`` where a key may be hot in ``left`` and ``right`` is the smaller.

    Rows of one key are spread by a hash of ``by``, which should differ among them; ``right`` is
    repeated for that, so it should have few rows of a key. ``how`` is inner, left, left_semi or
    left_anti.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
