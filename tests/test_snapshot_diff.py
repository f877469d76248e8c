from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.operators.snapshot_diff import check_hash, peel, positions, snapshot_changes, xxhash64_long
from tests.conftest import rows

SCHEMA = "index_version long, chunkId string, contentHash string, landed_ts int, title string"


def plain(table):
    """The definition, row by row."""
    best = {}
    for v, k, h, t, _ in table:
        if v is None or k is None:
            continue
        norm = None if h is None else h.strip(" \t\r\n\f\x0b").lower()
        key = (t is not None, t or 0, norm is not None, norm or "")
        if (v, k) not in best or key > best[v, k][0]:
            best[v, k] = (key, norm)
    versions = sorted({v for v, _ in best})
    out = []
    for a, b in zip(versions, versions[1:]):
        for k in {k for v, k in best if v in (a, b)}:
            if (a, k) not in best:
                out.append((b, k, "added"))
            elif (b, k) not in best:
                out.append((b, k, "removed"))
            elif best[a, k][1] != best[b, k][1]:
                out.append((b, k, "changed"))
    return sorted(out, key=repr)


def test_hashes_equal_sparks(spark):
    values = [0, 1, -1, 42, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = df.select(F.xxhash64("v"), F.xxhash64("v", F.col("v").bitwiseXOR(F.lit(5)))).collect()
    v = np.array(values, np.int64)
    assert [r[0] for r in got] == xxhash64_long(v).tolist()
    assert [r[1] for r in got] == check_hash(v, v ^ 5).tolist()


def test_rules(spark):
    table = [
        (1, "same", "A", 1, "t"), (2, "same", " a\t", 1, "other title"),
        (1, "changed", "a", 1, None), (2, "changed", "b", 1, None),
        (1, "gone", "a", 1, None), (2, "new", None, 1, None),
        (1, "null", None, 1, None), (2, "null", None, 1, None),
        (1, "tonull", "a", 1, None), (2, "tonull", None, 1, None),
        (1, "empty", None, 1, None), (2, "empty", "", 1, None),
        (1, "late", "x", 1, None), (2, "late", "y", 1, None), (2, "late", "x", 5, None), (2, "late", "x", 5, None),
        (1, "undated", "x", None, None), (2, "undated", "x", 3, None),
        (None, "k", "a", 1, None), (2, None, "a", 1, None),
    ]
    got = rows(snapshot_changes(spark.createDataFrame(table, SCHEMA)))
    assert got == plain(table)
    assert ("late" not in {k for _, k, _ in got}) and (2, "tonull", "changed") in got and (2, "empty", "changed") in got


def test_few_snapshots(spark):
    df = spark.createDataFrame([(1, "a", "x", 1, None)], SCHEMA)
    for table in (df, df.limit(0)):
        out = snapshot_changes(table)
        assert out.columns == ["index_version", "chunkId", "change_type"] and out.count() == 0


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10**6))
def test_random_tables(spark, seed):
    r = random.Random(seed)
    table = [(r.randrange(4), f"k{r.randrange(60)}", r.choice([None, "a", "A ", "b", "c"]), r.randrange(3), None) for _ in range(r.randrange(1, 300))]
    # few cells, so that buckets fail and are enlarged
    assert rows(snapshot_changes(spark.createDataFrame(table, SCHEMA), rows_per_bucket=32, first_cells=4)) == plain(table)


def test_exact_way_when_nothing_peels(spark):
    table = [(v, f"k{i}", str(i % (3 + v)), 1, None) for v in range(3) for i in range(v * 10, 200)]
    assert rows(snapshot_changes(spark.createDataFrame(table, SCHEMA), first_cells=1, rounds=1)) == plain(table)


def test_hot_key(spark):
    table = [(v, "hot", f"{v}{t}", t, None) for v in range(2) for t in range(300)] + [(v, f"k{i}", "x", 1, None) for v in range(2) for i in range(300)]
    assert rows(snapshot_changes(spark.createDataFrame(table, SCHEMA))) == [(1, "hot", "changed")]


def test_peel_detects_overload():
    rng = np.random.default_rng(1)
    k, v = rng.integers(-(2**62), 2**62, (2, 200))
    c, cells = check_hash(k, v), 8
    tables = [np.zeros(3 * cells, np.int64) for _ in range(4)]
    for row in positions(v, cells):
        np.add.at(tables[0], row, 1)
        for t, x in zip(tables[1:], (k, v, c)):
            np.bitwise_xor.at(t, row, x)
    assert not peel(np.arange(3 * cells), *tables, cells)[3]
