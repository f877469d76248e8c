"""What changed between consecutive full snapshots.

Each snapshot is summarised, per hash bucket of the key, by an invertible Bloom lookup table
over (key hash, pair hash). Subtracting the tables of neighbouring snapshots cancels whatever
did not change; what is left is peeled into the pairs that differ. So the comparison moves
cells, whose number follows the number of changes, and not rows. A bucket that doesn't peel is
built again with more cells; one that never does is compared row by row. The peeled pairs are
looked up in the snapshots, which gives the keys themselves and classifies them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.current import current_rows
from cairn.session import work_table

#: Rows of one snapshot that share a bucket, on average.
ROWS_PER_BUCKET = 1024
#: Cells of each of the three sub-tables at first, the factor for buckets that fail, the rounds.
FIRST_CELLS, ENLARGE, ROUNDS = 96, 4, 4

_SCHEMA = "pair int, bucket long, side int, k long, v long, ok boolean"
_DIFF_SCHEMA = "index_version long, chunkId string, change_type string"

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxhash64_long(values: np.ndarray, seed: np.ndarray | int = 42) -> np.ndarray:
    """XXH64 of 8-byte integers, as Spark's ``xxhash64`` computes it for one BIGINT column."""
    with np.errstate(over="ignore"):
        v = values.astype(np.int64).view(np.uint64)
        s = np.asarray(seed, dtype=np.int64).view(np.uint64) if isinstance(seed, np.ndarray) else np.uint64(seed)
        h = s + _P5 + np.uint64(8)
        h = h ^ (_rotl(v * _P2, 31) * _P1)
        h = _rotl(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def check_hash(k: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64(k, v)``: the first hash seeds the second."""
    return xxhash64_long(v, xxhash64_long(k))


def positions(v: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each of the three sub-tables, from three slices of the pair hash."""
    return np.stack([i * cells + ((v >> (20 * i)) & 0xFFFFF) % cells for i in range(3)])


def peel(pos: np.ndarray, cnt: np.ndarray, kx: np.ndarray, vx: np.ndarray, cx: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Peel one subtracted table; position -1 holds the digest of the whole difference."""
    n, k, v, c = (np.zeros(3 * cells, np.int64) for _ in range(4))
    real = pos >= 0
    for table, column in ((n, cnt), (k, kx), (v, vx), (c, cx)):
        table[pos[real]] = column[real]
    found_k, found_v, found_s = [], [], []
    for _ in range(3 * cells + 1):
        at = np.flatnonzero(np.abs(n) == 1)
        if len(at):
            at = at[check_hash(k[at], v[at]) == c[at]]
            at = at[(positions(v[at], cells) == at).any(axis=0)]
        if not len(at):
            break
        _, first = np.unique(np.stack([k[at], v[at]]), axis=1, return_index=True)
        at = at[first]
        pk, pv, pc, ps = k[at], v[at], c[at], n[at]
        for row in positions(pv, cells):
            np.subtract.at(n, row, ps)
            np.bitwise_xor.at(k, row, pk)
            np.bitwise_xor.at(v, row, pv)
            np.bitwise_xor.at(c, row, pc)
        found_k.append(pk)
        found_v.append(pv)
        found_s.append(ps)
    fk, fv, fs = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_k, found_v, found_s))
    ok = not (n.any() or k.any() or v.any() or c.any())
    if ok:  # an independent digest of the difference
        d = ~real
        same = lambda want, got: int(want[d].sum() if want is cnt else np.bitwise_xor.reduce(want[d], initial=0)) == got
        ok = same(cnt, int(fs.sum())) and same(kx, int(np.bitwise_xor.reduce(xxhash64_long(fk ^ 7), initial=0))) and same(vx, int(np.bitwise_xor.reduce(xxhash64_long(fv ^ 11), initial=0)))
    return fk, fv, fs, ok


def _peel_batches(cells: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for pair, bucket, table in zip(batch["pair"], batch["bucket"], batch["cells"]):
                t = np.array([tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in table], dtype=np.int64).reshape(-1, 5)
                k, v, s, ok = peel(t[:, 0], t[:, 1], t[:, 2], t[:, 3], t[:, 4], cells)
                if not ok:
                    k, v, s = (np.zeros(1, np.int64) for _ in range(3))
                out.append(pd.DataFrame({"pair": np.int32(pair), "bucket": np.int64(bucket), "side": s.astype(np.int32), "k": k, "v": v, "ok": ok}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"pair": np.zeros(0, np.int32), "bucket": np.zeros(0, np.int64), "side": np.zeros(0, np.int32), "k": np.zeros(0, np.int64), "v": np.zeros(0, np.int64), "ok": np.zeros(0, bool)})

    return run


def _tables(rows: DataFrame, cells: int, last: int) -> DataFrame:
    """Subtracted tables: one row per pair of snapshots and bucket, with the cells that aren't zero."""
    slots = [F.lit(i * cells) + F.pmod(F.shiftright("v", 20 * i).bitwiseAND(F.lit(0xFFFFF)), F.lit(cells)).cast("int") for i in range(3)]
    per_snapshot = (
        rows.select("ord", "bucket", "k", "v", F.explode(F.array(F.lit(-1), *slots)).alias("pos"))
        .select("ord", "bucket", "pos", *[F.when(F.col("pos") < 0, d).otherwise(own).alias(n) for n, own, d in (("k", F.col("k"), F.xxhash64(F.col("k").bitwiseXOR(F.lit(7)))), ("v", F.col("v"), F.xxhash64(F.col("v").bitwiseXOR(F.lit(11)))), ("c", F.xxhash64("k", "v"), F.lit(0).cast("long")))])
        .groupBy("ord", "bucket", "pos")
        .agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(c).alias(c) for c in ("k", "v", "c")])
    )
    sides = F.filter(F.array(F.struct(F.col("ord").alias("pair"), F.lit(1).alias("sign")), F.struct((F.col("ord") + 1).alias("pair"), F.lit(-1).alias("sign"))), lambda s: (s.pair >= 1) & (s.pair <= last))
    return (
        per_snapshot.withColumn("s", F.explode(sides))
        .groupBy(F.col("s.pair").alias("pair"), "bucket", "pos")
        .agg(F.sum(F.col("n") * F.col("s.sign")).alias("n"), *[F.bit_xor(c).alias(c) for c in ("k", "v", "c")])
        .where("n <> 0 OR k <> 0 OR v <> 0 OR c <> 0")
        .groupBy("pair", "bucket")
        .agg(F.collect_list(F.struct("pos", "n", "k", "v", "c")).alias("cells"))
    )


def snapshot_changes(
    snapshots: DataFrame,
    version: str = "index_version",
    key: str = "chunkId",
    content: str = "contentHash",
    landed: str = "landed_ts",
    rows_per_bucket: int = ROWS_PER_BUCKET,
    first_cells: int = FIRST_CELLS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Added, removed and changed keys between each snapshot and the one before it.

    Returns ``(index_version, chunkId, change_type)`` (the version and key columns keep these
    names), one row per case, the version being that of the later snapshot.

    Of several rows of a key in one snapshot the one with the greatest ``landed`` counts.
    Contents compare without letter case and surrounding blanks; null equals null only; an
    empty content is a value. Rows with null key or version belong to no snapshot and are left
    out. An empty table or a single snapshot gives no rows. Extra columns are never read.
    """
    spark = snapshots.sparkSession
    src = snapshots.select(F.col(version).cast("long").alias("ver"), F.col(key).cast("string").alias("key"), F.lower(F.btrim(F.col(content), F.lit(" \t\r\n\f\x0b"))).alias("content"), F.col(landed).alias("landed"))
    # One number per snapshot: their count doesn't grow with the rows.
    versions = sorted(r[0] for r in src.select("ver").where("ver IS NOT NULL").distinct().collect())
    if len(versions) < 2:
        return spark.createDataFrame([], _DIFF_SCHEMA)
    # Small enough to be broadcast by its size; Spark checks that against its threshold.
    order = spark.createDataFrame([(v, i) for i, v in enumerate(versions)], "ver long, ord int")
    latest = current_rows(src, ["ver", "key"], "landed", ["ver", "key", "content"])
    hashed = latest.join(order, "ver").select("ord", "key", F.xxhash64("key").alias("k"), F.xxhash64(F.lit(1), "key", F.coalesce("content", F.lit("")), F.col("content").isNull()).alias("v"))
    rows = work_table(hashed, "snapshot_rows")
    total = rows.count()  # from the Parquet footers
    buckets = max(1, total // (len(versions) * rows_per_bucket))
    rows = rows.withColumn("bucket", F.pmod("k", F.lit(buckets)))
    last, cells, todo, results = len(versions) - 1, first_cells, None, []
    for _ in range(rounds):
        part = rows
        if todo is not None:
            touched = todo.select(F.explode(F.array(F.col("pair"), F.col("pair") - 1)).alias("ord"), "bucket").distinct()
            part = rows.join(touched, ["ord", "bucket"], "left_semi")
        tables = _tables(part, cells, last)
        if todo is not None:
            tables = tables.join(todo, ["pair", "bucket"], "left_semi")
        # tables are small but slow to peel: a number of tasks that isn't cut down to their bytes
        tables = tables.repartition(max(1, min(buckets * last, spark.sparkContext.defaultParallelism * 2)), "pair", "bucket")
        peeled = work_table(tables.mapInPandas(_peel_batches(cells), _SCHEMA), "peeled")
        results.append(peeled.where("ok").select("pair", "side", "k", "v"))
        todo = peeled.where("NOT ok").select("pair", "bucket")
        cells *= ENLARGE
        if todo.isEmpty():
            todo = None
            break
    found = results[0]
    for r in results[1:]:
        found = found.unionByName(r)
    hits = found.withColumn("ord", F.when(F.col("side") > 0, F.col("pair")).otherwise(F.col("pair") - 1))
    named = rows.join(hits, ["ord", "k", "v"]).select("pair", "side", "key")
    if todo is not None:  # the exact way for buckets that never peeled
        both = rows.withColumn("s", F.explode(F.array(F.struct(F.col("ord").alias("pair"), F.lit(1).alias("side")), F.struct((F.col("ord") + 1).alias("pair"), F.lit(-1).alias("side")))))
        rest = both.select("s.pair", "s.side", "bucket", "key", "v").join(todo, ["pair", "bucket"], "left_semi")
        net = rest.groupBy("pair", "key", "v").agg(F.sum("side").alias("side")).where("side <> 0")
        named = named.unionByName(net.select("pair", F.col("side").cast("int").alias("side"), "key"))
    kinds = named.groupBy("pair", "key").agg(F.max("side").alias("hi"), F.min("side").alias("lo"))
    kind = F.when((F.col("hi") > 0) & (F.col("lo") < 0), "changed").when(F.col("hi") > 0, "added").otherwise("removed")
    later = order.withColumnRenamed("ord", "pair")
    return kinds.join(later, "pair").select(F.col("ver").alias("index_version"), F.col("key").alias("chunkId"), kind.alias("change_type"))
