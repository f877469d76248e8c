"""Near-duplicate texts by MinHash with Bayesian pruning.

Every text becomes the set of its word shingles. Texts with the same set form a class and are
compared once. Classes that agree in one band of MinHash values are candidates. For each, MinHash
values are compared in steps; after every step the number of agreements gives the posterior
probability that the similarity reaches the threshold, and the pair is dropped when that falls
below the tolerance. What is left is verified on the shingle sets themselves.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.words import WordHashes, shingles
from cairn.operators.spread import spread_join
from cairn.session import drop_table, work_table

#: Values of a band, and the chance of missing a pair just at the threshold, which fixes the bands.
ROWS, MISS = 5, 0.0005
#: Values that the Bayesian test compares, in steps of STEP; it drops a pair below TOLERANCE. The first
#: HEAD of them go along with the bands, so that most pairs are dropped where they meet.
TESTED, STEP, TOLERANCE, HEAD = 128, 16, 1e-4, 32
#: A bucket with more classes, and a class with more copies, is cut into blocks of this size, and
#: blocks meet pairwise.
BLOCK = 512

_KNOWN = WordHashes()


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return max(1, math.ceil(math.log(miss) / math.log1p(-(threshold**rows))))


@functools.cache
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20250401)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def minhash(items: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values (32 bits each) of a non-empty set of 64-bit hashes."""
    a, b = _multipliers(n)
    own = (items >> np.uint64(32)).astype(np.uint32)  # the hashes are mixed, so half of one will do
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(own), 512):  # a very long text takes no more memory
        v = a[:, None] * own[None, at : at + 512]
        v += b[:, None]
        np.minimum(out, v.min(axis=1), out=out)
    return out


@functools.cache
def needed_matches(threshold: float, tested: int = TESTED, step: int = STEP, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each step the fewest agreements with P(similarity >= threshold | agreements) >= tolerance.

    The prior is uniform, so the posterior is Beta(m + 1, n - m + 1); its tail at the threshold is
    the chance of at most m successes in n + 1 trials.
    """
    out = []
    for n in range(step, tested + 1, step):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out.append(m)
                break
    return tuple(out)


def bayes_keep(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of two matrices of MinHash values survive the incremental test."""
    alive = np.arange(len(a))
    seen = np.zeros(len(a), np.int32)
    for i, least in enumerate(needed_matches(threshold, a.shape[1])):
        part = slice(i * STEP, (i + 1) * STEP)
        seen[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[seen[alive] >= least]
    return alive


def _sign(size: int, bands: int, rows: int):
    total = max(bands * rows, TESTED)
    pick = (np.arange(TESTED) * total) // TESTED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, cls, sig, keys = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                s = shingles(text, size, _KNOWN)
                if not len(s):
                    continue
                m = minhash(s, total)
                keep.append(i)
                cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig.append(m[pick].astype(np.uint16).tobytes())
                keys.append([xxhash.xxh3_64_intdigest(m[j * rows : (j + 1) * rows].tobytes(), j) - (1 << 63) for j in range(bands)])
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), kept.column(2), pa.array(cls, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "owner", "text", "cls", "sig", "bands"])

    return run


def _prune(threshold: float, values: int):
    """Pairs ``(a, b)`` out of ``(a, b, sig_a, sig_b)`` that the first ``values`` values let through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1)[:, :values] for k in (2, 3)) if batch.num_rows else [np.zeros((0, values), np.uint16)] * 2
            keep = pa.array(bayes_keep(x, y, threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return run


def _verify(size: int, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known: dict[str, np.ndarray] = {}
            out = []
            for ta, tb in zip(pdf["text_a"], pdf["text_b"]):
                for t in (ta, tb):
                    if t not in known:
                        known[t] = shingles(t, size, _KNOWN)
                x, y = known[ta], known[tb]
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both / (len(x) + len(y) - both))
            pdf = pdf.assign(similarity=np.array(out, np.float64))[["a", "b", "similarity"]]
            yield pdf[pdf["similarity"] >= threshold - 1e-12]

    return run


def _shared_bands(reps: DataFrame, block: int) -> DataFrame:
    """``(key, cls, blocks, head)`` of the bands that several classes share, written.

    They are few, and counted first, which combines a hot one before the shuffle.
    """
    rows = reps.select("cls", F.explode("bands").alias("key"))
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = rows.join(size, "key").select("key", "cls", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    return work_table(shared.join(reps.select("cls", F.substring("sig", 1, 2 * HEAD).alias("head")), "cls"), "shared_bands")


def _meet(shared: DataFrame, threshold: float, differ: str | None = None) -> DataFrame:
    """Pairs of classes that share a band and may be similar, each once.

    Those of a hot band meet block by block, and the first steps of the Bayesian test are made
    there, before anything is shuffled. ``differ`` names a column in which the two must differ.
    """
    extra = [differ] if differ else []
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # A row meets those of its own block and of every other one; a small bucket has one block.
    left = shared.select("key", "cls", "head", *extra, own.alias("i"), others.alias("j"))
    right = shared.select("key", F.col("cls").alias("other"), F.col("head").alias("other_head"), *[F.col(c).alias(f"other_{c}") for c in extra], own.alias("j"), others.alias("i"))
    pairs = left.join(right, ["key", "i", "j"]).where("cls < other")
    if differ:
        pairs = pairs.where(F.col(differ) != F.col(f"other_{differ}"))
    return pairs.select("cls", "other", "head", "other_head").mapInArrow(_prune(threshold, HEAD), "a binary, b binary").distinct()


def _classes(texts: DataFrame, id_col: str, owner: str, text: str, size: int, threshold: float, rows: int, miss: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(members, reps, many)``: the class of every id, one row for each class, and ``(cls, n)`` of
    those with several ids."""
    src = texts.select(F.col(id_col).alias("id"), F.col(owner).alias("owner"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    bands = bands_for(threshold, rows, miss)
    signed = work_table(src.mapInArrow(_sign(size, bands, rows), f"id {src.schema['id'].dataType.simpleString()}, owner {src.schema['owner'].dataType.simpleString()}, text string, cls binary, sig binary, bands array<long>"), "signed")
    members = signed.select("id", "owner", "cls")
    # One row stands for a class: the others, which are few but for copies, are taken out by id.
    many = signed.groupBy("cls").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    others = spread_join(members.select("cls", "id"), many, ["cls"], "id").where("id <> first").select("id")
    return members, signed.join(others, "id", "left_anti"), many.select("cls", "n")


def _verified(pairs: DataFrame, reps: DataFrame, size: int, threshold: float) -> DataFrame:
    """``(a, b, similarity)`` of the candidate pairs that survive the Bayesian test and are similar."""
    sig = reps.select("cls", "sig")
    tested = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
    kept = tested.select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(threshold, TESTED), "a binary, b binary")
    text_of = reps.select("cls", "text")
    full = kept.join(text_of.toDF("a", "text_a"), "a").join(text_of.toDF("b", "text_b"), "b")
    return full.select("a", "b", "text_a", "text_b").mapInPandas(_verify(size, threshold), "a binary, b binary, similarity double")


def similar_classes(texts: DataFrame, id_col: str, owner: str, text: str, size: int = 5, threshold: float = 0.8, rows: int = ROWS, miss: float = MISS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: ``(id, owner, cls)`` and ``(a, b, similarity)`` between classes.

    ``texts`` has one row per id. A class holds the ids with the same set of shingles; texts with
    fewer than ``size`` words have no shingles and belong to no class. Every link between
    different classes is there once (but for the stated ``miss`` of the candidate search), with
    a < b; copies are not expanded.
    """
    members, reps, _ = _classes(texts, id_col, owner, text, size, threshold, rows, miss)
    return members, _verified(_meet(_shared_bands(reps, block), threshold), reps, size, threshold)


def similar_pairs(texts: DataFrame, id_col: str = "chunkId", owner: str = "docId", text: str = "chunkText", size: int = 5, threshold: float = 0.8, rows: int = ROWS, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """All pairs ``(id_a, id_b, similarity)`` of ids with different owners, id_a < id_b.

    A null owner differs from every other. Copies are expanded, as every pair is asked for: the
    ids of a class with many copies are cut into blocks, and blocks meet pairwise.
    """
    members, reps, many = _classes(texts, id_col, owner, text, size, threshold, rows, miss)
    links = work_table(_verified(_meet(_shared_bands(reps, block), threshold), reps, size, threshold), "links")
    large = work_table(many.select("cls", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large")
    # copies are linked to each other like any two texts
    links = links.unionByName(large.select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("similarity")))
    m = spread_join(members, large, ["cls"], "id", "left").select("cls", "id", "owner", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int").alias("i"))
    blocks = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
    met = links.join(large.toDF("a", "na"), "a", "left").join(large.toDF("b", "nb"), "b", "left")
    met = met.select("a", "b", "similarity", "nb", blocks(F.col("na")).alias("i")).select("a", "b", "similarity", "i", blocks(F.col("nb")).alias("j"))
    pairs = met.join(m.toDF("a", "x", "ox", "i"), ["a", "i"]).join(m.toDF("b", "y", "oy", "j"), ["b", "j"])
    pairs = pairs.where("(a <> b OR x < y) AND (ox IS NULL OR oy IS NULL OR ox <> oy)")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` of every linked node: the smallest node that links lead to.

    Large-star and small-star in turn, until nothing changes: every node links its larger
    neighbours to its smallest one, then its smaller ones and itself. Labels pass between regions
    that way, so a long path takes a logarithmic number of rounds. Rounds are written tables.
    """
    ends = [F.greatest(a, b).alias("x"), F.least(a, b).alias("y")]
    edges = work_table(links.where(F.col(a) != F.col(b)).select(*ends).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.selectExpr("y AS x", "x AS y"))
        low = both.groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
        large = both.join(low, "x").where("y > x").selectExpr("y AS x", "m AS y").distinct()
        large = work_table(large, "large_star")
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        near = large.join(least, "x")
        small = near.where("y <> m").selectExpr("y AS x", "m AS y").unionByName(least.selectExpr("x", "m AS y")).distinct()
        done = work_table(small, "edges")
        changed = not (done.exceptAll(edges).isEmpty() and edges.exceptAll(done).isEmpty())
        for old in (edges, large):
            drop_table(old)
        edges = done
        if not changed:
            return edges.selectExpr("x AS node", "y AS root").unionByName(edges.selectExpr("y AS node", "y AS root").distinct())


def groups(texts: DataFrame, id_col: str = "chunkId", owner: str = "docId", text: str = "chunkText", size: int = 5, threshold: float = 0.8, rows: int = ROWS, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """``(id, group, copies)`` of every row with a non-empty shingle set.

    ``group`` is the smallest id among all that links between texts, directly or over others,
    lead to; it is the row's own id where there is none. ``copies`` counts the rows with the same
    shingle set, itself included.

    Not all pairs of a band need to meet for that: first each class meets the smallest one of its
    bands, a number of pairs in proportion to the rows; then only those that this leaves in
    different groups. A band that a third of all texts share is one group after the first step.
    """
    members, reps, _ = _classes(texts, id_col, owner, text, size, threshold, rows, miss)
    shared = _shared_bands(reps, block)
    lead = shared.groupBy("key").agg(F.min("cls").alias("a"))
    stars = spread_join(shared.select("key", "cls"), lead, ["key"], "cls").where("a <> cls").select("a", F.col("cls").alias("b")).distinct()
    first = work_table(_verified(stars, reps, size, threshold).select("a", "b"), "links")
    placed = shared.join(components(first), shared["cls"] == F.col("node"), "left").select("key", "cls", "blocks", "head", F.coalesce("root", "cls").alias("root"))
    split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    rest = _meet(spread_join(placed, split, ["key"], "cls", "left_semi"), threshold, differ="root")
    links = first.unionByName(_verified(rest, reps, size, threshold).select("a", "b"))
    roots = components(links).select(F.col("node").alias("cls"), "root")
    classes = members.groupBy("cls").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).join(roots, "cls", "left")
    classes = work_table(classes.select("cls", F.coalesce("root", "cls").alias("root"), "first", "copies"), "grouped")
    names = classes.groupBy("root").agg(F.min("first").alias("group"))
    named = spread_join(classes, names, ["root"], "cls").select("cls", "group", "copies")
    return spread_join(members, named, ["cls"], "id").select("id", "group", "copies")
