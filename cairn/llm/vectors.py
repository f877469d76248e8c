"""The most similar vectors of every vector, by pruned directed graphs over shards.

Vectors are spread over shards by their nearest coarse centroid. Each shard holds a directed
graph: greedy searches propose neighbours for a vector, and a relaxed distance rule keeps those
edges that lead somewhere the kept ones don't. A query walks the graphs of the shards whose
centroids are nearest to it with a beam, and the best of all are merged. Vectors of one direction
(to 12 decimals) are one node, whose ids are put back at the end. All array work is done for many queries at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.sampling import hash_sample
from cairn.operators.spread import spread_join
from cairn.session import work_table

#: Vectors of a shard, shards at most (which bounds what is broadcast), vectors of one graph.
SHARD, MOST_SHARDS, PART = 4096, 8192, 16_384
#: Rows the centroids are fitted on, about: so many for each, within these bounds; rounds of fitting.
FIT_EACH, FIT_ROWS, FIT_MOST, FIT_ROUNDS = 24, 20_000, 200_000, 6
#: Edges of a node, beam widths for building and for queries, and the rule's slack in two passes.
DEGREE, BUILD_BEAM, BEAM, SLACK = 16, 24, 24, (1.0, 1.2)
#: Shards a query visits, nodes a step opens, queries that walk together.
PROBES, STEP, TOGETHER = 6, 8, 512
#: Queries of one shard that one task answers, and vectors whose centroids are looked for at once.
BLOCK, TOGETHER_HOME = 16_384, 512


def units(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def beam_search(x: np.ndarray, edges: np.ndarray, q: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and similarities of the best ``beam`` nodes for each query, the best first; -1 pads.

    ``x`` has a last row of zeros and ``edges`` pads with that row's number.
    """
    n, rows = len(x) - 1, len(q)
    ids = np.full((rows, beam), n, np.int32)
    sims = np.full((rows, beam), -np.inf, np.float32)
    opened = np.ones((rows, beam), bool)
    seen = np.zeros((rows, n + 1), bool)
    seen[:, n] = True

    def add(r: np.ndarray, nodes: np.ndarray) -> None:
        """Score the nodes that are new to each row and keep the best."""
        nodes = np.sort(nodes, axis=1)
        new = ~seen[r[:, None], nodes]
        new[:, 1:] &= nodes[:, 1:] != nodes[:, :-1]
        seen[r[:, None], nodes] = True
        s = np.matmul(x[nodes], q[r][:, :, None])[:, :, 0]
        s[~new] = -np.inf
        all_ids = np.concatenate([ids[r], nodes], axis=1)
        all_sims = np.concatenate([sims[r], s], axis=1)
        all_open = np.concatenate([opened[r], ~new], axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[r], sims[r], opened[r] = (np.take_along_axis(v, top, axis=1) for v in (all_ids, all_sims, all_open))

    live = np.arange(rows)
    add(live, entries)
    while len(live):
        waiting = np.where(opened[live], -np.inf, sims[live])
        pick = np.argpartition(-waiting, min(STEP, beam) - 1, axis=1)[:, :STEP]
        good = np.take_along_axis(waiting, pick, axis=1) > -np.inf
        go = good.any(axis=1)
        live, pick, good = live[go], pick[go], good[go]
        if not len(live):
            break
        nodes = np.where(good, ids[live[:, None], pick], n)
        opened[live[:, None], pick] = True
        add(live, edges[nodes].reshape(len(live), -1))
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
    return np.where(np.isfinite(sims), ids, -1), sims


def robust_prune(x: np.ndarray, own: np.ndarray, cands: np.ndarray, slack: float, degree: int) -> np.ndarray:
    """Up to ``degree`` diverse neighbours for each of ``own`` out of ``cands`` (padded with n).

    Candidates are taken nearest first; each one taken removes those that are nearer to it, by
    the slack, than to the node itself.
    """
    n, width = len(x) - 1, cands.shape[1]
    cands = np.sort(np.where(cands == own[:, None], n, cands), axis=1)
    cands[:, 1:][cands[:, 1:] == cands[:, :-1]] = n
    xc = x[cands]
    dist = 2 - 2 * np.matmul(xc, x[own][:, :, None])[:, :, 0]
    dist[cands == n] = np.inf
    order = np.argsort(dist, axis=1)
    cands, dist = np.take_along_axis(cands, order, axis=1), np.take_along_axis(dist, order, axis=1)
    xc = x[cands]
    between = 2 - 2 * np.matmul(xc, xc.transpose(0, 2, 1))
    alive = np.isfinite(dist)
    out = np.full((len(own), degree), n, np.int32)
    rows = np.arange(len(own))
    for k in range(degree):
        has = alive.any(axis=1)
        if not has.any():
            break
        first = alive.argmax(axis=1)
        out[has, k] = cands[rows, first][has]
        # distances are squared, and so is the slack
        alive &= slack * slack * between[rows, first] > dist
        alive[rows, first] = False
    # free slots go to the nearest that were left out, so that no node ends up with few edges
    return out if width <= degree else _fill(out, cands, n)


def _fill(out: np.ndarray, cands: np.ndarray, n: int) -> np.ndarray:
    short = np.flatnonzero(out[:, out.shape[1] // 2] == n)
    for r in short:
        have = set(out[r][out[r] < n].tolist())
        extra = [c for c in cands[r] if c < n and c not in have][: out.shape[1] // 2 - len(have) + 1]
        out[r, len(have) : len(have) + len(extra)] = extra
    return out


def build_graph(vectors: np.ndarray, seed: int = 7, degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(x, edges, pivots)`` of unit vectors; x gets the row of zeros."""
    n = len(vectors)
    x = np.concatenate([vectors.astype(np.float32), np.zeros((1, vectors.shape[1]), np.float32)])
    rng = np.random.default_rng(seed)
    edges = np.full((n + 1, degree), n, np.int32)
    if n > 1:
        edges[:n, : degree // 2] = rng.integers(0, n, (n, degree // 2))
    pivots = np.sort(rng.choice(n, min(n, max(16, int(3 * np.sqrt(n)))), replace=False)).astype(np.int32)
    for slack in SLACK:
        order = rng.permutation(n)
        for at in range(0, n, TOGETHER):
            own = order[at : at + TOGETHER]
            found, _ = beam_search(x, edges, x[own], _entries(x, pivots, x[own]), min(BUILD_BEAM, max(2, n)))
            cands = np.concatenate([np.where(found < 0, n, found), edges[own]], axis=1)
            edges[own] = robust_prune(x, own, cands, slack, degree)
            # the way back
            q, p = edges[own].ravel(), np.repeat(own, degree).astype(np.int32)
            real = q < n
            q, p = q[real], p[real]
            by = np.argsort(q, kind="stable")
            q, p = q[by], p[by]
            to, first, count = np.unique(q, return_index=True, return_counts=True)
            back = np.full((len(to), min(int(count.max(initial=1)), 2 * degree)), n, np.int32)
            slot = np.arange(len(q)) - np.repeat(first, count)
            fits = slot < back.shape[1]
            back[np.repeat(np.arange(len(to)), count)[fits], slot[fits]] = p[fits]
            for b in range(0, len(to), TOGETHER):
                part = slice(b, b + TOGETHER)
                edges[to[part]] = robust_prune(x, to[part], np.concatenate([edges[to[part]], back[part]], axis=1), slack, degree)
    return x, edges, pivots


def _entries(x: np.ndarray, pivots: np.ndarray, q: np.ndarray, most: int = 8) -> np.ndarray:
    s = q @ x[pivots].T
    k = min(most, len(pivots))
    return pivots[np.argpartition(-s, k - 1, axis=1)[:, :k]]


def query_graph(x: np.ndarray, edges: np.ndarray, pivots: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """The best k nodes for each query; ``own`` is the query's own node or -1, which is left out."""
    n = len(x) - 1
    ids, sims = [], []
    for at in range(0, len(q), TOGETHER):
        part, mine = q[at : at + TOGETHER].astype(np.float32), own[at : at + TOGETHER]
        start = np.concatenate([_entries(x, pivots, part), np.where(mine < 0, n, mine)[:, None].astype(np.int32)], axis=1)
        i, s = beam_search(x, edges, part, start, max(2, min(beam, n)))
        s[(i == mine[:, None]) | (i < 0)] = -np.inf
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        i, s = np.take_along_axis(i, top, axis=1), np.take_along_axis(s, top, axis=1)
        ids.append(np.where(np.isfinite(s), i, -1))
        sims.append(s)
    return np.concatenate(ids), np.concatenate(sims)


def fit_centroids(sample: np.ndarray, count: int, rounds: int = FIT_ROUNDS, seed: int = 11) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(sample[a : a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def usable(df: DataFrame, id_col: str = "chunkId", vector: str = "embedding", width: int = 64) -> DataFrame:
    """``(id, vec, way)``: rows whose vector has ``width`` finite values, not all zero, and a digest
    of its direction to 12 decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sized = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy() == width)
            raw = np.ascontiguousarray(_matrix(column.take(pa.array(sized)), width), np.float32)  # a null inside is NaN
            good = np.isfinite(raw).all(axis=1) & raw.any(axis=1)
            raw, sized = raw[good], sized[good]
            ways = np.round(units(raw), 12) + 0.0 if len(raw) else np.zeros((0, width))
            vec = pa.ListArray.from_arrays(np.arange(len(raw) + 1, dtype=np.int32) * width, raw.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(sized)), vec, pa.array([xxhash.xxh3_128_digest(w.tobytes()) for w in ways], pa.binary())], ["id", "vec", "way"])

    rows = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<float>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, vec array<float>, way binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def nearest_vectors(vectors: DataFrame, k: int = 5, id_col: str = "chunkId", vector: str = "embedding", width: int = 64, shard: int = SHARD, probes: int = PROBES, beam: int = BEAM, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(id, neighbour, similarity, place)``: the k most similar others of every usable vector.

    Similarity is the cosine to 12 decimals; of equally similar ones the smaller id goes first. ``vectors`` has
    one row per id. Vectors that are null, of another length, hold null, NaN or infinite values,
    or are all zero give no rows and are nobody's neighbour. The centroids are fitted on at most
    ``fit_rows`` vectors and are MOST_SHARDS at most; every vector is indexed and is a query. Extra columns are never read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector, width)
    kind = rows.schema["id"].dataType.simpleString()
    # Vectors of one direction are one node; nodes are numbered once, in a written table.
    first = rows.groupBy("way").agg(F.min(F.struct("id", "vec")).alias("f"), F.count(F.lit(1)).alias("n"))
    classes = work_table(first.select(F.monotonically_increasing_id().alias("node"), "way", F.col("f.id").alias("id"), "n", F.col("f.vec").alias("vec")), "classes")
    total = classes.count()
    if not total:
        return spark.createDataFrame([], f"id {kind}, neighbour {kind}, similarity double, place int")
    shards = max(1, min(MOST_SHARDS, -(-total // shard)))
    sample = hash_sample(classes, "id", max(fit_rows, min(FIT_MOST, FIT_EACH * shards))).select("vec").toArrow()
    centroids = fit_centroids(units(_matrix(sample.column(0), width)), shards).astype(np.float32)
    shared = spark.sparkContext.broadcast(centroids)
    visit = min(probes, len(centroids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.ascontiguousarray(_matrix(batch.column(1), width), np.float32)
            u = units(raw).astype(np.float32)
            top = np.concatenate([_homes(u[a : a + TOGETHER_HOME] @ shared.value.T, visit) for a in range(0, max(1, len(u)), TOGETHER_HOME)])
            offsets = np.arange(len(u) + 1, dtype=np.int32) * visit
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in raw], pa.binary()), pa.array(top[:, 0].copy()), pa.ListArray.from_arrays(offsets, top.ravel())], ["node", "raw", "home", "visits"])

    placed = work_table(classes.select("node", "vec").mapInArrow(assign, "node long, raw binary, home int, visits array<int>"), "placed")
    # One number per shard; there are at most MOST_SHARDS.
    held = {r[0]: r[1] for r in placed.groupBy("home").count().collect()}
    asked = {r[0]: r[1] for r in placed.select(F.explode("visits").alias("s")).groupBy("s").count().collect()}
    plan = [(s, -(-n // max(2 * shard, PART)), -(-asked.get(s, 1) // BLOCK)) for s, n in held.items()]
    parts = spark.createDataFrame(plan, "shard int, parts int, blocks int")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = b"".join(pdf["raw"])
        _, edges, pivots = build_graph(_stack(raw, width))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "part": [pdf["part"].iloc[0]], "nodes": [pdf["node"].to_numpy().tobytes()], "raw": [raw], "edges": [edges.tobytes()], "pivots": [pivots.tobytes()]})

    mine = placed.join(F.broadcast(parts), placed["home"] == parts["shard"]).select("shard", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", "raw")
    graphs = work_table(mine.groupBy("shard", "part").applyInPandas(build, "shard int, part int, nodes binary, raw binary, edges binary, pivots binary"), "graphs")
    ask = placed.select("node", "raw", F.explode("visits").alias("shard")).join(F.broadcast(parts), "shard")
    ask = ask.select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node", "raw")
    ready = graphs.join(F.broadcast(parts), "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"node": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "similarity": np.zeros(0)})
        g = right.iloc[0]
        nodes = np.frombuffer(g["nodes"], np.int64)
        u = _stack(g["raw"], width)
        edges = np.frombuffer(g["edges"], np.int32).reshape(len(u) + 1, -1)
        x = np.concatenate([u.astype(np.float32), np.zeros((1, width), np.float32)])
        asker = left["node"].to_numpy()
        by = np.argsort(nodes)
        at = np.minimum(np.searchsorted(nodes, asker, sorter=by), len(nodes) - 1)
        own = np.where(nodes[by[at]] == asker, by[at], -1)
        q = _stack(b"".join(left["raw"]), width)
        found, _ = query_graph(x, edges, np.frombuffer(g["pivots"], np.int32), q, own, k + 1, beam)
        row, slot = np.nonzero(found >= 0)
        to = found[row, slot]
        return pd.DataFrame({"node": asker[row], "other": nodes[to], "similarity": np.einsum("ij,ij->i", q[row], u[to]).round(12)})

    near = ask.groupBy("shard", "part", "block").cogroup(ready.groupBy("shard", "part", "block")).applyInPandas(answer, "node long, other long, similarity double")
    return _put_back(work_table(near, "near"), rows, classes.drop("vec"), k)


def _stack(raw: bytes, width: int) -> np.ndarray:
    """Unit vectors, exactly those that the values as they came give."""
    return units(np.frombuffer(raw, np.float32).reshape(-1, width))


def _homes(near: np.ndarray, visit: int) -> np.ndarray:
    """The columns of the ``visit`` greatest values of each row, the greatest first."""
    top = np.argpartition(-near, visit - 1, axis=1)[:, :visit]
    order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1).astype(np.int32)


def _put_back(near: DataFrame, rows: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """From nodes to ids: equal vectors are each other's nearest, and stand in for their node."""
    multi = classes.where("n > 1").select("way", "node")
    # a third of all vectors may be equal: their rows are spread over tasks
    members = work_table(spread_join(rows.select("way", "id"), multi, ["way"], "id").select("node", "id"), "members")
    w = Window.partitionBy("node").orderBy("id")
    # The window's limit is applied before the shuffle too, so a huge class ships few ids a task.
    groups = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy("node").agg(F.collect_list("id").alias("ids"))
    single = classes.where("n = 1").select("node", F.array("id").alias("ids"))
    names = single.unionByName(groups)
    # of a node's answers only the best k + 1, and those as similar as the last of them, can be needed
    answers = near.groupBy("node").agg(F.sort_array(F.collect_set(F.struct((-F.col("similarity")).alias("d"), "other"))).alias("all"))
    last = F.element_at("all", F.least(F.size("all"), F.lit(k + 1)))
    answers = answers.select("node", F.inline(F.filter("all", lambda x: x.d <= last.d))).select("node", "other", (-F.col("d")).alias("similarity"))
    entries = answers.join(names.withColumnRenamed("node", "other"), "other").select("node", F.explode("ids").alias("id"), "similarity")
    own = groups.select("node", F.explode("ids").alias("id"), F.lit(1.0).alias("similarity"))
    best = (
        entries.unionByName(own)
        .groupBy("node")
        .agg(F.collect_set(F.struct((-F.col("similarity")).alias("d"), F.col("id"))).alias("all"))
        .select("node", F.slice(F.sort_array("all"), 1, k + 1).alias("best"))
    )
    best = work_table(best, "best")
    alone = classes.where("n = 1").select("node", "id").join(best, "node").select("node", "id", "best")
    equal = spread_join(members, best.join(multi.select("node"), "node"), ["node"], "id").select("node", "id", "best")
    picked = alone.unionByName(equal).select("id", F.slice(F.filter("best", lambda b: b.id != F.col("id")), 1, k).alias("best"))
    return picked.select("id", F.posexplode("best").alias("p", "b")).select("id", F.col("b.id").alias("neighbour"), (-F.col("b.d")).alias("similarity"), (F.col("p") + 1).cast("int").alias("place"))
