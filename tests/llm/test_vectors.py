from __future__ import annotations

import numpy as np
import pytest

from cairn.llm.vectors import build_graph, nearest_vectors, query_graph, robust_prune, units

SCHEMA = "chunkId string, embedding array<float>, node string, similarity string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], "x", "y") for i, v in vectors], SCHEMA)


def plain(vectors, k=5, width=8):
    good = {i: np.array(v, np.float32).astype(float) for i, v in vectors if i is not None and v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    u = units(np.stack([good[i] for i in ids])) if ids else np.zeros((0, width))
    out = set()
    for a, i in enumerate(ids):
        order = sorted((-round(float(u[a] @ u[b]), 12), j) for b, j in enumerate(ids) if j != i)[:k]
        out |= {(i, j) for _, j in order}
    return out


def clustered(n, width, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 12), width))
    return centres[rng.integers(len(centres), size=n)] + 0.3 * rng.normal(size=(n, width))


def found(df):
    return {(r.id, r.neighbour) for r in df.collect()}


def test_small_equals_brute_force(spark):
    x = clustered(120, 8)
    data = [(f"v{i:03}", list(map(float, v))) for i, v in enumerate(x)]
    data += [(f"copy{i}", data[0][1]) for i in range(9)] + [(f"scaled{i}", [2.0 * a for a in data[1][1]]) for i in range(2)]
    data += [("none", None), ("short", [1.0] * 7), ("long", [1.0] * 9), ("null", [None] + [1.0] * 7), ("nan", [float("nan")] + [1.0] * 7), ("inf", [float("inf")] + [1.0] * 7), ("zero", [0.0] * 8), (None, [1.0] * 8)]
    out = nearest_vectors(table(spark, data), k=5, width=8)
    assert found(out) == plain(data)
    places = {}
    for r in out.collect():
        places.setdefault(r.id, []).append((r.place, r.similarity))
    assert all([p for p, _ in sorted(v)] == [1, 2, 3, 4, 5] and [s for _, s in sorted(v)] == sorted((s for _, s in v), reverse=True) for v in places.values())


def test_ties_go_to_the_smaller_id(spark):
    data = [(f"c{i:02}", [1.0, 0, 0, 0, 0, 0, 0, 0]) for i in range(20)] + [("z", [0.0, 1, 0, 0, 0, 0, 0, 0])]
    got = found(nearest_vectors(table(spark, data), k=5, width=8))
    assert got == plain(data) and ("c19", "c04") in got and ("c00", "c05") in got


def test_many_lengths_of_one_direction(spark):
    base, other = [float(x) for x in clustered(1, 8)[0]], [float(x) for x in clustered(2, 8, 3)[1]]
    data = [(f"s{i:03}", [x * 2.0 ** (i % 40 - 20) for x in base]) for i in range(300)] + [("a", other), ("b", [-x for x in other])]
    assert found(nearest_vectors(table(spark, data), k=5, width=8)) == plain(data)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_few(spark, n):
    data = [(f"v{i}", [float(i + 1), 1.0] + [0.0] * 6) for i in range(n)]
    assert found(nearest_vectors(table(spark, data), k=5, width=8)) == plain(data)


def test_recall_over_many_shards(spark):
    x = clustered(3000, 16, 3)
    data = [(f"v{i:04}", list(map(float, v))) for i, v in enumerate(x)]
    want = plain(data, 5, 16)
    got = found(nearest_vectors(table(spark, data), k=5, width=16, shard=200))
    assert len(got & want) / len(want) >= 0.95 and len(got) == 15000


def test_recall_of_a_graph():
    u = units(clustered(4000, 32, 5))
    x, edges, pivots = build_graph(u)
    ids, _ = query_graph(x, edges, pivots, u, np.full(len(u), -1), 6)
    s = u @ u.T
    true = np.argsort(-s, axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(ids, true)]) >= 0.95
    assert (edges[:-1] <= len(u)).all() and not (edges[:-1] == np.arange(len(u))[:, None]).any()


def test_prune_keeps_diverse_edges():
    u = units(np.array([[1, 0], [0.99, 0.1], [0.98, 0.12], [0.5, -0.9]]))
    x = np.concatenate([u, np.zeros((1, 2))]).astype(np.float32)
    kept = robust_prune(x, np.array([0]), np.array([[1, 2, 3, 4]], np.int32), 1.0, 4)[0]
    assert 1 in kept and 3 in kept and 2 not in kept[kept < 4][:2]
