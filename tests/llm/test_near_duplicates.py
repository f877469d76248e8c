from __future__ import annotations

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm.near_duplicates import bands_for, bayes_keep, components, groups, minhash, needed_matches, similar_classes, similar_pairs
from cairn.llm.words import WordHashes, shingles
from tests.conftest import rows

SCHEMA = "chunkId string, docId string, chunkText string, cls string, sig string"


def table(spark, *triples):
    return spark.createDataFrame([(*t, "x", "y") for t in triples], SCHEMA)


def plain(triples, size, threshold):
    sets = {}
    for i, d, t in triples:
        if i is not None and t is not None:
            w = re.findall(r"[^\W_]+", t.lower())
            s = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
            if s:
                sets[i] = (d, s)
    out = []
    for a in sets:
        for b in sets:
            (da, x), (db, y) = sets[a], sets[b]
            if a < b and (da is None or db is None or da != db) and len(x & y) >= threshold * len(x | y):
                out.append((a, b))
    return sorted(out)


def near(seed, words=60, edits=3):
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(words)]
    out = list(base)
    for _ in range(edits):
        out[r.randrange(words)] = f"e{r.randrange(10**6)}"
    return " ".join(base), " ".join(out)


def test_pairs_equal_brute_force(spark):
    data = []
    for k in range(12):
        a, b = near(k, edits=k % 7)
        data += [(f"a{k}", f"da{k}", a), (f"b{k}", f"db{k}" if k % 3 else f"da{k}", b)]
    data += [("c1", "x", data[0][2]), ("c2", "x", data[0][2].upper() + "!!"), ("c3", None, data[0][2]), ("c4", None, data[0][2])]
    data += [("n1", "y", None), ("n2", "z", ""), ("n3", "q", "two words"), ("n4", "r", "two words"), (None, "s", data[0][2]), ("long", "l", data[0][2] + " tail" * 20000), ("long2", "m", data[0][2] + " tail" * 20000)]
    got = sorted((a, b) for a, b, _ in rows(similar_pairs(table(spark, *data), size=3, threshold=0.6)))
    assert got == plain(data, 3, 0.6) and ("long", "long2") in got


def test_empty_and_no_pairs(spark):
    assert similar_pairs(table(spark, ("a", "d", "x y z")).limit(0), size=3, threshold=0.6).count() == 0
    two = table(spark, ("a", "d", "x y z"), ("b", "e", "u v w"))
    assert similar_pairs(two, size=3, threshold=0.6).count() == 0
    assert rows(groups(two, size=3, threshold=0.6)) == [("a", "a", 1), ("b", "b", 1)] and groups(two.limit(0), size=3, threshold=0.6).count() == 0


def test_blocks_find_the_same(spark):
    data = [(f"i{k:02}", f"d{k}", near(3, edits=0)[0] + f" end{k % 9}") for k in range(40)]
    assert sorted((a, b) for a, b, _ in rows(similar_pairs(table(spark, *data), size=3, threshold=0.6, block=3))) == plain(data, 3, 0.6)


def test_copies_are_compared_once(spark):
    a, b = near(5, edits=1)
    data = [(f"a{k}", f"d{k}", a) for k in range(30)] + [(f"b{k}", f"e{k}", b) for k in range(30)]
    members, links = similar_classes(table(spark, *data), "chunkId", "docId", "chunkText", size=3, threshold=0.6)
    assert members.count() == 60 and links.count() == 1


def test_groups_follow_links(spark):
    base = [f"w{i}" for i in range(40)]
    chain = [" ".join(base[k * 4 :] + [f"t{j}" for j in range(k * 4)]) for k in range(4)]  # each near the next only
    data = [(f"c{k}", f"d{k}", t) for k, t in enumerate(chain)] + [("copy", "dc", chain[0]), ("alone", "da", "quite other words that nobody else has here"), ("short", "ds", "one")]
    got = {r[0]: (r[1], r[2]) for r in groups(table(spark, *data), size=3, threshold=0.6).collect()}
    assert got["alone"] == ("alone", 1) and "short" not in got
    assert {got[f"c{k}"][0] for k in range(4)} == {got["copy"][0]} == {min("c0", "copy")}
    assert got["copy"] == got["c0"] and got["c0"][1] == 2


def test_groups_equal_components_of_all_pairs(spark):
    data = []
    for k in range(8):
        for j in range(6):
            data.append((f"k{k}j{j}", f"d{k}{j}", near(50 + k, edits=j * 2)[1]))
    data += [(f"hot{j:02}", f"h{j}", near(3, edits=0)[0] + f" end{j}") for j in range(40)]
    parent = {i: i for i, _, _ in data}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in plain(data, 3, 0.6):
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    got = {r[0]: r[1] for r in groups(table(spark, *data), size=3, threshold=0.6, block=7).collect()}
    assert got == {i: top(i) for i in parent}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"{i:04}", f"{i + 1:04}") for i in range(60)] + [("x", "y")], "a string, b string")
    got = dict(rows(components(links)))
    assert set(got.values()) == {"0000", "x"} and len(got) == 63


def test_components_of_a_long_shuffled_path(spark):
    ids = [f"{i:04}" for i in range(1000)]
    random.Random(7).shuffle(ids)
    links = spark.createDataFrame(list(zip(ids, ids[1:])), "a string, b string")
    assert rows(components(links)) == [(f"{i:04}", "0000") for i in range(1000)]


def test_minhash_estimates_and_pruning():
    known = WordHashes()
    for k in range(20):
        a, b = near(k, words=200, edits=5)
        x, y = shingles(a, 3, known), shingles(b, 3, known)
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((minhash(x, 450) == minhash(y, 450)).mean() - true) < 0.12
    assert 1 - (1 - 0.6**5) ** bands_for(0.6) > 0.999
    least = needed_matches(0.6)
    assert list(least) == sorted(least) and len(least) == 8


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10**6))
def test_pruning_keeps_true_pairs(seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**16, (400, 128)).astype(np.uint16)
    b = np.where(rng.random((400, 128)) < 0.65, a, a + 1).astype(np.uint16)
    far = np.where(rng.random((400, 128)) < 0.2, a, a + 1).astype(np.uint16)
    assert len(bayes_keep(a, b, 0.6)) >= 399 and len(bayes_keep(a, far, 0.6)) <= 1
