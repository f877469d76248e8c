from __future__ import annotations

import random

import numpy as np
import pytest

from cairn.llm.leaks import BITS, _Items, _starts, edit_distances, leaks, repetitions
from cairn.llm.words import WordHashes, hashes, words
from tests.conftest import DATA, rows


def sentence(seed, n=40):
    r = random.Random(seed)
    return [f"w{r.randrange(3000)}" for _ in range(n)]


def tables(spark, docs, items):
    return spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string"), spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")


def plain(docs, items, w=12):
    out = set()
    import re

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    for i, t in items:
        grams = {tuple(words(t)[k : k + w]) for k in range(len(words(t)) - w + 1)}
        for d, s in docs:
            x = words(s)
            if d is not None and i is not None and any(tuple(x[k : k + w]) in grams for k in range(len(x) - w + 1)):
                out.add((d, i))
    return out


ITEM = sentence(1)
ITEMS = [(1, " ".join(ITEM)), (2, " ".join(sentence(2))), (3, " ".join(ITEM[:12])), (4, "too short"), (5, None), (6, ""), (None, " ".join(ITEM)), (7, " ".join(ITEM[20:]) + " own")]
DOCS = [
    (10, "before " + ", ".join(ITEM[5:17]).upper() + " after"), (11, " ".join(ITEM[5:16])), (12, "\n\n".join(ITEM)), (13, None), (14, ""), (15, "x"), (None, " ".join(ITEM)),
    (16, " ".join(sentence(9, 30000) + ITEM[:12] + sentence(10, 10))), (17, " ".join(sentence(2)[3:20])), (12, "\n\n".join(ITEM)), (18, "_".join(ITEM[25:])),
]


@pytest.mark.parametrize("edits", [0, 1])
@pytest.mark.parametrize("broadcast_words", [10**6, 0])
def test_equals_brute_force(spark, broadcast_words, edits):
    d, i = tables(spark, DOCS, ITEMS)
    got = rows(leaks(d, i, edits=edits, broadcast_words=broadcast_words))
    assert {(a, b) for a, b, _, k in got if k == 0} == plain(DOCS, ITEMS) and len(got) == len({x[:2] for x in got})
    assert edits or {(a, b): n for a, b, n, _ in got}[12, 1] == len(ITEM) - 11
    # eleven words of an item are one edit from its window of twelve
    assert ((11, 1, 1) in {(a, b, k) for a, b, _, k in got}) == bool(edits)


def test_both_ways_agree_on_a_hot_passage(spark):
    docs = [(k, f"some words {k} " + " ".join(ITEM[k % 3 : 20])) for k in range(300)]
    d, i = tables(spark, docs, ITEMS)
    assert rows(leaks(d, i, edits=1, broadcast_words=0)) == rows(leaks(d, i, edits=1))


@pytest.mark.parametrize("window", [12, 16])
def test_recall_against_brute_force_on_the_tables(spark, window):
    """Texts with an edited passage of an item put into them, all pairs of windows compared."""
    r = random.Random(window)
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{DATA}/eval_items.parquet").where("item_id % 12 = 0").orderBy("item_id").collect() if len(words(x.text)) > 20]
    texts = [words(x.text) for x in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(20).collect()]
    placed = []
    for k, t in enumerate(texts):
        w = words(items[k % len(items)][1])
        at = r.randrange(len(w) - 17)
        part = w[at : at + 17]
        for cut in (5, 11) if window == 12 else (8,):
            part[cut : cut + 1] = r.choice([["changed"], [], [part[cut], "more"]])
        placed.append((k, " ".join(t[:60] + part + t[60:120])))
    docs, items = spark.createDataFrame(placed, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    known = WordHashes()
    own = {r.item_id: hashes(r.text, known) for r in items.collect()}
    want = set()
    for r in docs.collect():
        h = np.concatenate([hashes(r.text, known), [np.uint64(0)]])
        starts = _starts([len(h)], window)
        theirs = np.concatenate([h, [np.uint64(0)]])[starts[:, None] + np.arange(window + 1)]
        for i, x in own.items():
            mine = x[_starts([len(x)], window)[:, None] + np.arange(window)]
            if (edit_distances(np.repeat(mine, len(starts), axis=0), np.tile(theirs, (len(mine), 1)), 1) <= 1).any():
                want.add((r.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in leaks(docs, items, window=window, edits=1).collect()}
    assert len(want) >= 10 and got <= want and len(got) >= 0.95 * len(want)


@pytest.mark.parametrize("broadcast_words", [10**6, 0])
def test_empty_tables(spark, broadcast_words):
    d, i = tables(spark, DOCS, ITEMS)
    assert leaks(d.limit(0), i, broadcast_words=broadcast_words).count() == leaks(d, i.limit(0), broadcast_words=broadcast_words).count() == 0


def test_edited_passages_reach_the_target_recall():
    r = random.Random(4)
    items = [(k, " ".join(sentence(100 + k, 16))) for k in range(150)]
    ready = _Items(items, 16, 1, BITS, repetitions(16, 1, BITS))
    texts = []
    for _, t in items:
        w, at = t.split(), r.randrange(1, 15)
        w[at : at + 1] = r.choice([["changed"], [], [w[at], "more"]])
        texts.append("one two three " + " ".join(w) + " four five six")
    found = {(t, i, k) for t, i, _, k in ready.leaked(texts)}
    assert np.mean([(k, k, 1) in found for k in range(150)]) >= 0.95 and all(t == i for t, i, _ in found)


def test_edit_distances():
    code = lambda s: np.array([[ord(c) for c in s]], np.uint64)
    near = lambda a, b, most: int(edit_distances(code(a), code(b), most)[0])
    assert near("abcd", "abcd", 2) == 0 and near("abcd", "abxd", 2) == 1
    assert near("abcd", "bcdef", 2) == 1 and near("abcd", "wxyz", 2) == 3
    assert near("ab", "abcdef", 2) == 0  # only the beginning of the second counts

    def plain_distance(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y)))
            prev = row
        return min(prev)

    r = random.Random(3)
    for _ in range(300):
        a = "".join(r.choice("abc") for _ in range(8))
        b = "".join(r.choice("abc") for _ in range(10))
        for most in (0, 1, 2):
            assert near(a, b, most) == min(plain_distance(a, b), most + 1)
