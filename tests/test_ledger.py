from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from cairn.operators.ledger import DONE, EVENTS, LEASED, PENDING, WorkLedger, fold, next_run
from tests.conftest import rows

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)
CHUNKS = "chunkId string, docId string, chunkContentHash string, extracted_ts timestamp, run_id string"
LOG = "run_id string, chunkId string, chunkContentHash string, logged_ts timestamp, docId string"
RUNS = "run_id string, run_ts long, publish_ts long, docId string"


def tables(spark, chunks, log, runs):
    return (
        spark.createDataFrame([(c, d, h, T0 + timedelta(hours=t), None) for c, d, h, t in chunks], CHUNKS),
        spark.createDataFrame([(r, c, h, T0, None) for r, c, h in log], LOG),
        spark.createDataFrame([(r, a, p, None) for r, a, p in runs], RUNS),
    )


def plain(chunks, log, runs):
    best = {}
    for c, d, h, t in chunks:
        if c is not None and (c not in best or t > best[c][2]):
            best[c] = (d, h, t)
    ok = {r for r, _, p in runs if p is not None and r is not None}
    start = {r: min(a for x, a, _ in runs if x == r) for r, _, _ in runs}
    out, open_docs, seen = set(), set(), set()
    for c, (d, h, _) in best.items():
        listed = [(start[r], lh) for r, lc, lh in log if lc == c and r in ok]
        if listed:
            seen.add(d)
        kind = "new" if not listed else "changed" if h is None or max(listed)[1] != h else None
        if kind:
            out.add(("chunk", c, kind))
            open_docs.add(d)
    return sorted(out | {("doc", d, "changed" if d in seen else "new") for d in open_docs if d is not None}, key=repr)


def test_next_run(spark):
    chunks = [("a", "d1", "h1", 1), ("a", "d1", "h0", 0), ("b", "d1", "h2", 1), ("c", "d2", "h3", 1), ("c", "d2", "h3", 1), ("e", "d3", None, 1), ("f", None, "h", 1), (None, "d9", "h", 1)]
    log = [("r1", "a", "h1"), ("r1", "a", "h1"), ("r1", "b", "h2"), ("r2", "b", "hx"), ("r3", "c", "h3"), ("r1", "e", None), ("unknown", "f", "h"), (None, "f", "h")]
    runs = [("r1", 10, None), ("r1", 12, 15), ("r2", 11, 20), ("r3", 30, None), (None, 5, 6)]
    got = rows(next_run(*tables(spark, chunks, log, runs)))
    assert got == plain(chunks, log, runs)
    # r2 began after r1's first attempt, so its hash of b is the last one
    assert ("chunk", "b", "changed") in got and ("chunk", "c", "new") in got and ("doc", "d2", "new") in got and ("doc", "d1", "changed") in got
    assert ("chunk", "a", "new") not in got and not [x for x in got if x[0] == "doc" and x[1] is None]


def test_empty_tables(spark):
    c, g, r = tables(spark, [("a", "d", "h", 1)], [("r", "a", "h")], [("r", 1, 2)])
    assert rows(next_run(c, g, r)) == []
    assert rows(next_run(c.limit(0), g, r)) == []
    assert rows(next_run(c, g.limit(0), r)) == [("chunk", "a", "new"), ("doc", "d", "new")]
    assert rows(next_run(c, g, r.limit(0))) == [("chunk", "a", "new"), ("doc", "d", "new")]


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10**6))
def test_random_histories(spark, seed):
    r = random.Random(seed)
    runs = [(f"r{i}", r.randrange(1000) * 10 + i, r.choice([None, 1])) for i in range(6) for _ in range(r.randrange(1, 3))]
    chunks = [(f"c{i}", f"d{i % 5}", r.choice(["h1", "h2", None]), t) for i in range(25) for t in range(r.randrange(1, 3))]
    log = list({(run, c): (f"r{run}", f"c{c}", r.choice(["h1", "h2"])) for run, c in ((r.randrange(6), r.randrange(25)) for _ in range(40))}.values())
    assert rows(next_run(*tables(spark, chunks, log, runs))) == plain(chunks, log, runs)


def items(spark, *pairs):
    return spark.createDataFrame(list(pairs), "item string, hash string")


def states(ledger, now):
    return {r.item: r.state for r in ledger.states(now).collect()}


def test_leases_and_commits(spark, tmp_path):
    ledger = WorkLedger(spark, f"file://{tmp_path}/l")
    assert ledger.states(0).count() == 0
    ledger.add(items(spark, ("a", "1"), ("b", "1"), ("b", "1")), "batch", now=1)
    ledger.add(items(spark, ("a", "1"), ("b", "1")), "batch", now=1)
    assert states(ledger, 1) == {"a": PENDING, "b": PENDING}
    claim = ledger.claim(60, now=2)
    assert states(ledger, 3) == {"a": LEASED, "b": LEASED} and ledger.leased(claim).count() == 2
    assert ledger.leased(ledger.claim(60, now=3)).count() == 0
    ledger.write(claim, ledger.leased(claim))
    ledger.write(claim, ledger.leased(claim))  # a retry replaces
    assert spark.read.parquet(claim.path).count() == 2
    assert ledger.commit(claim, now=4) == 2 and ledger.results().count() == 2 and states(ledger, 1000) == {"a": DONE, "b": DONE}
    # new content makes the item pending again
    ledger.add(items(spark, ("a", "2")), "batch2", now=5)
    assert states(ledger, 6) == {"a": PENDING, "b": DONE}


def test_expired_lease_and_stale_writer(spark, tmp_path):
    ledger = WorkLedger(spark, f"file://{tmp_path}/l")
    ledger.add(items(spark, ("a", "1")), "x", now=0)
    slow = ledger.claim(10, now=0)
    assert states(ledger, 5) == {"a": LEASED} and states(ledger, 11) == {"a": PENDING}
    quick = ledger.claim(10, now=11)
    assert quick.token > slow.token
    # the first one comes back: its token is old, its commit counts for nothing
    assert ledger.commit(slow, now=12) == 0 and states(ledger, 13) == {"a": LEASED}
    assert ledger.commit(quick, now=14) == 1 and states(ledger, 15) == {"a": DONE}


def test_parts_are_disjoint(spark, tmp_path):
    ledger = WorkLedger(spark, f"file://{tmp_path}/l")
    ledger.add(items(spark, *((f"i{k}", "1") for k in range(40))), "x", now=0)
    claims = [ledger.claim(10, now=1, part=(k, 3)) for k in range(3)]
    held = [{r.item for r in ledger.leased(c).collect()} for c in claims]
    assert sum(map(len, held)) == 40 and len(set.union(*held)) == 40


def test_stale_writer_leaves_nothing_in_the_results(spark, tmp_path):
    ledger = WorkLedger(spark, f"file://{tmp_path}/l")
    assert ledger.results() is None
    ledger.add(items(spark, ("a", "1"), ("b", "1")), "x", now=0)
    slow = ledger.claim(10, now=0)
    quick = ledger.claim(10, now=11)
    out = lambda claim, who: ledger.write(claim, ledger.events().where("kind = 'add'").select("item", F.lit(who).alias("by")))
    out(quick, "quick")
    assert ledger.results().count() == 0  # written, but not committed
    assert ledger.commit(quick, now=12) == 2
    out(slow, "slow")
    assert ledger.commit(slow, now=13) == 0
    assert rows(ledger.results()) == [("a", "quick"), ("b", "quick")]
    assert ledger.sweep() == [slow.token] and rows(ledger.results()) == [("a", "quick"), ("b", "quick")]


def test_skewed_clock(spark, tmp_path):
    """A stale commit by a clock that is behind is stale all the same."""
    ledger = WorkLedger(spark, f"file://{tmp_path}/l")
    ledger.add(items(spark, ("a", "1")), "x", now=0)
    slow, quick = ledger.claim(10, now=0), ledger.claim(10, now=11)
    # as if the slow writer had looked at what it holds before the other claim was written
    ledger._write(items(spark, ("a", "1")), f"done-{slow.token}", "done", slow.token, ledger._number(), 9.0)
    assert states(ledger, 12) == {"a": LEASED}
    assert ledger.commit(quick, now=5) == 1 and states(ledger, 13) == {"a": DONE}
    assert {r.done_token for r in ledger.states(13).collect()} == {quick.token}


def test_two_claimers_at_once(spark, tmp_path, monkeypatch):
    ledger, other = WorkLedger(spark, f"file://{tmp_path}/l"), WorkLedger(spark, f"file://{tmp_path}/l")
    ledger.add(items(spark, ("a", "1"), ("b", "1")), "x", now=0)
    before, seen = ledger.states(1).persist(), []
    before.count()
    monkeypatch.setattr(WorkLedger, "states", lambda self, now=None: (seen.append(1), before)[1] if len(seen) < 2 else fold(self.events(), F.timestamp_seconds(F.lit(now))).drop("added"))
    one, two = ledger.claim(10, now=1), other.claim(10, now=1)  # both saw the items pending
    assert one.token != two.token
    for claim, who in ((one, "one"), (two, "two")):
        ledger.write(claim, items(spark, ("a", who), ("b", who)))
    assert ledger.commit(one, now=2) + other.commit(two, now=3) == 2
    assert rows(ledger.results()) == [("a", "two"), ("b", "two")]


def test_crash_between_write_and_commit(spark, tmp_path):
    ledger = WorkLedger(spark, f"file://{tmp_path}/l")
    ledger.add(items(spark, ("a", "1")), "x", now=0)
    lost = ledger.claim(10, now=0)
    ledger.write(lost, items(spark, ("a", "lost")))
    again = ledger.claim(10, now=20)
    ledger.write(again, items(spark, ("a", "half")))
    ledger.write(again, items(spark, ("a", "whole")))  # a retry of the same claim replaces
    assert ledger.commit(again, now=21) == 1 and rows(ledger.results()) == [("a", "whole")]


def test_a_batch_entered_again_keeps_its_place(spark, tmp_path):
    ledger = WorkLedger(spark, f"file://{tmp_path}/l")
    ledger.add(items(spark, ("a", "1")), "first", now=0)
    ledger.add(items(spark, ("a", "2")), "second", now=1)
    ledger.add(items(spark, ("a", "1")), "first", now=2)
    assert {r.hash for r in ledger.states(3).collect()} == {"2"}


def test_work_of_a_run_under_way_is_not_given_out(spark):
    chunks, log, runs = tables(spark, [("a", "d", "h", 1), ("b", "d", "h", 1)], [("r1", "a", "h")], [("r1", 1_000_000, None)])
    at = lambda ms: F.timestamp_millis(F.lit(ms))
    assert rows(next_run(chunks, log, runs, now=at(1_000_500), lease_ms=1000)) == [("chunk", "b", "new"), ("doc", "d", "new")]
    assert len(rows(next_run(chunks, log, runs, now=at(1_002_000), lease_ms=1000))) == 3


def test_fold_of_odd_events(spark):
    ev = [(None, "h", "add", 0, 1, None, None), ("a", "h", "noise", 0, 1, None, None), ("b", None, "add", 0, 1, None, None), ("b", None, "done", 3, 4, None, None), ("c", "h", "done", 3, 4, None, None)]
    got = {r.item: (r.state, r.hash, r.done_token) for r in fold(spark.createDataFrame(ev, EVENTS), None).collect()}
    assert got == {"b": (PENDING, None, 3), "c": (DONE, None, 3)}
    assert fold(spark.createDataFrame([], EVENTS), None).count() == 0
