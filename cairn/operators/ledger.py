"""Processing only new or changed records: a ledger of work items.

A work item is a record key with the hash of its content. Its history is a set of events, kept
append-only; nothing is ever updated in place, so a failed writer leaves nothing half done.
An item is *leased* by a claim and *done* once the claim that holds the lease commits. A lease
that ran out, or whose run failed, returns the item to *pending*.

Claims and commits are numbered in one sequence, which fixes their order without a clock; a
claim's number is its fencing token. A commit is stale, and does not count, if the item was
claimed anew between the commit's own claim and the commit. Clocks only decide when a lease runs
out, so a wrong one may waste work but never lets a stale writer in.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PENDING, LEASED, DONE = "pending", "leased", "done"
#: How long the lease of a run's attempt lasts that never said it was over, in milliseconds.
LEASE_MS = 3_600_000

#: kind is 'add', 'lease' or 'done'. ``seq`` orders events; ``token`` is the claim's number.
EVENTS = "item string, hash string, kind string, token long, seq long, at timestamp, until timestamp"


def fold(events: DataFrame, now: Column | None, carry: tuple[str, ...] = ()) -> DataFrame:
    """The state of every item: ``(item, state, token, hash, done_token, done_hash, *carry)``.

    ``token`` is that of the newest claim, ``done_token`` and ``done_hash`` are those of the newest
    commit that counts. ``hash`` and the columns ``carry`` come from the item's newest 'add' and are
    null without one. A lease is live while ``until`` is after ``now``; ``now`` None is after the
    end of every lease. Events with a null item are left out; a repeated event changes nothing, and
    of events with one number the greatest ``at`` counts.

    Repetitions are combined before the shuffle, so an item has as many rows in it as it has
    different claims and commits, however often they are listed.
    """
    ev = events.where("item IS NOT NULL AND kind IN ('add', 'lease', 'done')")
    added = F.col("kind") == "add"
    # of all adds only the newest is of use, so they share a group; a claim and a commit have their own
    order = F.when(~added, F.col("seq"))
    body = F.struct(F.when(added, F.col("seq")).alias("seq"), "at", "hash", "until", *carry)
    ev = ev.groupBy("item", "kind", F.when(~added, F.col("token")).alias("token"), order.alias("order")).agg(F.max(body).alias("e"))
    # the newest claim there was when an event was written; the same partitions serve below
    so_far = Window.partitionBy("item").orderBy(F.col("order").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ev = ev.withColumn("newest", F.max(F.when(F.col("kind") == "lease", F.col("token"))).over(so_far)).where("kind <> 'done' OR newest IS NULL OR newest <= token")
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("token", "order", "e")))
    folded = ev.groupBy("item").agg(last("lease").alias("l"), last("done").alias("d"), F.max(F.when(F.col("kind") == "add", F.col("e"))).alias("a"))
    ended = F.lit(False) if now is None else F.col("l.e.until") > now
    live = F.col("l.token").isNotNull() & (F.col("l.token") > F.coalesce("d.token", F.lit(-1))) & F.coalesce(ended, F.lit(False))
    # a commit counts for the content it was made of; a null hash is a content nobody knows
    finished = F.col("d.token").isNotNull() & F.coalesce(F.col("a").isNull() | (F.col("d.e.hash") == F.col("a.hash")), F.lit(False))
    return folded.select(
        "item", F.when(live, LEASED).when(finished, DONE).otherwise(PENDING).alias("state"), F.col("l.token").alias("token"),
        F.coalesce("a.hash", F.when(F.col("a").isNull(), F.col("l.e.hash"))).alias("hash"), F.col("d.token").alias("done_token"), F.col("d.e.hash").alias("done_hash"), *[F.col(f"a.{c}").alias(c) for c in carry], F.col("a").isNotNull().alias("added"),
    )


def delivery_events(rows: DataFrame, item: str = "chunkId", hash_: str = "chunkContentHash", at: str = "extracted_ts", carry: tuple[str, ...] = ("docId",)) -> DataFrame:
    """An 'add' event for every delivery of a record; the newest by ``at`` is the current one."""
    none = F.lit(None)
    return rows.select(F.col(item).cast("string").alias("item"), F.col(hash_).alias("hash"), F.lit("add").alias("kind"), none.cast("long").alias("token"), F.unix_micros(at).alias("seq"), F.col(at).alias("at"), none.cast("timestamp").alias("until"), *carry)


def run_events(log: DataFrame, runs: DataFrame, run: str = "run_id", item: str = "chunkId", hash_: str = "chunkContentHash", at: str = "logged_ts", started: str = "run_ts", published: str = "publish_ts", lease_ms: int = LEASE_MS) -> DataFrame:
    """Ledger events of a log of runs: every listing is a claim, and one of a succeeded run a commit too.

    Runs follow one another, so a run's claim and commit are numbered by the smallest of its start
    times. It succeeded if any of its attempts has a publish time. A lease lasts for ``lease_ms``
    from the start of the run's last attempt. Rows whose run is unknown or null, or whose run has
    no start time, prove nothing and give no events.
    """
    outcome = runs.where(F.col(run).isNotNull()).groupBy(F.col(run).alias("run")).agg(F.min(started).cast("long").alias("token"), F.max(started).cast("long").alias("last"), F.max(published).isNotNull().alias("ok"))
    rows = log.select(F.col(run).alias("run"), F.col(item).cast("string").alias("item"), F.col(hash_).alias("hash"), F.col(at).alias("at"))
    listed = rows.join(outcome.where("token IS NOT NULL"), "run")
    kinds = F.explode(F.when(F.col("ok"), F.array(F.lit("lease"), F.lit("done"))).otherwise(F.array(F.lit("lease"))))
    listed = listed.select("item", "hash", "token", "at", "last", kinds.alias("kind"))
    done = F.col("kind") == "done"
    return listed.select("item", "hash", "kind", "token", (2 * F.col("token") + done.cast("long")).alias("seq"), "at", F.when(~done, F.timestamp_millis(F.col("last") + lease_ms)).alias("until"))


def next_run(chunks: DataFrame, log: DataFrame, runs: DataFrame, now: Column | None = None, lease_ms: int = LEASE_MS) -> DataFrame:
    """What the next run must take up: ``(unit, id, change_type)``.

    Deliveries, claims and commits are events of one ledger, folded by item; the open items are
    those whose state is 'pending'. unit 'chunk' has these: 'new' if no commit ever listed the
    item, else 'changed' (the last commit lists another hash, or the current hash is null: an
    unknown content can't be known to be done). unit 'doc' has the documents with an open chunk,
    'new' if no commit lists any chunk of theirs. ``now`` None is a time when no run is under way;
    otherwise items that a run still holds are not given out a second time.

    ``chunks`` may hold superseded and repeated rows; the row with the greatest ``extracted_ts``
    counts. Chunks with null chunkId are left out, a null docId gives no row of unit 'doc'. Extra
    columns are never read.
    """
    from cairn.session import work_table

    events = delivery_events(chunks).unionByName(run_events(log, runs, lease_ms=lease_ms), allowMissingColumns=True)
    states = fold(events, now, carry=("docId",)).where("added")
    kind = F.when(F.col("state") == PENDING, F.when(F.col("done_token").isNull(), "new").otherwise("changed"))
    work = work_table(states.select("item", "docId", kind.alias("change_type"), "done_token"), "open_work")
    docs = (
        work.where("docId IS NOT NULL")
        .groupBy("docId")
        .agg(F.max(F.col("change_type").isNotNull()).alias("open"), F.max(F.col("done_token").isNotNull()).alias("seen"))
        .where("open")
        .select(F.lit("doc").alias("unit"), F.col("docId").alias("id"), F.when(F.col("seen"), "changed").otherwise("new").alias("change_type"))
    )
    return work.where("change_type IS NOT NULL").select(F.lit("chunk").alias("unit"), F.col("item").alias("id"), "change_type").unionByName(docs)


@dataclass(frozen=True)
class Claim:
    """A lease on some items: pass it on to whoever does the work."""

    token: int
    until: float
    path: str


class WorkLedger:
    """A ledger kept in a folder of a file system that all executors share.

    ``events/`` holds one folder per write, named after what it holds, so a write that is tried
    again replaces itself. ``seq/`` has one empty file per claim and commit, made exclusively: its
    number is the event's place in the order. ``out/token=<n>`` holds what claim n wrote; a retry
    of the claim replaces it, and :meth:`results` reads of each item only the rows of the claim
    whose commit counts, so what a stale writer left there is never seen.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return [str(s.getPath().getName()) for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _number(self) -> int:
        """The next place in the order of events, taken exclusively."""
        n = 1 + max([0, *map(int, self._names("seq"))])
        while not self._fs.createNewFile(self._path(f"{self.root}/seq/{n}")):
            n += 1
        return n

    def events(self) -> DataFrame:
        if not self._names("events"):
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).option("recursiveFileLookup", True).parquet(f"{self.root}/events")

    def _write(self, rows: DataFrame, name: str, kind: str, token: int, seq: int, at: float, until: float | None = None) -> None:
        stamp = lambda t: F.timestamp_seconds(F.lit(t))
        ends = F.lit(None).cast("timestamp") if until is None else stamp(until)
        out = rows.select("item", "hash", F.lit(kind).alias("kind"), F.lit(token).cast("long").alias("token"), F.lit(seq).cast("long").alias("seq"), stamp(at).alias("at"), ends.alias("until"))
        out.write.mode("overwrite").parquet(f"{self.root}/events/{name}")

    def add(self, items: DataFrame, batch: str, now: float | None = None) -> None:
        """Enter ``(item, hash)``; the same batch entered twice counts once, at its first place."""
        known = [n for n in self._names("batches") if n.rpartition("@")[0] == batch]
        seq = min(int(n.rpartition("@")[2]) for n in known) if known else self._number()
        self._fs.createNewFile(self._path(f"{self.root}/batches/{batch}@{seq}"))
        self._write(items, f"add-{batch}", "add", 0, seq, time.time() if now is None else now)

    def states(self, now: float | None = None) -> DataFrame:
        return fold(self.events(), F.timestamp_seconds(F.lit(time.time() if now is None else now))).drop("added")

    def claim(self, seconds: float, now: float | None = None, part: tuple[int, int] = (0, 1)) -> Claim:
        """Lease all pending items (or the ``part[0]``-th of ``part[1]`` hash parts of them).

        Of two claims at once the later numbered holds what both took: see :meth:`leased`.
        """
        now = time.time() if now is None else now
        token = self._number()
        mine = self.states(now).where(F.col("state") == PENDING).where(F.pmod(F.xxhash64("item"), F.lit(part[1])) == part[0])
        self._write(mine.select("item", "hash"), f"lease-{token}", "lease", token, token, now, now + seconds)
        return Claim(token, now + seconds, f"{self.root}/out/token={token}")

    def leased(self, claim: Claim) -> DataFrame:
        """The items a claim holds: those whose newest claim it is."""
        newest = self.events().where("kind = 'lease'").groupBy("item").agg(F.max(F.struct("token", "hash")).alias("l"))
        return newest.where(F.col("l.token") == claim.token).select("item", F.col("l.hash").alias("hash"))

    def write(self, claim: Claim, result: DataFrame) -> str:
        """Write a claim's output, which names each row's ``item``, to the path its token fixes."""
        result.write.mode("overwrite").parquet(claim.path)
        return claim.path

    def commit(self, claim: Claim, now: float | None = None) -> int:
        """Mark a claim's items done; the number of those that no later claim had taken over."""
        seq = self._number()
        self._write(self.leased(claim), f"done-{claim.token}", "done", claim.token, seq, time.time() if now is None else now)
        return self.states(now).where(F.col("done_token") == claim.token).count()

    def results(self) -> DataFrame | None:
        """What committed claims wrote, once per item; None before the first write."""
        if not self._names("out"):
            return None
        out = self.spark.read.parquet(f"{self.root}/out").withColumn("token", F.col("token").cast("long"))
        counted = fold(self.events(), None).where("done_token IS NOT NULL").select("item", F.col("done_token").alias("token"))
        return out.join(counted, ["item", "token"], "left_semi").drop("token")

    def sweep(self) -> list[int]:
        """Delete outputs that no commit counts for any more and no live lease may still commit; their tokens."""
        folded = self.states()
        kept = {r[0] for r in folded.select(F.explode(F.array("done_token", F.when(F.col("state") == LEASED, F.col("token")))).alias("t")).where("t IS NOT NULL").distinct().collect()}
        gone = sorted(t for t in (int(n[6:]) for n in self._names("out") if n.startswith("token=")) if t not in kept)
        for t in gone:
            self._fs.delete(self._path(f"{self.root}/out/token={t}"), True)
        return gone
