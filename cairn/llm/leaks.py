"""Evaluation texts that leak into training text.

Every item is cut into windows of words. A random walk over a window (at each step the current
word is written out and a hash of the step and the word decides whether the walk advances) embeds
edit distance into Hamming distance: windows that differ by few edits agree in most steps. Some
steps, sampled at random, make a key; windows of the corpus with an item window's key are its
candidates, and repetitions with other walks and samples raise the recall to the target. Candidates
are verified by their edit distance, of which equal windows are the case of none.

Walks are only made over windows that may match: an edit takes away at most q of the runs of q words
in a window, so one without enough of the items' runs is within no edits of any item. These runs are
looked up in a filter of fixed size, which loses nothing.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.words import WordHashes, bit_filter, mix, words

#: Steps sampled into a key.
BITS = 12
#: Pairs of windows that the number of repetitions is measured on, and repetitions at most.
TRIALS, MOST_REPETITIONS = 2000, 64
#: Item words up to which the items go to every worker (about 300 bytes each there, as measured);
#: beyond, keys are joined by a shuffle.
BROADCAST_WORDS = 400_000
#: Windows embedded at once, and characters of corpus texts laid end to end.
BLOCK, PIECE = 100_000, 500_000
#: Pairs of a text's and an item's window compared at once.
CANDIDATES = 50_000
#: Bits of the filter of runs of words.
FILTER_BITS = 1 << 24
#: Parts into which the windows of one content are spread where they meet the items again.
SALTS = 16

_KNOWN = WordHashes()
#: No word: stands after a text's last one.
_PAD = "\0"


@functools.cache
def repetitions(window: int, edits: int, bits: int = BITS, recall: float = 0.98) -> int:
    """How often to draw a walk and a sample so that ``edits`` edits are found with ``recall``.

    Measured on random windows with random edits, with the very draws that will be used: walks
    that part at an edit meet again after a time with a heavy tail, which a formula misses. Equal
    windows walk alike, so without edits the measure says one.
    """
    rng = np.random.default_rng(5)
    plain, edited = [], []
    for _ in range(TRIALS):
        own = rng.integers(1, 1 << 62, window, dtype=np.uint64).tolist()
        other = list(own)
        for _ in range(edits):
            at, kind, new = int(rng.integers(len(other))), int(rng.integers(3)), int(rng.integers(1, 1 << 62))
            other[at : at + 1] = ([new], [], [other[at], new])[kind]
        plain += own
        edited += (other + rng.integers(1, 1 << 62, window, dtype=np.uint64).tolist())[:window]
    x, y, starts = np.array(plain, np.uint64), np.array(edited, np.uint64), np.arange(TRIALS) * window
    missed = np.ones(TRIALS, bool)
    for n, (steps, sampled) in enumerate(_plan(window, bits, MOST_REPETITIONS), 1):
        missed &= window_keys(x, starts, window, steps, sampled) != window_keys(y, starts, window, steps, sampled)
        if missed.mean() <= 1 - recall:
            return n
    raise ValueError(f"{edits} edits in {window} words aren't found with {recall:.0%} by {MOST_REPETITIONS} repetitions; take fewer bits")


@functools.cache
def _plan(window: int, bits: int, reps: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    rng = np.random.default_rng(90125)
    return tuple((rng.integers(0, 1 << 63, 3 * window, dtype=np.uint64), np.sort(rng.choice(3 * window, min(bits, 3 * window), replace=False))) for _ in range(reps))


def window_keys(h: np.ndarray, starts: np.ndarray, window: int, steps: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """The keys, for one repetition, of the windows of ``window`` words of ``h`` at ``starts``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    wanted = set(sampled.tolist())
    at, last, key = starts.copy(), starts + (window - 1), np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        # one pseudo-random bit of the step and the word: does the walk advance?
        for j in range(int(sampled[-1]) + 1):
            symbol = h[np.minimum(at, last)]
            if j >= window:
                symbol[at > last] = 0  # past the end the walk writes a pad
            if j in wanted:
                key ^= symbol
                key *= np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            symbol ^= steps[j]
            symbol *= np.uint64(0xD6E8FEB86659FD93)
            symbol >>= np.uint64(63)
            at += symbol.view(np.int64)
    return mix(key)


def _starts(lengths: list[int], window: int) -> np.ndarray:
    """Where windows begin in texts laid end to end; none spans two texts."""
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if lengths else np.zeros(0)
    parts = [np.arange(f, f + n - window + 1) for f, n in zip(first.astype(np.int64), lengths) if n >= window]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def edit_distances(own: np.ndarray, theirs: np.ndarray, most: int) -> np.ndarray:
    """Of each row the edits between ``own`` and the beginning of ``theirs`` that is nearest to it,
    or ``most`` + 1; only the band that ``most`` edits can reach is computed."""
    rows, window = own.shape
    prev = {j: np.full(rows, j, np.int8) for j in range(min(most, theirs.shape[1]) + 1)}
    for i in range(1, window + 1):
        row: dict[int, np.ndarray] = {}
        for j in range(max(0, i - most), min(theirs.shape[1], i + most) + 1):
            ways = [prev[j] + 1] if j in prev else []
            if j - 1 in prev:
                ways.append(prev[j - 1] + (own[:, i - 1] != theirs[:, j - 1]))
            if j - 1 in row:
                ways.append(row[j - 1] + 1)
            row[j] = functools.reduce(np.minimum, ways).astype(np.int8) if ways else np.full(rows, i, np.int8)
        prev = row
    return np.minimum(functools.reduce(np.minimum, prev.values()), most + 1)


def _run(window: int, edits: int) -> tuple[int, int]:
    """``(q, least)``: a window within the edits shares at least ``least`` runs of q words."""
    q = window // (2 * edits + 2) + 1
    return q, window - q + 1 - q * edits


def _runs(h: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q words that follow one another, along the last axis."""
    n = h.shape[-1] - q + 1
    out = np.zeros((*h.shape[:-1], max(0, n)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(q if n > 0 else 0):
            out += h[..., k : k + n]
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


class _Corpus:
    """Texts laid end to end, and their windows that may be within the edits of an item's."""

    def __init__(self, texts: list[str | None], window: int, edits: int, first: np.ndarray):
        # room for windows that lost words at a text's end
        found = [x + [_PAD] * edits if (x := words(t)) else x for t in texts]
        lengths = [len(x) for x in found]
        flat = [w for x in found for w in x]
        self.h = np.fromiter(map(_KNOWN.__getitem__, [*flat, *[_PAD] * (2 * edits + 1)]), np.uint64, len(flat) + 2 * edits + 1)
        self.ends, self.span = np.cumsum(lengths), np.arange(window + edits)
        self.begins = self.ends - lengths
        starts = _starts(lengths, window)
        q, least = _run(window, edits)
        known = np.concatenate([[0], np.cumsum(first[_runs(self.h, q) & np.uint64(len(first) - 1)])])
        self.starts = starts[known[np.minimum(starts + window + edits - q + 1, len(known) - 1)] - known[starts] >= least]

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")

    def spans(self, at: np.ndarray) -> np.ndarray:
        """The words from each place on, 0 beyond its text's end."""
        place = at[:, None] + self.span
        out = self.h[np.minimum(place, len(self.h) - 1)]
        out[place >= self.ends[self.text_of(at)][:, None]] = 0
        return out


class _Items:
    """Windows of the items, by key, for each repetition."""

    def __init__(self, rows: list[tuple], window: int, edits: int, bits: int, reps: int):
        self.window, self.edits = window, edits
        self.plan = _plan(window, bits, reps)
        self.ids = [i for i, _ in rows]
        known = WordHashes()
        found = [words(t) for _, t in rows]
        self.h = np.fromiter((known[w] for x in found for w in x), np.uint64, sum(map(len, found)))
        lengths = [len(x) for x in found]
        self.starts = _starts(lengths, window)
        self.item = np.repeat(np.arange(len(rows), dtype=np.int32), [max(0, n - window + 1) for n in lengths])
        self.slots = 1 << min(24, max(12, len(self.h).bit_length() + 6))
        self.runs = np.zeros(self.slots, bool)
        self.runs[_runs(self.h, _run(window, edits)[0]) & np.uint64(self.slots - 1)] = True
        self.by_key = []
        for steps, sampled in self.plan:
            keys = window_keys(self.h, self.starts, window, steps, sampled)
            order = np.argsort(keys, kind="stable").astype(np.int32)
            self.by_key.append((keys[order], order))

    def _candidates(self, keys: np.ndarray, rep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions in ``keys`` and the item windows with that key, some at a time."""
        ordered, order = self.by_key[rep]
        low = np.searchsorted(ordered, keys, side="left")
        count = np.searchsorted(ordered, keys, side="right") - low
        at = np.flatnonzero(count)
        low, count = low[at], count[at]
        ends = np.cumsum(count)
        begin = 0
        while begin < len(at):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CANDIDATES, side="right")))
            c = count[begin:stop]
            offset = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            yield np.repeat(at[begin:stop], c), order[np.repeat(low[begin:stop], c) + offset]
            begin = stop

    def leaked(self, texts: list[str | None]) -> list[tuple]:
        """``(text's index, item_id, windows, edits)`` of the items with a window within the edits."""
        corpus = _Corpus(texts, self.window, self.edits, self.runs)
        hits: list[np.ndarray] = []  # rows of place, item, edits
        pending: list[np.ndarray] = []

        def verify(part: np.ndarray) -> None:
            """Every pair once, in however many repetitions it came up."""
            pairs = np.unique(np.concatenate(pending)) if pending else np.zeros(0, np.int64)
            pending.clear()
            for b in range(0, len(pairs), CANDIDATES):
                i, n = np.divmod(pairs[b : b + CANDIDATES], len(self.starts))
                d = edit_distances(self.h[self.starts[n][:, None] + np.arange(self.window)], corpus.spans(part[i]), self.edits)
                good = d <= self.edits
                hits.append(np.stack([part[i[good]], self.item[n[good]], d[good]]).astype(np.int64))

        for a in range(0, len(corpus.starts), BLOCK):
            part, size = corpus.starts[a : a + BLOCK], 0
            for rep, (steps, sampled) in enumerate(self.plan):
                for i, n in self._candidates(window_keys(corpus.h, part, self.window, steps, sampled), rep):
                    pending.append(i * np.int64(len(self.starts)) + n)
                    size += len(i)
                    if size >= 20 * CANDIDATES:
                        verify(part)
                        size = 0
            verify(part)
        found = np.concatenate(hits, axis=1) if hits else np.zeros((3, 0), np.int64)
        if not found.shape[1]:
            return []
        near = pd.DataFrame({"place": found[0], "item": found[1], "edits": found[2]}).groupby(["place", "item"], sort=False)["edits"].min().reset_index()
        near["t"] = corpus.text_of(near["place"].to_numpy())
        out = near.groupby(["t", "item"], sort=False)["edits"].agg(["size", "min"])
        return [(t, self.ids[x], n, k) for (t, x), n, k in zip(out.index.tolist(), out["size"].tolist(), out["min"].tolist())]


_READY: dict = {}


def leaks(documents: DataFrame, items: DataFrame, window: int = 12, edits: int = 0, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", bits: int = BITS, recall: float = 0.98, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``(doc_id, item_id, windows, edits)``: documents that hold passages of items.

    A passage is a window of ``window`` consecutive words of the item that some run of words of
    the document equals up to ``edits`` word edits; ``windows`` counts where they begin, and the
    column ``edits`` has the fewest that one of them needs. Words are runs of letters and digits of
    the lower-cased text, whatever stands between them, and are compared by 64-bit hashes. Null and
    shorter texts have no windows; rows with a null id are left out; repeated rows count once. Items
    go to every worker if their words are at most ``broadcast_words`` (counted first); otherwise the
    keys of both sides are joined.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    tests = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    reps = repetitions(window, edits, bits, recall)
    # A word takes at least two characters with what follows it.
    if (tests.agg(F.sum(F.length("text"))).first()[0] or 0) <= 2 * broadcast_words:
        found = _beside(docs, tests, window, edits, bits, reps)
    else:
        found = _joined(docs, tests, window, edits, bits, reps)
    return found.groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"), F.min("edits").alias("edits"))


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _beside(docs: DataFrame, tests: DataFrame, window: int, edits: int, bits: int, reps: int) -> DataFrame:
    """Every worker holds the items; the corpus is read once and not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in tests.collect()])
    item_type = _arrow(tests, "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _READY.get("of") is not shared:
            _READY.update(of=shared, items=_Items(shared.value, window, edits, bits, reps))
        ready = _READY["items"]
        for batch, ids, texts in _pieces(batches):
            out = [(ids[t], *rest) for t, *rest in ready.leaked(texts)]
            types = (batch.schema.field(0).type, item_type, pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["doc_id", "item_id", "windows", "edits"])

    return docs.mapInArrow(run, f"doc_id {_kind(docs, 'doc_id')}, item_id {_kind(tests, 'item_id')}, windows long, edits int")


def _joined(docs: DataFrame, tests: DataFrame, window: int, edits: int, bits: int, reps: int) -> DataFrame:
    """Keys of both sides are joined: of the corpus only those of windows that may match, each
    content once, however many documents hold it; what matched is then put back to the documents."""
    from cairn.session import work_table

    own = work_table(_item_windows(tests, window), "item_windows")
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(own.select("own"), lambda column: _own_runs(column, window, edits), FILTER_BITS))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.unpackbits(np.frombuffer(shared.value, np.uint8)).view(bool)
        for batch, ids, texts in _pieces(batches):
            corpus = _Corpus(texts, window, edits, first)
            for a in range(0, len(corpus.starts), BLOCK):
                at = corpus.starts[a : a + BLOCK]
                owner = corpus.text_of(at)
                place, owner = at - corpus.begins[owner], owner.tolist()
                spans = [x.tobytes() for x in corpus.spans(at)]
                columns = (pa.array([ids[t] for t in owner], batch.schema.field(0).type), pa.array([xxhash.xxh3_64_intdigest((texts[t] or "").encode("utf-8", "surrogatepass")) - (1 << 63) for t in owner], pa.int64()), pa.array(place), pa.array([xxhash.xxh3_128_digest(x) for x in spans], pa.binary()), pa.array(spans, pa.binary()))
                yield pa.RecordBatch.from_arrays(list(columns), ["doc_id", "version", "place", "content", "span"])

    windows = work_table(docs.mapInArrow(look, f"doc_id {_kind(docs, 'doc_id')}, version long, place long, content binary, span binary"), "windows")
    contents = windows.groupBy("content").agg(F.first("span").alias("span"))
    theirs = _keyed(contents, "span", "content", window, bits, reps)
    ours = _keyed(own, "own", "item_id", window, bits, reps)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, n) for k, n in ((2, window), (3, window + edits)))
            d = edit_distances(a, b, edits) if len(a) else np.zeros(0, np.int8)
            good = pa.array(d <= edits)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good), pa.array(d[d <= edits].astype(np.int32))], ["content", "item_id", "edits"])

    pairs = theirs.join(ours, ["rep", "key"]).select("content", "item_id", "own", "span")
    verified = pairs.mapInArrow(check, f"content binary, item_id {_kind(tests, 'item_id')}, edits int").groupBy("content", "item_id").agg(F.min("edits").alias("edits"))
    # a passage that very many documents hold is one content: its windows are spread, its items repeated
    spread = verified.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = windows.select("doc_id", "version", "place", "content", F.pmod(F.xxhash64("doc_id", "place"), F.lit(SALTS)).cast("int").alias("salt"))
    hits = placed.join(spread, ["content", "salt"]).groupBy("doc_id", "version", "item_id", "place").agg(F.min("edits").alias("edits"))
    return hits.groupBy("doc_id", "version", "item_id").agg(F.count(F.lit(1)).alias("windows"), F.min("edits").alias("edits")).drop("version")


def _own_runs(column: pa.Array, window: int, edits: int) -> np.ndarray:
    own = np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, window)
    return np.unique(_runs(own, _run(window, edits)[0]))


def _item_windows(tests: DataFrame, window: int) -> DataFrame:
    """``(item_id, own)``: the word hashes of every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = np.fromiter(map(_KNOWN.__getitem__, found := words(t)), np.uint64, len(found))
                for a in range(0, len(h) - window + 1, BLOCK):
                    own = [h[p : p + window].tobytes() for p in range(a, min(a + BLOCK, len(h) - window + 1))]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(own), batch.schema.field(0).type), pa.array(own, pa.binary())], ["item_id", "own"])

    return tests.select("item_id", "text").mapInArrow(run, f"item_id {_kind(tests, 'item_id')}, own binary").distinct()


def _keyed(rows: DataFrame, hashes: str, id_col: str, window: int, bits: int, reps: int) -> DataFrame:
    """``(id, hashes, rep, key)`` of every window, given by its words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64)
            starts = np.arange(batch.num_rows) * (len(h) // batch.num_rows)
            for rep, (steps, sampled) in enumerate(_plan(window, bits, reps)):
                keys = window_keys(h, starts, window, steps, sampled).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(keys), rep, np.int32)), pa.array(keys)], [id_col, hashes, "rep", "key"])

    return rows.select(id_col, hashes).mapInArrow(run, f"{id_col} {_kind(rows, id_col)}, {hashes} binary, rep int, key long")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list, list]]:
    """Batches in pieces of about PIECE characters, so that many short texts share the array work."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = size = 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= PIECE or i == len(texts) - 1:
                yield batch, ids[at : i + 1], texts[at : i + 1]
                at, size = i + 1, 0


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[df.schema[column].dataType.simpleString()]
