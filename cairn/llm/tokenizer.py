"""Encoding of a corpus by a public byte-level BPE vocabulary.

A text is split by the vocabulary's pattern; each piece is a doubly linked list of byte symbols
whose neighbouring pairs wait in a priority queue by merge rank. The best pair is merged and its
new neighbours are queued; entries whose symbols have changed since are stale and skipped. So a
piece of n bytes takes O(n log n), however long it is. Pieces seen before are remembered.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the rank file is, one base64 token and its rank a line.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value of the vocabulary: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces a worker remembers before it starts anew, and the longest it remembers.
CACHE, LONGEST = 500_000, 64
#: A vocabulary is broadcast; a file beyond this isn't one.
MOST_BYTES = 64 << 20


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # a symbol that begins at i ends at end[i]; 0: merged away
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    queue = []

    def offer(left: int) -> None:
        right = after[left]
        if right < n:
            rank = ranks.get(piece[left : end[right]])
            if rank is not None:
                heapq.heappush(queue, (rank, left, end[right]))

    for i in range(n - 1):
        offer(i)
    while queue:
        _, left, stop = heapq.heappop(queue)
        if not end[left] or after[left] >= n or end[after[left]] != stop:
            continue  # stale
        right = after[left]
        end[left], end[right] = stop, 0
        after[left] = after[right]
        if after[right] < n:
            before[after[right]] = left
        if before[left] >= 0:
            offer(before[left])
        offer(left)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class Encoder(dict):
    """piece -> ids, remembered; ``encode`` and ``decode`` for texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        super().__init__()
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.strings: dict[int, bytes] | None = None

    def __missing__(self, piece: str) -> list[int]:
        ids = merge(piece.encode("utf-8"), self.ranks)
        if len(piece) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return [i for piece in self.split(text) for i in self[piece]] if text else []

    def decode(self, ids) -> str:
        if self.strings is None:
            self.strings = {i: t for t, i in self.ranks.items()}
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_READY: dict = {}


def _encoder(shared, pattern: str) -> Encoder:
    """This worker's encoder of a broadcast vocabulary."""
    if _READY.get("of") is not shared or _READY["pattern"] != pattern:
        _READY.update(of=shared, pattern=pattern, encoder=Encoder(load_ranks(shared.value), pattern))
    return _READY["encoder"]


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is no vocabulary: it has more than {MOST_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(data)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``(doc_id, ids)``: one row per row of ``df``, the token ids of its text.

    A null and an empty text both give the empty list; a null id stays; repeated rows stay
    repeated; strings of special tokens are ordinary text. There is no shuffle, and the
    vocabulary's file, of a fixed size, is the only thing broadcast. Extra columns are dropped.
    """
    shared = _vocabulary(df, path)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared, pattern).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [encode(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                values = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids: str = "ids", path: str = RANKS) -> DataFrame:
    """``(doc_id, text)``: the vocabulary strings of the ids, concatenated. Null ids give null."""
    shared = _vocabulary(df, path)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _encoder(shared, PATTERN).decode
        for batch in batches:
            texts = [None if x is None else decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
