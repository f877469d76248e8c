"""Words of a text and stable 64-bit hashes of them, for whole Arrow batches at a time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: Runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Words a worker remembers the hash of before it starts anew.
CACHE = 1_000_000


class WordHashes(dict):
    """word -> its XXH64, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def hashes(text: str | None, known: WordHashes) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int, known: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of all runs of ``size`` consecutive words."""
    h = hashes(text, known)
    n = len(h) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(size):
            out = mix(out + h[i : i + n] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(out)


def bit_filter(rows: DataFrame, hashes_of: Callable[[pa.Array], np.ndarray], bits: int, segments: int = 64) -> bytes:
    """``bits`` packed bits (a power of two), of which those are set that hashes of the first column name.

    Every task makes a filter of its own; they are united segment by segment, so that the driver
    gets ``bits`` / 8 bytes, however many rows there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            if batch.num_rows:
                own[hashes_of(batch.column(0)) & np.uint64(bits - 1)] = True
        parts = np.packbits(own).reshape(segments, -1)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([parts[k].tobytes() for k in used], pa.binary())], ["segment", "part"])

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(bits // 8 // segments, np.uint8)
        for x in pdf["part"]:
            out |= np.frombuffer(x, np.uint8)
        return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "part": [out.tobytes()]})

    whole = np.zeros((segments, bits // 8 // segments), np.uint8)
    for r in rows.mapInArrow(run, "segment int, part binary").groupBy("segment").applyInPandas(unite, "segment int, part binary").collect():
        whole[r.segment] = np.frombuffer(r.part, np.uint8)
    return whole.tobytes()
