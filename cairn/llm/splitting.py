"""Splitting oversized items at natural boundaries.

An item's text, its white space collapsed, starts as a row of atomic segments: words, or slices
of words that are too long themselves. Every boundary between neighbours has a strength: a
sentence end is stronger than a clause end, that than a list mark or a plain blank, that than the
inside of a word. Neighbours wait in a heap, and the weakest boundary is merged first as long as
both together and the overlap stay under the limit. What can't be merged any more are the pieces'
cores; each piece but the first also repeats the end of the text before its core.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters (code points) of a piece at most, and those that it repeats of the one before.
LIMIT, OVERLAP = 1500, 250
#: Strengths of boundaries, the weakest first.
INSIDE, BLANK, CLAUSE, SENTENCE = range(4)
_ATOM = re.compile(r"[^ ]+ ?")
_CLOSING = "\"'”’»)]"
#: Tokens whose full stop ends no sentence.
ABBREVIATIONS = frozenset("dr. mr. mrs. ms. prof. st. vs. etc. e.g. i.e. cf. fig. figs. abb. no. nr. nº. vol. p. pp. s. bzw. z.b. d.h. u.a. ca. al. ed. eds. ex. p.ex. sr. sra. dra. núm. pág. art.".split())


def collapse(text: Column) -> Column:
    """Runs of space, tab, line feed, vertical tab, form feed and carriage return become one space."""
    return F.btrim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "), F.lit(" "))


def strength(left: str, right: str) -> int:
    """The strength of the boundary between two neighbouring atoms."""
    if not left.endswith(" "):
        return INSIDE
    word = left.rstrip().rstrip(_CLOSING)
    if word[-1:] in ("。", "！", "？"):
        return SENTENCE
    if word[-1:] in (".", "!", "?", "…"):
        if word.lower().lstrip("(«\"'“") in ABBREVIATIONS or re.fullmatch(r"(\w\.)+|\d{1,3}\.", word):
            return BLANK
        first = right.lstrip("\"'“‘«(¿¡")[:1]
        return CLAUSE if first.islower() else SENTENCE
    if word[-1:] in (",", ";", ":", "–", "—", "，", "；", "："):
        return CLAUSE
    # a list mark begins a new item
    if re.fullmatch(r"[-*•–—]|\d{1,3}[.)]|\(?[a-z]\)", right.strip()):
        return CLAUSE
    return BLANK


def _atoms(text: str, most: int) -> list[str]:
    out = []
    for m in _ATOM.finditer(text):
        a = m.group()
        if len(a) <= most:
            out.append(a)
            continue
        at = 0
        while at < len(a):  # without a boundary, cut between characters that don't combine
            end = min(at + most, len(a))
            while at + 1 < end < len(a) and _combines(a[end]):
                end -= 1
            out.append(a[at:end])
            at = end
    return out


def _combines(c: str) -> bool:
    return "̀" <= c <= "ͯ" or c in "‍️" or "\U0001f3fb" <= c <= "\U0001f3ff"


def cores(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """The half-open ranges of the pieces' cores, which lie end to end over the whole text."""
    most = limit - overlap
    atoms = _atoms(text, most)
    n = len(atoms)
    if not n:
        return []
    size = [len(a) for a in atoms]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    force = [strength(atoms[i], atoms[i + 1]) for i in range(n - 1)]
    last = list(range(n))  # the last atom of the segment that begins at i
    heap = [(force[i], size[i] + size[i + 1], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, total, i, j = heapq.heappop(heap)
        # stale, if either side has been merged or has grown since
        if not size[i] or after[i] != j or j >= n or size[i] + size[j] != total:
            continue
        room = limit if i == 0 else most  # the first piece repeats nothing
        if total > room:
            continue
        size[i], size[j], last[i] = total, 0, last[j]
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            heapq.heappush(heap, (force[last[i]], size[i] + size[after[i]], i, after[i]))
        if before[i] >= 0:
            b = before[i]
            heapq.heappush(heap, (force[last[b]], size[b] + size[i], b, i))
    out, at, i = [], 0, 0
    while i < n:
        out.append((at, at + size[i]))
        at += size[i]
        i = after[i]
    return out


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """The half-open ranges of the pieces. Neighbours share ``overlap`` characters, or all of the
    piece before if that is shorter."""
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    return [(max(0, a - overlap), b) for a, b in cores(text, limit, overlap)]


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """``(item_id, pieceIndex, startIndex, endIndex, text)`` of the items over the limit.

    Offsets count code points of the item's own text after its white space is collapsed; the
    offsets that items carry are not read, as they may be null or wrong. Items within the limit,
    null and blank ones give no rows; so do rows with a null id; repeated rows count once.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    src = items.select(F.col(id_col).alias("item_id"), collapse(F.col(text).cast("string")).alias("text"))
    src = src.where((F.col("item_id").isNotNull()) & (F.length("text") > limit)).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = [(i, k, a, b, t[a:b]) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for k, (a, b) in enumerate(pieces(t, limit, overlap))]
                types = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["item_id", "pieceIndex", "startIndex", "endIndex", "text"])

    return src.mapInArrow(run, f"item_id {src.schema['item_id'].dataType.simpleString()}, pieceIndex int, startIndex int, endIndex int, text string")
