"""Cutting documents into overlapping chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import chunk_id, collapse_whitespace

WINDOW, OVERLAP, LEAST_CUT = 1500, 250, 0.6
_SENTENCE_END = re.compile(r"[.!?](?=[ \t\n\x0b\f\r]+[A-Z]|[ \t\n\x0b\f\r]*\Z)")
_WHITE = re.compile(r"[ \t\n\x0b\f\r]+")
_ENDS = "".join(map(chr, range(33)))


def _finish(rows: DataFrame, extra: list[str] | None = None) -> DataFrame:
    return rows.select(
        "docId", "chunkIndex", "chunkStartIndex", "chunkEndIndex", "chunkText", "sectionPath",
        F.sha2("chunkText", 256).alias("chunkContentHash"),
        chunk_id(F.col("docId"), F.col("chunkIndex"), F.col("chunkStartIndex"), F.col("chunkEndIndex")).alias("chunkId"), *(extra or []),
    )


def chunk_documents(docs: DataFrame, window: int = WINDOW, overlap: int = OVERLAP, total: bool = False) -> DataFrame:
    """Rows of the chunks table by a window that slides over the collapsed text.

    Windows begin every ``window - overlap`` code points (at least one), so the last may lie
    within the one before. Null, empty and blank texts give none. Native expressions only: a
    document's windows are generated beside it, without a shuffle. With ``total`` each row has the
    number of its document's chunks too.
    """
    stride = max(1, window - overlap)
    n = F.length("clean")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(stride)))
    rows = docs.select("docId", F.col("pdfUri").alias("sectionPath"), collapse_whitespace(F.col("text")).alias("clean"))
    rows = rows.select("docId", "sectionPath", "clean", F.size(starts).alias("total"), F.posexplode(starts).alias("chunkIndex", "chunkStartIndex"))
    return _finish(rows.withColumns({"chunkEndIndex": F.least(F.col("chunkStartIndex") + window, n), "chunkText": F.substring("clean", F.col("chunkStartIndex") + 1, F.lit(window))}), ["total"] * total)


def cut_at_sentences(text: str | None, window: int = WINDOW, overlap: int = OVERLAP, least: float = LEAST_CUT) -> list[tuple[int, int, str]]:
    """``(start, end, text)`` pieces that end, if they can, with a sentence.

    A window longer than ``least`` of its size ends after its last sentence end that lies at or
    beyond that share; the next begins ``overlap`` before the cut.
    """
    clean = _WHITE.sub(" ", text or "").strip(_ENDS)
    out, at, floor = [], 0, int(window * least)
    while at < len(clean):
        piece = clean[at : at + window]
        cut = len(piece)
        if len(piece) > least * window:
            cut = max((m.end() for m in _SENTENCE_END.finditer(piece) if m.end() >= floor), default=cut)
        out.append((at, at + cut, piece[:cut]))
        step = cut - overlap if cut < len(piece) else max(1, window - overlap)
        at += max(1, step)
    return out


def chunk_at_sentences(docs: DataFrame, window: int = WINDOW, overlap: int = OVERLAP, least: float = LEAST_CUT) -> DataFrame:
    """Like :func:`chunk_documents`, with cuts at sentence ends. Each cut depends on the one
    before, so this runs in Python, on Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(d, k, a, b, t, u) for d, u, text in zip(*(c.to_pylist() for c in batch.columns)) for k, (a, b, t) in enumerate(cut_at_sentences(text, window, overlap, least))]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["docId", "chunkIndex", "chunkStartIndex", "chunkEndIndex", "chunkText", "sectionPath"])

    src = docs.select(F.col("docId").cast("string"), F.col("pdfUri").cast("string"), "text")
    return _finish(src.mapInArrow(run, "docId string, chunkIndex int, chunkStartIndex int, chunkEndIndex int, chunkText string, sectionPath string"))


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """``(docId, id, text, metadata)`` with 1-based ids and the position among the chunks of the
    document, as a map of strings. Rows of :func:`chunk_documents` with ``total`` need no shuffle;
    others are counted by document first."""
    if "total" not in chunks.columns:
        chunks = chunks.join(chunks.groupBy("docId").agg(F.count(F.lit(1)).alias("total")), "docId")
    at = (F.col("chunkIndex") + 1).cast("string")
    meta = F.create_map(F.lit("chunk_id"), F.concat(F.lit("chunk_"), at), F.lit("position"), at, F.lit("total_chunks"), F.col("total").cast("string"))
    return chunks.select("docId", F.concat(F.lit("chunk_"), at).alias("id"), F.col("chunkText").alias("text"), meta.alias("metadata"))


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Per document: count, shortest, longest and mean length, and all characters."""
    n = F.length("chunkText")
    return chunks.groupBy("docId").agg(F.count(F.lit(1)).alias("count"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.avg(n).alias("avg_length"), F.sum(n).alias("total_characters"))
