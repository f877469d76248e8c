"""The incremental index: scan, detect changes, chunk, embed, upsert, publish, record."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import schemas
from cairn.functions.text import normalize
from cairn.operators.chunking import chunk_at_sentences, chunk_documents
from cairn.operators.delta import changed_documents, chunks_to_embed, stale_chunks
from cairn.operators.documents import project_documents
from cairn.operators.embedding import HashEmbedder, embed_chunks
from cairn.operators.metrics import ratio, run_counts
from cairn.operators.snapshot import retrieval_index
from cairn.sources.files import extract_texts, scan_files
from cairn.sources.storage import TableStore, register_table


@dataclass(frozen=True)
class Options:
    """How a run departs from the plain one.

    ``prune``: chunks and vectors that a changed document no longer has are removed.
    ``embed_all``: chunks of unchanged documents get vectors too, as after a change of model.
    ``skip_failed``: a failed extraction doesn't replace a document's text.
    ``one_model``, ``match_hash``: what the published index holds.
    ``database``: the index becomes a catalog table of it too. ``keep``: versions kept for readers.
    """

    window: int = 1500
    overlap: int = 250
    at_sentences: bool = False
    prune: bool = False
    embed_all: bool = False
    skip_failed: bool = False
    one_model: bool = False
    match_hash: bool = False
    batch: int = 2
    parallelism: int | None = None
    database: str | None = None
    keep: int = 3


def documents_of_folder(spark: SparkSession, folder: str, pattern: str = "*.pdf", partitions: int | None = None) -> DataFrame:
    """Rows of the documents table and ``length``, from a folder of files."""
    files = extract_texts(scan_files(spark, folder, pattern), partitions)
    # one pass: extraction is the dear step
    return project_documents(files, F.col("path"), normalize(F.col("text")), F.col("debug"), extra=["length"])


def run_once(store: TableStore, docs: DataFrame, model: str, version: str, embedder: Any = None, options: Options = Options(), reindex: bool = False, snapshots: str | None = None, run_id: str | None = None, now_ms: int | None = None) -> dict[str, Any]:
    """One run over ``docs`` (rows of the documents table, perhaps with ``length``); its metrics.

    All tables of the run and its snapshot become visible together, or none; with ``reindex`` they
    replace all that the store had, whose folders are deleted. Of the three tables only the buckets
    with changed rows are written. ``embedder`` None stands for the deterministic one. A run without
    changes still publishes an index and a metrics row.
    """
    started = time.time()
    tx = store.begin(fresh=reindex)
    length = F.col("length") if "length" in docs.columns else F.octet_length("text")
    # Staging is written, so that neither extraction nor embedding can run twice.
    scanned = tx.overwrite("staging_scan", docs.select(*schemas.DOCS.fieldNames(), length.cast("long").alias("length")))
    t_read = time.time()
    stored = tx.now("delta_pdf_docs")
    eligible = scanned.where("debugInfo IS NULL OR debugInfo NOT LIKE 'Error%'") if options.skip_failed else scanned
    changed = tx.overwrite("staging_pdf_docs", changed_documents(eligible.drop("length"), stored))
    t_delta = time.time()
    cut = chunk_at_sentences if options.at_sentences else chunk_documents
    chunks = tx.overwrite("staging_pdf_chunks", cut(changed, options.window, options.overlap))
    t_chunk = time.time()
    old_chunks, old_vectors = tx.now("delta_pdf_chunks"), tx.now("delta_embeddings")
    scope = chunks
    if options.embed_all and old_chunks is not None:
        scope = old_chunks.join(chunks.select("chunkId"), "chunkId", "left_anti").select(chunks.columns).unionByName(chunks)
    vectors = tx.overwrite("staging_embeddings", embed_chunks(chunks_to_embed(scope, old_vectors, model, version), embedder or HashEmbedder(), model, version, options.batch, options.parallelism))
    t_embed = time.time()
    fresh_docs = changed if stored is not None else eligible.drop("length")
    docs_table = tx.merge("delta_pdf_docs", fresh_docs, schemas.KEYS["docs"])
    if options.prune and old_chunks is not None:
        stale = tx.overwrite("staging_stale", stale_chunks(old_chunks, changed, chunks).select("chunkId", "docId"))
        tx.delete("delta_pdf_chunks", stale, schemas.KEYS["chunks"], by="docId")
        if old_vectors is not None:
            tx.delete("delta_embeddings", stale, ["chunkId"])
    chunk_table = tx.merge("delta_pdf_chunks", chunks, schemas.KEYS["chunks"], by="docId")
    vector_table = tx.merge("delta_embeddings", vectors, schemas.KEYS["embeddings"])
    now = int(started * 1000) if now_ms is None else now_ms
    t_upsert = time.time()
    index = retrieval_index(chunk_table, docs_table, vector_table, F.timestamp_millis(F.lit(now)), model if options.one_model else None, version if options.one_model else None, options.match_hash)
    path = f"{(snapshots or store.root + '/_snapshots').rstrip('/')}/{model}/{version}/{now}"
    tx.publish_at(f"retrieval_index_{now}", index, path)
    t_publish = time.time()
    counts = run_counts(scanned, changed, chunks, vectors).first().asDict()
    total = t_publish - started
    ms = lambda a, b: int((b - a) * 1000)
    row = counts | {
        "run_id": run_id or str(uuid.uuid4()), "run_ts": now, "t_read_ms": ms(started, t_read), "t_delta_ms": ms(t_read, t_delta), "t_chunk_ms": ms(t_delta, t_chunk),
        "t_embed_ms": ms(t_chunk, t_embed), "t_publish_ms": ms(t_upsert, t_publish), "t_total_ms": ms(started, t_publish),
        "docs_per_sec": ratio(counts["docs_scanned"], total), "embeddings_per_sec": ratio(counts["embeddings_new"], total),
        "snapshot_path": path, "model_version": f"{model}-{version}", "publish_ts": int(t_publish * 1000),
    }
    tx.append("run_metrics", store.spark.createDataFrame([tuple(row[f] for f in schemas.RUN_METRICS.fieldNames())], schemas.RUN_METRICS))
    tx.commit()
    store.vacuum(1 if reindex else options.keep)
    if options.database:
        register_table(store.spark, options.database, f"retrieval_index_{now}", path)
    return row


def show_tables(store: TableStore, rows: int = 5) -> dict[str, tuple[int, list]]:
    """Of every table its count and any few rows; empty if there is no store yet."""
    return {name: (store.read(name).count(), store.read(name).limit(rows).collect()) for name in store.tables()}
