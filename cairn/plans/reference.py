"""Queries for the operators of the document index, over the whole ``documents`` table, and SQL.

A document's URI is ``doc://<doc_id>``. What is stored already is derived from the same rows:
two thirds of the documents, every fifth of all with an older text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import FUNCTION_WORDS, LIGATURES, SCRIPTS, chat_role, model_dimension, normalize
from cairn.operators.chunking import chunk_at_sentences, chunk_documents, chunk_metadata, chunk_statistics
from cairn.operators.delta import changed_documents, chunks_to_embed, prune_stale, stored_hashes, upsert
from cairn.operators.documents import project_documents
from cairn.operators.embedding import HashEmbedder, embed_chunks, hash_embeddings
from cairn.operators.metrics import run_counts, size_of
from cairn.operators.snapshot import retrieval_index
from cairn.plans.pipeline import Options, run_once
from cairn.session import read, shared_dir, work_table
from cairn.sources.files import extract_texts, scan_files, write_pdf
from cairn.sources.storage import TableStore

MODEL, OTHER, VERSION = "m1", "m2", "v1"
#: When snapshots are made.
AT = 1_700_000_000_000
#: Roles and sizes that the tables don't hold, put to their rows in turn.
ROLES = ("user", "system", "assistant", "tool", "USER", " user", "", None)
SIZES = ("", "-small", "-medium", "-large", "-small-medium", "-SMALL")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def _docs(rows: DataFrame) -> DataFrame:
    return project_documents(rows, F.concat(F.lit("doc://"), F.col("doc_id").cast("string")), F.col("text"))


def _new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(_raw(spark, sf_dir))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw(spark, sf_dir).where("doc_id % 3 <> 0")
    return _docs(rows.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" v0"))).otherwise(F.col("text"))))


def _shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents whose text was twice as long where doc_id % 7 = 0."""
    text = F.coalesce("text", F.lit(""))
    return _docs(_raw(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(text, F.lit(" "), text)).otherwise(F.col("text"))))


def _vectors(chunks: DataFrame) -> DataFrame:
    even = chunks.where("chunkIndex % 2 = 0")
    return hash_embeddings(chunks, MODEL, VERSION).unionByName(hash_embeddings(even, OTHER, VERSION))


def doc_projection(spark, sf_dir):
    return _new(spark, sf_dir).select("pdfUri", "title", "docId", "contentHash", F.length("text").alias("n"))


def text_normalize(spark, sf_dir):
    """With every kind of character that is treated put into each text."""
    noise = "­-\n  x   " + "".join(LIGATURES) + "\t\r\u0001\u0085\u007f\U0001f600 \t y-\nz\n\n "
    text = F.concat(F.substring("text", 1, 20), F.lit(noise), F.substring(F.col("text"), F.lit(21), F.length("text")))
    return _raw(spark, sf_dir).select("doc_id", normalize(text).alias("text"))


def language_detect(spark, sf_dir):
    return _new(spark, sf_dir).select("docId", "language")


def chunk_fixed(spark, sf_dir):
    return chunk_documents(_new(spark, sf_dir))


def chunk_small_window(spark, sf_dir):
    return chunk_documents(_new(spark, sf_dir), 100, 20)


def chunk_intelligent(spark, sf_dir):
    return chunk_at_sentences(_new(spark, sf_dir))


def chunk_statistics_query(spark, sf_dir):
    return chunk_statistics(chunk_fixed(spark, sf_dir))


def chunk_metadata_query(spark, sf_dir):
    m = F.col("metadata")
    return chunk_metadata(chunk_documents(_new(spark, sf_dir), total=True)).select("docId", "id", m["chunk_id"].alias("chunk_id"), m["position"].alias("position"), m["total_chunks"].alias("total_chunks"), F.length("text").alias("n"))


def doc_delta_anti(spark, sf_dir):
    return changed_documents(_new(spark, sf_dir), _stored(spark, sf_dir)).select("docId", "contentHash")


def existing_distinct(spark, sf_dir):
    return stored_hashes(read(spark, sf_dir, "delta_pdf_docs"))


def embedding_delta_anti(spark, sf_dir):
    chunks = chunk_documents(_new(spark, sf_dir))
    return chunks_to_embed(chunks, _vectors(chunk_documents(_stored(spark, sf_dir))), MODEL, VERSION).select("chunkId", "chunkContentHash")


def embed_deterministic(spark, sf_dir):
    return hash_embeddings(chunk_fixed(spark, sf_dir), MODEL, VERSION)


def embed_service(spark, sf_dir):
    """Through the batched interface of a service; the deterministic embedder answers."""
    return embed_chunks(chunk_fixed(spark, sf_dir), HashEmbedder(), MODEL, VERSION, batch=16)


def merge_docs(spark, sf_dir):
    stored = _stored(spark, sf_dir)
    return upsert(stored, changed_documents(_new(spark, sf_dir), stored), ["docId"]).select("docId", "contentHash", "title")


def _merged_chunks(spark, sf_dir, stored):
    fresh = chunk_documents(changed_documents(_new(spark, sf_dir), stored))
    return upsert(chunk_documents(stored), fresh, ["chunkId"])


def merge_chunks(spark, sf_dir):
    return _merged_chunks(spark, sf_dir, _stored(spark, sf_dir)).select("chunkId", "docId", "chunkContentHash")


def merge_embeddings(spark, sf_dir):
    stored = _vectors(chunk_documents(_stored(spark, sf_dir)))
    chunks = chunk_documents(changed_documents(_new(spark, sf_dir), _stored(spark, sf_dir)))
    fresh = hash_embeddings(chunks_to_embed(chunks, stored, MODEL, VERSION), MODEL, VERSION)
    return upsert(stored, fresh, ["chunkId", "modelName", "modelVersion"]).select("chunkId", "modelName", "modelVersion", "chunkContentHash")


def snapshot_join(spark, sf_dir):
    docs = _new(spark, sf_dir)
    chunks = chunk_documents(docs)
    index = retrieval_index(chunks, docs, hash_embeddings(chunks, MODEL, VERSION), at=F.timestamp_millis(F.lit(AT)))
    return index.withColumn("version_ts", F.unix_millis("version_ts"))


def snapshot_two_models(spark, sf_dir):
    docs = _new(spark, sf_dir)
    chunks = chunk_documents(docs)
    return retrieval_index(chunks, docs, _vectors(chunks)).groupBy("embedder", "embedder_ver").agg(F.count(F.lit(1)).alias("n"))


def snapshot_one_model(spark, sf_dir):
    docs = _new(spark, sf_dir)
    chunks = chunk_documents(docs)
    old = _vectors(chunk_documents(_stored(spark, sf_dir)))
    return retrieval_index(chunks, docs, old, model=OTHER, version=VERSION, match_hash=True).select("chunkId", "embedder", "contentHash")


def corpus_size(spark, sf_dir):
    return size_of(_raw(spark, sf_dir).select(F.octet_length("text").alias("length")))


def run_metrics_counts(spark, sf_dir):
    docs, stored = _new(spark, sf_dir), _stored(spark, sf_dir)
    changed = changed_documents(docs, stored)
    chunks = chunk_documents(changed)
    fresh = chunks_to_embed(chunks, _vectors(chunk_documents(stored)), MODEL, VERSION)
    return run_counts(docs.withColumn("length", F.octet_length("text")), changed, chunks, fresh)


def stale_chunks_after_edit(spark, sf_dir):
    """Chunks that stay behind when a document shrinks, as an upsert deletes nothing."""
    merged = _merged_chunks(spark, sf_dir, _shrunk(spark, sf_dir))
    return merged.join(chunk_fixed(spark, sf_dir).select("chunkId"), "chunkId", "left_anti").select("chunkId", "docId")


def prune_stale_query(spark, sf_dir):
    stored = _shrunk(spark, sf_dir)
    changed = changed_documents(_new(spark, sf_dir), stored)
    fresh = chunk_documents(changed)
    return upsert(prune_stale(chunk_documents(stored), changed, fresh), fresh, ["chunkId"]).select("chunkId", "docId")


def chat_role_mapping(spark, sf_dir):
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("doc_id") % len(ROLES) + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", chat_role(role).alias("role"))


def model_dim(spark, sf_dir):
    named = read(spark, sf_dir, "delta_embeddings").select("chunkId", F.explode(F.transform(F.array(*map(F.lit, SIZES)), lambda x: F.concat("modelName", x))).alias("modelName"))
    return named.select("chunkId", "modelName", model_dimension(F.col("modelName")).alias("dim"))


def _pages(text: str) -> list[str]:
    """Long texts take two pages."""
    return [text] if len(text) < 200 else [text[: len(text) // 2], text[len(text) // 2 :]]


def extract_struct(spark, sf_dir):
    """Each text made a PDF, with its lines and accents and on up to two pages, and read back."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [write_pdf(_pages(t), compress=len(t) > 500) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(content, pa.binary())], ["path", "length", "content"])

    texts = _raw(spark, sf_dir).select(F.concat(F.lit("doc://"), "doc_id").alias("path"), F.length("text").cast("long").alias("length"), F.coalesce("text", F.lit("")).alias("text"))
    return extract_texts(texts.mapInArrow(make, "path string, length long, content binary")).select("path", "text", "debug")


def file_scan(spark, sf_dir):
    """The test tables' own files as binary files: names, lengths and a digest of what they hold."""
    return scan_files(spark, sf_dir, "*.parquet").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.sha2("content", 256).alias("digest"))


def pipeline_two_runs(spark, sf_dir):
    """A first run over the stored documents, a second over the present ones; the index's documents."""
    store = TableStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", buckets=8)
    run_once(store, _stored(spark, sf_dir), MODEL, VERSION, options=_BATCHED, now_ms=1_700_000_000_000)
    run_once(store, _new(spark, sf_dir), MODEL, VERSION, options=_BATCHED, now_ms=1_700_000_100_000)
    index = store.read("retrieval_index_1700000100000")
    out = work_table(index.groupBy("docId", "title", "embedder").agg(F.count(F.lit(1)).alias("n"), F.min("contentHash").alias("first_hash")), "two_runs")
    store.drop_all()
    return out


_BATCHED = Options(batch=64)

#: What a page of :func:`write_pdf` can show.
_CP1252 = r"\x{00}-\x{7F}\x{A0}-\x{FF}" + "".join(rf"\x{{{ord(c):X}}}" for c in "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ")
_WS = r"[ \t\n\x0B\f\r]"
_NEW = "SELECT doc_id, 'doc://' || doc_id AS pdfUri, coalesce(text, '') AS text FROM documents"
_STORED = "SELECT doc_id, 'doc://' || doc_id AS pdfUri, CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') || ' v0' ELSE coalesce(text, '') END AS text FROM documents WHERE doc_id % 3 <> 0"
_SHRUNK = "SELECT doc_id, 'doc://' || doc_id AS pdfUri, CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || ' ' || coalesce(text, '') ELSE coalesce(text, '') END AS text FROM documents"


def _d(source: str) -> str:
    return f"SELECT *, sha256(pdfUri) AS \"docId\", sha256(text) AS \"contentHash\", trim(split_part(text, chr(10), 1), ' ') AS title FROM ({source})"


def _c(docs: str, window: int = 1500, overlap: int = 250) -> str:
    """Chunks of a relation of documents."""
    stride = max(1, window - overlap)
    return f"""
    SELECT "docId", "chunkIndex", "chunkStartIndex", "chunkEndIndex", "chunkText", pdfUri AS "sectionPath", sha256("chunkText") AS "chunkContentHash",
           sha256("docId" || ':' || "chunkIndex" || ':' || "chunkStartIndex" || ':' || "chunkEndIndex") AS "chunkId", title
    FROM (SELECT *, CAST(st // {stride} AS INTEGER) AS "chunkIndex", CAST(st AS INTEGER) AS "chunkStartIndex", CAST(least(st + {window}, length(clean)) AS INTEGER) AS "chunkEndIndex", substring(clean, st + 1, {window}) AS "chunkText"
          FROM (SELECT *, unnest(range(0, length(clean), {stride})) AS st
                FROM (SELECT *, regexp_replace(regexp_replace(text, '{_WS}+', ' ', 'g'), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS clean FROM ({docs}))))"""


_COLS = '"docId", "chunkIndex", "chunkStartIndex", "chunkEndIndex", "chunkText", "sectionPath", "chunkContentHash", "chunkId"'
_WITH = f"WITH n AS ({_d(_NEW)}), s AS ({_d(_STORED)}), ch AS (SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.\"docId\" = n.\"docId\" AND s.\"contentHash\" = n.\"contentHash\")), nc AS ({_c('SELECT * FROM n')}), sc AS ({_c('SELECT * FROM s')}), cc AS ({_c('SELECT * FROM ch')})"
_HELD = f"sv AS (SELECT \"chunkId\", \"chunkContentHash\", '{MODEL}' AS \"modelName\", '{VERSION}' AS \"modelVersion\" FROM sc UNION ALL SELECT \"chunkId\", \"chunkContentHash\", '{OTHER}', '{VERSION}' FROM sc WHERE \"chunkIndex\" % 2 = 0)"
_OPEN = f'NOT EXISTS (SELECT 1 FROM sv WHERE sv."chunkId" = c."chunkId" AND sv."chunkContentHash" = c."chunkContentHash" AND sv."modelName" = \'{MODEL}\' AND sv."modelVersion" = \'{VERSION}\')'
_SHRUNK_WITH = f"WITH n AS ({_d(_NEW)}), s AS ({_d(_SHRUNK)}), ch AS (SELECT n.* FROM n JOIN s USING (\"docId\") WHERE s.\"contentHash\" <> n.\"contentHash\"), nc AS ({_c('SELECT * FROM n')}), sc AS ({_c('SELECT * FROM s')}), cc AS ({_c('SELECT * FROM ch')})"


def _sentence_chunks(docs: str, window: int = 1500, overlap: int = 250, least: int = 900) -> str:
    """Chunks that end with a sentence, one after the other."""
    ends = f"[p FOR p IN range({least}, length(piece) + 1) IF piece[p:p] IN ('.', '!', '?') AND (piece[p + 1:] IN ('', ' ') OR piece[p + 1:p + 1] = ' ' AND piece[p + 2:p + 2] BETWEEN 'A' AND 'Z')]"
    cut = f"CASE WHEN length(piece) > {least} THEN coalesce(list_max({ends}), length(piece)) ELSE length(piece) END"
    return f"""
    WITH RECURSIVE d AS (SELECT "docId", pdfUri, regexp_replace(regexp_replace(text, '{_WS}+', ' ', 'g'), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS clean FROM ({docs})),
    r AS (
      SELECT "docId", pdfUri, clean, 0 AS k, 0 AS st, piece, {cut} AS n FROM (SELECT *, substring(clean, 1, {window}) AS piece FROM d WHERE length(clean) > 0)
      UNION ALL
      SELECT "docId", pdfUri, clean, k + 1, st, piece, {cut} FROM (
        SELECT "docId", pdfUri, clean, k, nx AS st, substring(clean, nx + 1, {window}) AS piece
        FROM (SELECT *, CAST(st + greatest(1, CASE WHEN n < length(piece) THEN n - {overlap} ELSE greatest(1, {window - overlap}) END) AS INTEGER) AS nx FROM r) WHERE nx < length(clean)))
    SELECT "docId", CAST(k AS INTEGER) AS "chunkIndex", CAST(st AS INTEGER) AS "chunkStartIndex", CAST(st + n AS INTEGER) AS "chunkEndIndex", piece[1:n] AS "chunkText", pdfUri AS "sectionPath",
           sha256(piece[1:n]) AS "chunkContentHash", sha256("docId" || ':' || k || ':' || st || ':' || (st + n)) AS "chunkId" FROM r"""


def _hits(known: str) -> str:
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(known.split()))
    return f"len([x FOR x IN w IF x IN ({words})])"


_LANG = "".join(f"{_hits(known)} AS {code}, " for code, known in FUNCTION_WORDS.items())


def _letters(of: str) -> str:
    return f"length(regexp_replace(low, '[^{of}]', '', 'g'))"


def _by_script() -> str:
    kana, han = r"\p{Hiragana}\p{Katakana}", r"\p{Han}"
    out = [f"WHEN 2 * {_letters(kana + han)} > letters AND {_letters(kana)} > 0 THEN 'ja'"]
    for script, codes in SCRIPTS.items():
        own = " ".join(f"WHEN {_letters(x)} > 0 THEN '{c}'" if x else f"ELSE '{c.strip()}'" for c, x in codes.items())
        out.append(f"WHEN 2 * {_letters(chr(92) + 'p{' + script + '}')} > letters THEN " + (f"CASE {own} END" if len(codes) > 1 else own.removeprefix("ELSE ")))
    return " ".join(out)


_TOP = " ".join(f"WHEN {code} = top THEN '{code}'" for code in sorted(FUNCTION_WORDS))
_LANGUAGE = f"""
        SELECT "docId", CASE WHEN low = '' THEN 'unknown' {_by_script()} WHEN top <= 0 THEN 'unknown' {_TOP} END AS language
        FROM (SELECT *, greatest({', '.join(FUNCTION_WORDS)}) AS top FROM (SELECT "docId", low, length(regexp_replace(low, '[^\\p{{L}}]', '', 'g')) AS letters, {_LANG} 0 AS zero
              FROM (SELECT *, string_split(regexp_replace(low, '[^\\p{{L}}'']+', ' ', 'g'), ' ') AS w FROM (SELECT *, lower(text[1:1000]) AS low FROM ({_d(_NEW)})))))"""
_VECTOR = "[CAST(('0x' || substring(\"chunkContentHash\", CAST(i * 4 + 1 AS INTEGER), 4))::INTEGER / 65536.0 AS FLOAT) FOR i IN range(0, 16)]"

SQL = {
    "doc_projection": f'SELECT pdfUri AS "pdfUri", title, "docId", "contentHash", CAST(length(text) AS INTEGER) AS n FROM ({_d(_NEW)})',
    "text_normalize": r"""
        SELECT doc_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(replace(
               text[1:20] || chr(173) || '-' || chr(10) || '  x' || chr(160) || chr(8199) || chr(8239) || chr(64256) || chr(64257) || chr(64258) || chr(64259) || chr(64260)
               || chr(9) || chr(13) || chr(1) || chr(133) || chr(127) || chr(128512) || ' ' || chr(9) || ' y-' || chr(10) || 'z' || chr(10) || chr(10) || ' ' || text[21:],
               chr(173), ''), '-[ \t\n\x0B\f\r]*\n[ \t\n\x0B\f\r]*', '', 'g'), '[\x{A0}\x{2007}\x{202F}]', ' ', 'g'),
               chr(64256), 'ff'), chr(64257), 'fi'), chr(64258), 'fl'), chr(64259), 'ffi'), chr(64260), 'ffl'),
               '[^\x{20}-\x{7E}\x{A0}-\x{FFFF}\n]', ' ', 'g'), '[ \t\r]+', ' ', 'g'), ' ' || chr(10)) AS text FROM documents""",
    "language_detect": _LANGUAGE,
    "chunk_fixed": f"SELECT {_COLS} FROM ({_c(_d(_NEW))})",
    "chunk_small_window": f"SELECT {_COLS} FROM ({_c(_d(_NEW), 100, 20)})",
    "chunk_intelligent": _sentence_chunks(_d(_NEW)),
    "chunk_statistics": f'SELECT "docId", count(*) AS "count", CAST(min(length("chunkText")) AS INTEGER) AS min_length, CAST(max(length("chunkText")) AS INTEGER) AS max_length, avg(length("chunkText")) AS avg_length, CAST(sum(length("chunkText")) AS BIGINT) AS total_characters FROM ({_c(_d(_NEW))}) GROUP BY "docId"',
    "chunk_metadata": f"SELECT \"docId\", 'chunk_' || (\"chunkIndex\" + 1) AS id, 'chunk_' || (\"chunkIndex\" + 1) AS chunk_id, CAST(\"chunkIndex\" + 1 AS VARCHAR) AS position, CAST(count(*) OVER (PARTITION BY \"docId\") AS VARCHAR) AS total_chunks, CAST(length(\"chunkText\") AS INTEGER) AS n FROM ({_c(_d(_NEW))})",
    "doc_delta_anti": f'{_WITH} SELECT "docId", "contentHash" FROM ch',
    "existing_distinct": 'SELECT DISTINCT "docId", "contentHash" FROM delta_pdf_docs',
    "embedding_delta_anti": f'{_WITH}, {_HELD} SELECT "chunkId", "chunkContentHash" FROM nc c WHERE {_OPEN}',
    "embed_deterministic": f"SELECT \"chunkId\", \"chunkContentHash\", '{MODEL}' AS \"modelName\", '{VERSION}' AS \"modelVersion\", [CAST(('0x' || substring(\"chunkContentHash\", CAST(i * 4 + 1 AS INTEGER), 4))::INTEGER / 65536.0 AS FLOAT) FOR i IN range(0, 16)] AS embedding FROM ({_c(_d(_NEW))})",
    "merge_docs": f'{_WITH} SELECT "docId", "contentHash", title FROM s WHERE "docId" NOT IN (SELECT "docId" FROM ch) UNION ALL SELECT "docId", "contentHash", title FROM ch',
    "merge_chunks": f'{_WITH} SELECT "chunkId", "docId", "chunkContentHash" FROM sc WHERE "chunkId" NOT IN (SELECT "chunkId" FROM cc) UNION ALL SELECT "chunkId", "docId", "chunkContentHash" FROM cc',
    "merge_embeddings": f'{_WITH}, {_HELD}, f AS (SELECT "chunkId", \'{MODEL}\' AS "modelName", \'{VERSION}\' AS "modelVersion", "chunkContentHash" FROM cc c WHERE {_OPEN}) SELECT "chunkId", "modelName", "modelVersion", "chunkContentHash" FROM sv WHERE NOT EXISTS (SELECT 1 FROM f WHERE f."chunkId" = sv."chunkId" AND f."modelName" = sv."modelName" AND f."modelVersion" = sv."modelVersion") UNION ALL SELECT * FROM f',
    "snapshot_join": f"SELECT \"chunkId\", \"docId\", \"chunkText\", \"sectionPath\", title, '{MODEL}' AS embedder, '{VERSION}' AS embedder_ver, \"chunkContentHash\" AS \"contentHash\", CAST({AT} AS BIGINT) AS version_ts, {_VECTOR} AS embedding, language FROM ({_c(_d(_NEW))}) JOIN ({_LANGUAGE}) USING (\"docId\")",
    "snapshot_two_models": f"SELECT '{MODEL}' AS embedder, '{VERSION}' AS embedder_ver, count(*) AS n FROM ({_c(_d(_NEW))}) UNION ALL SELECT '{OTHER}', '{VERSION}', count(*) FROM ({_c(_d(_NEW))}) WHERE \"chunkIndex\" % 2 = 0",
    "snapshot_one_model": f'{_WITH}, {_HELD} SELECT nc."chunkId", sv."modelName" AS embedder, nc."chunkContentHash" AS "contentHash" FROM nc JOIN sv ON sv."chunkId" = nc."chunkId" AND sv."chunkContentHash" = nc."chunkContentHash" WHERE sv."modelName" = \'{OTHER}\'',
    "corpus_size": "SELECT count(*) AS docs, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes FROM documents",
    "run_metrics_counts": f"""{_WITH}, {_HELD},
        k AS (SELECT (SELECT count(*) FROM n) AS docs_scanned, (SELECT CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) FROM n) AS bytes_scanned, (SELECT count(*) FROM ch) AS docs_new_or_changed,
                     (SELECT count(*) FROM cc) AS chunks_new_or_changed, (SELECT count(*) FROM cc c WHERE {_OPEN}) AS embeddings_new)
        SELECT *, chunks_new_or_changed - embeddings_new AS embeddings_reused,
               CASE WHEN docs_scanned > 0 THEN CAST(docs_scanned - docs_new_or_changed AS DOUBLE) / docs_scanned ELSE 0.0 END AS docs_skipped_ratio,
               CASE WHEN chunks_new_or_changed > 0 THEN CAST(chunks_new_or_changed - embeddings_new AS DOUBLE) / chunks_new_or_changed ELSE 0.0 END AS embeddings_reuse_ratio,
               docs_new_or_changed = 0 AND embeddings_new = 0 AS noop_run FROM k""",
    "stale_chunks_after_edit": f'{_SHRUNK_WITH} SELECT "chunkId", "docId" FROM sc WHERE "chunkId" NOT IN (SELECT "chunkId" FROM nc)',
    "prune_stale": f'{_SHRUNK_WITH} SELECT "chunkId", "docId" FROM nc',
    "chat_role_mapping": "SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN 'system' WHEN 2 THEN 'assistant' ELSE 'user' END AS role FROM documents",
    "model_dim": f'''SELECT "chunkId", "modelName", CASE WHEN contains("modelName", 'small') THEN 384 WHEN contains("modelName", 'medium') THEN 768 ELSE 1024 END AS dim
        FROM (SELECT "chunkId", unnest([{', '.join(f"{chr(34)}modelName{chr(34)} || '{x}'" for x in SIZES)}]) AS "modelName" FROM delta_embeddings)''',
    "extract_struct": f"""
        SELECT path, CASE WHEN n < 200 THEN trim(t, chr(10)) ELSE trim(t[1:n // 2], chr(10)) || '======' || chr(10) || chr(10) || '======' || trim(t[n // 2 + 1:], chr(10)) END AS text,
               'Successfully extracted text from ' || CASE WHEN n < 200 THEN 1 ELSE 2 END || ' pages.' AS debug
        FROM (SELECT 'doc://' || doc_id AS path, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[^{_CP1252}]', '?', 'g') AS t FROM documents)""",
    "pipeline_two_runs": f"""{_WITH}, m AS (SELECT "chunkId", "docId", "chunkContentHash" FROM sc WHERE "chunkId" NOT IN (SELECT "chunkId" FROM cc) UNION ALL SELECT "chunkId", "docId", "chunkContentHash" FROM cc),
        d AS (SELECT "docId", title FROM n)
        SELECT "docId", title, '{MODEL}' AS embedder, count(*) AS n, min("chunkContentHash") AS first_hash FROM m JOIN d USING ("docId") GROUP BY "docId", title""",
}
SQL["embed_service"] = SQL["embed_deterministic"]

QUERIES = {
    f.__name__.removesuffix("_query"): f
    for f in (
        doc_projection, text_normalize, language_detect, chunk_fixed, chunk_small_window, chunk_intelligent, chunk_statistics_query, chunk_metadata_query, doc_delta_anti, existing_distinct,
        embedding_delta_anti, embed_deterministic, embed_service, merge_docs, merge_chunks, merge_embeddings, snapshot_join, snapshot_two_models, snapshot_one_model, corpus_size,
        run_metrics_counts, stale_chunks_after_edit, prune_stale_query, chat_role_mapping, model_dim, file_scan, extract_struct, pipeline_two_runs,
    )
}
