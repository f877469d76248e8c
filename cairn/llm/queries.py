"""Queries of the training-text operators over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.garbled import restore
from cairn.llm import languages
from cairn.llm.leaks import leaks
from cairn.llm.near_duplicates import groups, similar_pairs
from cairn.llm.scans import scan_noise
from cairn.llm.splitting import split_items
from cairn.llm.tokenizer import decode_ids, encode_texts
from cairn.llm.vectors import nearest_vectors
from cairn.operators.current import current_rows
from cairn.session import read, work_table


def _chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return current_rows(read(spark, sf_dir, "delta_pdf_chunks"), ["chunkId"], "extracted_ts", ["chunkId", *columns])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similar_pairs(_chunks(spark, sf_dir, "docId", "chunkText"), size=3, threshold=0.6, rows=4)
    return pairs.selectExpr("id_a AS chunk_a", "id_b AS chunk_b")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(_chunks(spark, sf_dir, "docId", "chunkText"), size=3, threshold=0.6, rows=4)


def _scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    titles = current_rows(read(spark, sf_dir, "delta_pdf_docs"), ["docId"], "extracted_ts", ["docId", "title"])
    return scan_noise(_chunks(spark, sf_dir, "docId", "chunkText"), titles)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir)[0].select(F.col("id").alias("chunkId"), "kind")


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir)[1].withColumnRenamed("id", "chunkId")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(read(spark, sf_dir, "pdf_chunk")).select("item_id").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(read(spark, sf_dir, "pdf_chunk"))


def _languages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, sf_dir, "delta_pdf_docs")
    profiles = languages.fit(docs)
    found = languages.passages(_chunks(spark, sf_dir, "docId", "chunkText"), profiles, "chunkId", "docId", "chunkText")
    return docs, work_table(found, "passages")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found = _languages(spark, sf_dir)
    current = current_rows(docs, ["docId"], "extracted_ts", ["docId", "language"])
    wrong = languages.mislabelled(current, found).select(F.lit("doc").alias("unit"), "id", "lang")
    return wrong.unionByName(languages.mixed(found).select(F.lit("chunk").alias("unit"), "id", "lang"))


def p6_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.document_languages(_languages(spark, sf_dir)[1]).withColumnRenamed("owner", "docId")


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir)[1].select(F.col("id").alias("chunkId"), F.inline("segments"))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "delta_embeddings").where(F.col("modelVersion") == "1.1")
    return current_rows(rows, ["chunkId"], "embedded_ts", ["chunkId", "embedding"])


def p7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(_embeddings(spark, sf_dir), k=5)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = p7_neighbours(spark, sf_dir)
    return near.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b")).distinct()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(read(spark, sf_dir, "documents"))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_ids(encode_texts(read(spark, sf_dir, "documents")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"), window=12, edits=1)
    return near.where("edits = 0").select("doc_id", "item_id")


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"), window=16, edits=1)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore(read(spark, sf_dir, "documents"), source="source").select("doc_id").distinct()


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore(read(spark, sf_dir, "documents"), source="source")


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_groups, p4_found, p4_repaired, p5_found, p5_pieces, p6_found, p6_documents, p6_segments,
        p7_found, p7_neighbours, p8_ids, p8_round_trip, p9_found, p9_near, p10_found, p10_restored,
    )
}

_CURRENT = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunkId ORDER BY extracted_ts DESC NULLS LAST) AS rn FROM delta_pdf_chunks WHERE chunkId IS NOT NULL) WHERE rn = 1"
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"

SQL = {
    "p2_found": f"""
        WITH w AS (SELECT chunkId, docId, {_WORDS.format('chunkText')} AS w FROM ({_CURRENT})),
        s AS (SELECT DISTINCT chunkId, docId, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM w)),
        n AS (SELECT chunkId, count(*) AS n FROM s GROUP BY chunkId),
        c AS (SELECT a.chunkId AS chunk_a, b.chunkId AS chunk_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.chunkId < b.chunkId AND a.docId <> b.docId GROUP BY ALL)
        SELECT chunk_a, chunk_b FROM c JOIN n x ON x.chunkId = chunk_a JOIN n y ON y.chunkId = chunk_b WHERE k >= 0.6 * (x.n + y.n - k)""",
    "p2_groups": f"""
        WITH RECURSIVE w AS (SELECT chunkId, {_WORDS.format('chunkText')} AS w FROM ({_CURRENT})),
        s AS (SELECT DISTINCT chunkId, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM w)),
        n AS (SELECT chunkId, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS cls FROM s GROUP BY chunkId),
        c AS (SELECT a.chunkId AS x, b.chunkId AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g GROUP BY ALL),
        l AS (SELECT c.x, c.y FROM c JOIN n a ON a.chunkId = c.x JOIN n b ON b.chunkId = c.y WHERE k >= 0.6 * (a.n + b.n - k)),
        r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
        SELECT n.chunkId AS id, g."group", count(*) OVER (PARTITION BY cls) AS copies FROM n JOIN (SELECT x, min(y) AS "group" FROM r GROUP BY x) g ON g.x = n.chunkId""",
    "p5_found": r"SELECT DISTINCT item_id FROM pdf_chunk WHERE item_id IS NOT NULL AND length(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')) > 1500",
    "p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_found": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), e AS (SELECT item_id, {_WORDS.format('text')} AS w FROM eval_items),
        dw AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS i FROM d)),
        ew AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS i FROM e))
        SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (g)""",
}
