"""Queries over whole tables for the core's own operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.operators.ledger import next_run
from cairn.operators.snapshot_diff import snapshot_changes
from cairn.session import read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(read(spark, sf_dir, "retrieval_index_snapshot"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_run(read(spark, sf_dir, "delta_pdf_chunks"), read(spark, sf_dir, "run_ledger"), read(spark, sf_dir, "run_metrics"))


P1_SQL = """
WITH r AS (
  SELECT index_version v, chunkId c, lower(trim(contentHash, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) h,
         row_number() OVER (PARTITION BY index_version, chunkId ORDER BY landed_ts DESC NULLS LAST) n
  FROM retrieval_index_snapshot WHERE index_version IS NOT NULL AND chunkId IS NOT NULL),
l AS (SELECT v, c, h FROM r WHERE n = 1),
o AS (SELECT v cur, lag(v) OVER (ORDER BY v) prev FROM (SELECT DISTINCT v FROM l)),
k AS (SELECT cur, prev, c FROM o JOIN l ON l.v = o.cur WHERE prev IS NOT NULL
      UNION SELECT cur, prev, c FROM o JOIN l ON l.v = o.prev)
SELECT k.cur AS index_version, k.c AS "chunkId",
       CASE WHEN b.c IS NULL THEN 'added' WHEN a.c IS NULL THEN 'removed' ELSE 'changed' END AS change_type
FROM k LEFT JOIN l a ON a.v = k.cur AND a.c = k.c LEFT JOIN l b ON b.v = k.prev AND b.c = k.c
WHERE a.c IS NULL OR b.c IS NULL OR a.h IS DISTINCT FROM b.h
"""

P3_SQL = """
WITH c AS (SELECT chunkId, docId, chunkContentHash h FROM (
             SELECT *, row_number() OVER (PARTITION BY chunkId ORDER BY extracted_ts DESC NULLS LAST) n
             FROM delta_pdf_chunks WHERE chunkId IS NOT NULL) WHERE n = 1),
runs AS (SELECT run_id, min(run_ts) t FROM run_metrics GROUP BY run_id HAVING max(publish_ts) IS NOT NULL),
last AS (SELECT chunkId, h FROM (
           SELECT g.chunkId, g.chunkContentHash h, row_number() OVER (PARTITION BY g.chunkId ORDER BY t DESC, logged_ts DESC) n
           FROM run_ledger g JOIN runs USING (run_id)) WHERE n = 1),
j AS (SELECT c.*, last.chunkId IS NOT NULL seen,
             CASE WHEN last.chunkId IS NULL THEN 'new' WHEN c.h IS NULL OR last.h IS DISTINCT FROM c.h THEN 'changed' END kind
      FROM c LEFT JOIN last USING (chunkId))
SELECT 'chunk' AS unit, chunkId AS id, kind AS change_type FROM j WHERE kind IS NOT NULL
UNION ALL
SELECT 'doc', docId, CASE WHEN bool_or(seen) THEN 'changed' ELSE 'new' END FROM j
WHERE docId IS NOT NULL GROUP BY docId HAVING bool_or(kind IS NOT NULL)
"""

QUERIES = {"p1_found": p1_found, "p3_found": p3_found}
SQL = {"p1_found": P1_SQL, "p3_found": P3_SQL}
