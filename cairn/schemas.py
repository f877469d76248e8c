"""Schemas of the managed tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(ddl: str) -> T.StructType:
    return T.StructType([_field(x) for x in ddl.split(",")])


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "floats": T.ArrayType(T.FloatType())}


def _field(text: str) -> T.StructField:
    name, kind = text.split()
    return T.StructField(name, _TYPES[kind])


DOCS = _schema("pdfUri string,text string,debugInfo string,language string,title string,docId string,contentHash string")
CHUNKS = _schema("docId string,chunkIndex int,chunkStartIndex int,chunkEndIndex int,chunkText string,sectionPath string,chunkContentHash string,chunkId string")
EMBEDDINGS = _schema("chunkId string,chunkContentHash string,modelName string,modelVersion string,embedding floats")
SNAPSHOT = _schema("chunkId string,docId string,chunkText string,sectionPath string,title string,language string,embedding floats,embedder string,embedder_ver string,contentHash string,version_ts timestamp")
RUN_METRICS = _schema(
    "run_id string,run_ts long,docs_scanned long,bytes_scanned long,docs_new_or_changed long,chunks_new_or_changed long,embeddings_new long,embeddings_reused long,"
    "t_read_ms long,t_delta_ms long,t_chunk_ms long,t_embed_ms long,t_publish_ms long,t_total_ms long,docs_per_sec double,embeddings_per_sec double,"
    "docs_skipped_ratio double,embeddings_reuse_ratio double,noop_run boolean,snapshot_path string,model_version string,publish_ts long"
)
#: Keys of the upserts.
KEYS = {"docs": ["docId"], "chunks": ["chunkId"], "embeddings": ["chunkId", "modelName", "modelVersion"]}
