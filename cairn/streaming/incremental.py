"""The index as a stream: new files are taken up as they arrive.

The stream only says which files are new; each micro-batch is one ordinary run. The batch's
number is the run's id, and a batch that was recorded already is not run again, so a restart
after a failure neither repeats nor skips files.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.functions.text import normalize
from cairn.operators.documents import project_documents
from cairn.plans.pipeline import Options, run_once
from cairn.sources.files import extract_texts
from cairn.sources.storage import TableStore

FILES = "path string, modificationTime timestamp, length long, content binary"


def follow(spark: SparkSession, folder: str, store: TableStore, checkpoint: str, model: str, version: str, embedder: Any = None, options: Options = Options(), pattern: str = "*.pdf", files_per_batch: int = 1000, once: bool = False) -> StreamingQuery:
    """Run for every batch of new files in ``folder``; with ``once`` until none are left."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)

    def take(batch: DataFrame, number: int) -> None:
        run_id = f"stream-{number}"
        done = store.read_or_none("run_metrics")
        if done is not None and not done.where(F.col("run_id") == run_id).isEmpty():
            return
        texts = extract_texts(batch)
        docs = project_documents(texts, F.col("path"), normalize(F.col("text")), F.col("debug"), extra=["length"])
        run_once(store, docs, model, version, embedder, options, run_id=run_id)

    writer = files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
