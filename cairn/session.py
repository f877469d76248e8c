"""Session helpers: the shared work folder, written intermediate tables and plan sizing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWNED: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on a single machine a temporary folder is set; on a
    cluster, whose executors would not share it, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {context.master} share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="cairn-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before
        pass


@atexit.register
def _cleanup() -> None:
    for path, spark in _OWNED.items():
        _delete(spark, path.rpartition("/")[0])


def drop_table(df: DataFrame) -> None:
    """Delete a table made by :func:`work_table` once nothing reads it any more."""
    path = getattr(df, "_cairn_path", None)
    if path and path in _OWNED:
        _delete(_OWNED.pop(path), path.rpartition("/")[0])  # with the folder of its own


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the written table.

    This cuts the lineage without tying rows to one executor: a lost executor costs a re-read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cairn-{uuid.uuid4().hex}/{name}"
    _OWNED[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_cairn_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="cairn-code-")) / "cairn_code.zip"
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    context._cairn_shipped = True
