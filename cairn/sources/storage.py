"""Versioned Parquet tables that are published together.

A table's rows lie in folders of ``<root>/<name>``, which are written once and never changed. Which
folders of each table count is in one small file, ``<root>/_current/<n>.json``, whose greatest
number wins; it is created exclusively. So a run publishes all its tables by one file or none.

Tables that are merged into are cut into buckets by a hash: a merge reads and rewrites the buckets
that its rows fall into and takes over the others as they are. Tables that are appended to are a
list of parts. What no recent version refers to is deleted by :meth:`TableStore.vacuum`.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.operators.delta import duplicate_keys, upsert

#: Buckets of a merged table, fixed when it is made; tasks that write one bucket, at most.
BUCKETS, SPLIT = 64, 8
#: Parts of an appended table before they are written as one.
MOST_PARTS = 64
#: Renames to make once a version counts, in the pointer file beside the tables.
_RENAMES = "#renames"


class Conflict(RuntimeError):
    """Another writer published first, and changed what this one had read."""


class TableStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._files(self.root)

    def _files(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/_current")
        names = [str(s.getPath().getName()) for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _pointer(self, number: int) -> dict[str, Any]:
        stream = self._fs.open(self._path(f"{self.root}/_current/{number}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def versions(self) -> dict[str, Any]:
        """What each table's current version is: a path, a list of parts, or its buckets.

        Renames that the writer of the version did not live to make are made first.
        """
        numbers = self._numbers()
        if not numbers:
            return {}
        found = self._pointer(numbers[-1])
        for aside, target in found.pop(_RENAMES, []):
            self._rename(aside, target)
        return found

    def _rename(self, aside: str, target: str) -> None:
        fs = self._files(target)
        if fs.exists(self._path(aside)) and not fs.exists(self._path(target)):
            fs.mkdirs(self._path(target).getParent())
            fs.rename(self._path(aside), self._path(target))

    def exists(self, name: str) -> bool:
        return name in self.versions()

    def tables(self) -> list[str]:
        return sorted(self.versions())

    def _load(self, version: Any, schema: StructType | None = None) -> DataFrame:
        paths = _paths(version)
        kind = schema or (StructType.fromJson(version["schema"]) if isinstance(version, dict) else None)
        reader = self.spark.read.schema(kind) if kind else self.spark.read
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def read(self, name: str, schema: StructType | None = None) -> DataFrame:
        return self._load(self.versions()[name], schema)

    def read_or_none(self, name: str) -> DataFrame | None:
        return self.read(name) if self.exists(name) else None

    def begin(self, fresh: bool = False) -> Transaction:
        """A transaction on the current tables or, with ``fresh``, on none."""
        return Transaction(self, fresh)

    def drop_all(self) -> None:
        """Remove every table with its history."""
        self._fs.delete(self._path(self.root), True)

    def vacuum(self, keep: int = 3) -> list[str]:
        """Delete the folders that none of the last ``keep`` versions refers to; their paths.

        A reader may go on with a version that old. Folders of a transaction that is under way are
        numbered beyond the current version and stay.
        """
        numbers = self._numbers()
        if not numbers:
            return []
        live = {p for n in numbers[-keep:] for v in self._pointer(n).values() for p in _paths(v)}
        gone = []
        for table in self._fs.listStatus(self._path(self.root)):
            name = str(table.getPath().getName())
            if name.startswith("_") or not table.isDirectory():
                continue
            for folder in self._fs.listStatus(table.getPath()):
                path = f"{self.root}/{name}/{folder.getPath().getName()}"
                number = str(folder.getPath().getName()).removeprefix("v=").split("-")[0]
                if number.isdigit() and int(number) <= numbers[-1] and not any(p == path or p.startswith(path + "/") for p in live):
                    self._fs.delete(folder.getPath(), True)
                    gone.append(path)
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_current/{n}.json"), False)
        return gone

    def _publish(self, number: int, versions: dict[str, Any]) -> bool:
        self._fs.mkdirs(self._path(f"{self.root}/_current"))
        # written aside and renamed, so that no reader sees half a file; a rename never replaces
        aside, target = self._path(f"{self.root}/_current/.{number}-{uuid.uuid4().hex[:8]}.new"), self._path(f"{self.root}/_current/{number}.json")
        if self._fs.exists(target):
            return False
        stream = self._fs.create(aside, True)
        try:
            stream.write(bytearray(json.dumps(versions).encode()))
        finally:
            stream.close()
        done = self._fs.rename(aside, target)
        if not done:
            self._fs.delete(aside, False)
        return done


def _paths(version: Any) -> list[str]:
    if isinstance(version, dict):
        return [version["paths"][k] for k in sorted(version["paths"], key=int)]
    return [version] if isinstance(version, str) else [p for p in version if isinstance(p, str)]


class Transaction:
    """Writes that become visible together with :meth:`commit`."""

    def __init__(self, store: TableStore, fresh: bool = False):
        self.store, self.fresh = store, fresh
        self.base = {} if fresh else store.versions()
        numbers = store._numbers()
        self.number = (numbers[-1] if numbers else 0) + 1
        self.new: dict[str, Any] = {}
        self.added: dict[str, list[str]] = {}
        self.renames: list[tuple[str, str]] = []
        self.seen: set[str] = set()

    def _folder(self, name: str) -> str:
        # of its own: a table may be written twice in a transaction, and others may be under way
        return f"{self.store.root}/{name}/v={self.number}-{uuid.uuid4().hex[:8]}"

    def overwrite(self, name: str, df: DataFrame) -> DataFrame:
        """Write a new version; returns it as it will be read."""
        path = self._folder(name)
        df.write.parquet(path)
        self.new[name] = path
        return self.store.spark.read.schema(df.schema).parquet(path)

    def publish_at(self, name: str, df: DataFrame, target: str) -> None:
        """Write a new table that will lie at ``target``, which appears with the commit only."""
        head, _, last = target.rpartition("/")
        aside = f"{head}/.{last}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(aside)
        self.renames.append((aside, target))
        self.new[name] = target

    def now(self, name: str) -> DataFrame | None:
        """A table as this transaction sees it, its own writes included."""
        self.seen.add(name)
        version = self.new.get(name, self.base.get(name))
        return self.store._load(version) if version else None

    def merge(self, name: str, source: DataFrame, keys: list[str], by: str | None = None, check: bool = True) -> DataFrame:
        """Upsert ``source`` by ``keys``; a key that it holds twice is an error.

        Only the buckets of the source's rows are read and written. ``by`` is the column whose hash
        gives the bucket, which must be the same in all rows of a key; the first of ``keys`` if None.
        """
        if check and not duplicate_keys(source, keys).isEmpty():
            raise ValueError(f"the rows to merge into {name} repeat a key of {keys}")
        return self._rewrite(name, source, keys, by or keys[0], lambda old, new: upsert(old, new, keys))

    def delete(self, name: str, gone: DataFrame, keys: list[str], by: str | None = None) -> DataFrame:
        """Take out the rows with a key of ``gone``; only the buckets of these are written."""
        if self.now(name) is None:
            raise ValueError(f"there is no table {name}")
        return self._rewrite(name, gone, keys, by or keys[0], lambda old, new: old.join(new.select(*keys), keys, "left_anti").select(old.columns))

    def _rewrite(self, name: str, source: DataFrame, keys: list[str], by: str, change) -> DataFrame:
        self.seen.add(name)
        spark, held = self.store.spark, self.new.get(name, self.base.get(name))
        if held is not None and not isinstance(held, dict):  # a table that was written as a whole
            held = self._split(name, self.store._load(held), keys, by)
        count = held["buckets"] if held else self.store.buckets
        bucket = F.pmod(F.xxhash64(by), F.lit(count)).cast("int")
        touched = [r[0] for r in source.select(bucket.alias("b")).distinct().collect()]  # bounded by the buckets
        schema = StructType.fromJson(held["schema"]) if held else source.schema
        if held and not touched:
            self.new[name] = held
            return self.store._load(held)
        paths = [held["paths"][str(b)] for b in touched if str(b) in held["paths"]] if held else []
        old = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema) if held else None
        written = self._split(name, change(old, source), keys, by, count, schema)
        rest = {b: p for b, p in held["paths"].items() if int(b) not in touched} if held else {}
        self.new[name] = written | {"paths": rest | written["paths"]}
        return self.store._load(self.new[name])

    def _split(self, name: str, df: DataFrame, keys: list[str], by: str, count: int | None = None, schema: StructType | None = None) -> dict[str, Any]:
        """Write rows bucket by bucket; large buckets by several tasks."""
        count, path = count or self.store.buckets, self._folder(name)
        rows = df.withColumn("_b", F.pmod(F.xxhash64(by), F.lit(count)).cast("int"))
        rows.repartition("_b", F.pmod(F.xxhash64(*keys), F.lit(SPLIT))).write.partitionBy("_b").parquet(path)
        folders = [str(f.getPath().getName()) for f in self.store._fs.listStatus(self.store._path(path)) if f.isDirectory()]
        paths = {f.removeprefix("_b="): f"{path}/{f}" for f in folders if f.startswith("_b=")}
        return {"buckets": count, "by": by, "schema": (schema or df.schema).jsonValue(), "paths": paths}

    def append(self, name: str, rows: DataFrame) -> None:
        """Add a part to a table; what is there is not touched, but for very many parts made one."""
        held = self.new.get(name, self.base.get(name)) or []
        held = [held] if isinstance(held, str) else held
        if len(held) >= MOST_PARTS:
            self.seen.add(name)
            held = [_write_to(self._folder(name), self.store._load(held).coalesce(1))]
        path = _write_to(self._folder(name), rows)
        self.added.setdefault(name, []).append(path)
        self.new[name] = [*held, path]

    def commit(self) -> None:
        """Publish. If another writer was first, and changed nothing that this one read or wrote but
        tables both append to, this one's tables go on top of the other's; else it is a conflict."""
        base, number = self.base, self.number
        renames = {_RENAMES: self.renames} if self.renames else {}
        while not self.store._publish(number, base | self.new | renames):
            now = self.store.versions()
            mine = self.seen | (self.new.keys() - self.added.keys() if not self.fresh else self.base.keys() | now.keys())
            changed = sorted(n for n in mine if now.get(n) != self.base.get(n))
            if changed:
                raise Conflict(f"another run changed {', '.join(changed)}")
            self.new |= {n: [*_paths(now.get(n, [])), *parts] for n, parts in self.added.items() if n not in self.seen}
            base, number = now, self.store._numbers()[-1] + 1
        for aside, target in self.renames:
            self.store._rename(aside, target)


def _write_to(path: str, df: DataFrame) -> str:
    df.write.parquet(path)
    return path


def register_table(spark: SparkSession, database: str, name: str, path: str) -> None:
    """A catalog table over files that are there already; the database is made if it isn't there."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` USING PARQUET LOCATION '{path}'")


def save_table(df: DataFrame, database: str, name: str, mode: str = "errorifexists") -> None:
    """A catalog table with its provider stated; the database is made if it isn't there."""
    spark = df.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    df.write.format("parquet").mode(mode).saveAsTable(f"`{database}`.`{name}`")


def table_exists(spark: SparkSession, database: str, name: str) -> bool:
    return spark.catalog.databaseExists(database) and spark.catalog.tableExists(f"{database}.{name}")


def recreate_database(spark: SparkSession, database: str) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS `{database}` CASCADE")
    spark.sql(f"CREATE DATABASE `{database}`")


def list_tables(spark: SparkSession, database: str) -> list[str]:
    """Names of a database's tables; none if there is no such database."""
    return sorted(t.name for t in spark.catalog.listTables(database)) if spark.catalog.databaseExists(database) else []
