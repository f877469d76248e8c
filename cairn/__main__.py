"""``python -m cairn [--env=NAME] [--config=FILE] [--model=NAME] [--reindex] [--show-tables]``"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from cairn.config import Settings, load
from cairn.operators.embedding import HashEmbedder, HttpEmbedder, service_url
from cairn.plans.pipeline import documents_of_folder, run_once, show_tables
from cairn.session import ship
from cairn.sources.storage import TableStore


def session(settings: Settings) -> SparkSession:
    builder = SparkSession.builder.appName(settings.name).master(settings.spark.master).config("spark.sql.warehouse.dir", settings.spark.warehouse).config("spark.sql.session.timeZone", "UTC")
    if settings.spark.extensions:
        builder = builder.config("spark.sql.extensions", settings.spark.extensions)
    if settings.spark.catalog:
        builder = builder.config("spark.sql.catalog.spark_catalog", settings.spark.catalog)
    return builder.getOrCreate()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cairn")
    parser.add_argument("--env", default="local")
    parser.add_argument("--config")
    parser.add_argument("--model")
    parser.add_argument("--reindex", action="store_true", help="replace all tables")
    parser.add_argument("--show-tables", action="store_true", help="list the tables and end")
    parser.add_argument("--offline", action="store_true", help="deterministic vectors, no service")
    args = parser.parse_args(argv)
    settings = load(args.config, args.env)
    spark = session(settings)
    try:
        ship(spark)
        store = TableStore(spark, settings.data.store)
        if args.show_tables:
            for name, (count, rows) in show_tables(store).items():
                print(f"{name}: {count} rows")
                for row in rows:
                    print("  ", json.dumps(row.asDict(), default=str)[:300])
            return 0
        e = settings.embedding
        embedder = HashEmbedder() if args.offline else HttpEmbedder(service_url(e.url), timeout=e.timeout)
        docs = documents_of_folder(spark, settings.data.source, partitions=spark.sparkContext.defaultParallelism)
        print(json.dumps(run_once(store, docs, args.model or e.model, e.version, embedder, reindex=args.reindex, snapshots=settings.data.snapshots)))
        return 0
    finally:
        spark.stop()


if __name__ == "__main__":
    raise SystemExit(main())
