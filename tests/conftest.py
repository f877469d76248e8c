from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{base}/shared").config("spark.sql.warehouse.dir", f"file://{base}/warehouse")
        .config("spark.driver.extraJavaOptions", f"-Dderby.system.home={base}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from cairn.session import ship

    ship(session)
    yield session
    session.stop()


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)
