from __future__ import annotations

import ast
from pathlib import Path

import __spark_entry__ as entry
import duckdb
import pytest

from tests.conftest import DATA, ROOT

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the test tables aren't here")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_import_llm():
    for path in [*(ROOT / "cairn").rglob("*.py")]:
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("cairn.llm") for n in names), path


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(_norm, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rel = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({entry.oracle_sql()[name]})")
    assert sorted(map(_norm, df.select(*cols).collect()), key=repr) == sorted(map(_norm, rel.fetchall()), key=repr)
