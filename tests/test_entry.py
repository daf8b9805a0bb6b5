"""The driver's contract, and every query with SQL against DuckDB on the smallest tables."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent
OWN = sorted(entry._own.SQL)


def normal(v):
    if v is None:
        return ("null",)
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    return v


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, tables, name):
    df = entry.queries()[name](spark, tables)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(normal(r[c]) for c in columns)) for r in df.collect())
    con = duckdb.connect()
    for p in Path(tables).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cursor = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(repr(tuple(normal(r[i]) for i in at)) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(entry._own.QUERIES) - set(OWN)))
def test_query_without_sql_gives_rows(spark, tables, name):
    assert entry.queries()[name](spark, tables).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["x", "y", "peak", "rm_peak", "snr"]


def test_entry_without_the_training_data_part(tmp_path):
    """What is left must import and keep its queries when that part is deleted."""
    import shutil

    shutil.copytree(ROOT / "faradeon", tmp_path / "faradeon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'a6_peak_snr' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_code_is_shipped_to_clusters_once():
    import zipfile
    from types import SimpleNamespace

    seen = []
    context = SimpleNamespace(master="spark://host:7077", addPyFile=lambda path: seen.append(zipfile.ZipFile(path).namelist()))
    for _ in range(2):
        entry._ship(SimpleNamespace(sparkContext=context))
    assert len(seen) == 1 and {"faradeon/__init__.py", "faradeon/operators/scan.py"} <= set(seen[0])
    local = SimpleNamespace(master="local-cluster[2,1,1024]", environment={})
    entry._ship(SimpleNamespace(sparkContext=local))
    assert local.environment["PYTHONPATH"] == str(ROOT)
