"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from millrace.plans import registry
from millrace.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, int | str | bool) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    if name not in SQL:
        assert got
        return
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, cursor.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_the_rest_stands_without_the_llm_folders(tmp_path):
    root = Path(__file__).resolve().parents[1]
    for x in root.iterdir():
        if x.name not in (".git", "corpus_pipeline.py", "millrace"):
            (tmp_path / x.name).symlink_to(x)
    (tmp_path / "millrace").mkdir()
    for x in (root / "millrace").iterdir():
        if x.name != "llm":
            (tmp_path / "millrace" / x.name).symlink_to(x)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'co_occurrence_pairs' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
