"""Every query that has SQL gives the same rows as DuckDB; the others give rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from fieldspan.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{data}/{name}')")
    con.sql("set timezone = 'UTC'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(map(str, map(tuple, df.select(*cols).collect())))
    want = duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({SQL[name]})")
    assert sorted(want.columns) == cols
    assert got == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_does_without_the_text_operators():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['fieldspan.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(*e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True, check=True).stdout.split()
    assert set(said) == set(QUERIES)
