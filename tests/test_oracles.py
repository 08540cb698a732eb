"""Every query with SQL gives the same rows on Spark and on DuckDB, on the smallest data."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
CORE = [n for n in entry.oracle_sql() if not entry.queries()[n].__module__.startswith("massloom.llm")]


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6) + 0.0
    return value


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", CORE)
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    got = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr(tuple(map(plain, r))) for r in got.fetchall())
    have = sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())
    assert have == want


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
