"""Every query with an oracle matches DuckDB on the sf0.001 tables (order-insensitive)."""
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from scripts.oracle_check import TABLES, _rows
from tests.conftest import SF001


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = Path(SF001) / f"{t}.parquet"
        if p.exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_duckdb(spark, con, name):
    got = entry.queries()[name](spark, SF001).toPandas()
    exp = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    assert len(got) == len(exp)
    assert _rows(got) == _rows(exp)
