"""Every registered query of the engine against its DuckDB counterpart on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from tidemark import catalogue, catalogue_loads, catalogue_market, catalogue_plans, catalogue_runs  # noqa: F401
from tidemark.views import TABLES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(x)
    return x


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, small, duck, name):
    df = catalogue.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    cursor = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
