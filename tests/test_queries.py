"""Every query that has SQL gives the same rows as DuckDB on the same tables."""

import math
import os

import pytest

from terrane.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        table = name.removesuffix(".parquet")
        path = f"{sf_dir}/{name}"
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def normal(rows):
    one = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else x + 0.0 if isinstance(x, float) else x
    return sorted((tuple(map(one, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, spark, sf_dir, con):
    got = QUERIES[name](spark, sf_dir)
    names = sorted(got.columns)
    expected = con.sql(ORACLES[name])
    assert sorted(expected.columns) == names
    columns = ", ".join(f'"{c}"' for c in names)
    assert normal(got.select(*names).collect()) == normal(con.sql(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_gives_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0
