"""Every registered query with SQL gives DuckDB's rows for it."""

import math
import os

import duckdb
import pytest

from quarry import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 6) + 0.0 if isinstance(x, float) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(name, spark, sf_dir, con):
    df = catalog.QUERIES[name](spark, sf_dir)
    found = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, found.fetchall())


def test_every_query_is_registered_once():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).first()["n"] == 936
