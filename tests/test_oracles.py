"""Every catalog query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from tracelake.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def cells(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(str(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    mine = [tuple(r) for r in df.collect()]
    found = duck.execute(catalog.oracles()[name])
    theirs, names = found.fetchall(), [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert cells(mine, df.columns) == cells(theirs, names)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
