import duckdb
import pytest

from tracelake.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(registry.ORACLES[name])
    names, theirs = [d[0] for d in found.description], found.fetchall()
    df = registry.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(map(str, r)) for r in df.select(*names).collect()) == sorted(tuple(map(str, r)) for r in theirs)
