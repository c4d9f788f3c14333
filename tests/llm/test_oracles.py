"""The queries that SQL can express, against DuckDB over whole tables."""

import duckdb
import pytest

from factlattice.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    cursor = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall())
    got = queries.QUERIES[name](spark, folder).select(*names)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert len(want) > 100
