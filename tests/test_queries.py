"""Every registered fact query against DuckDB, over the same Parquet files."""

import os

import duckdb
import pytest

from factlattice.plans import registry

SF = os.environ.get("LATTICE_QUERY_DIR", "/root/testdata/sf0.001")


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(round(r[k], 5) if isinstance(r[k], float) else r[k] for k in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    cursor = duck.execute(registry.SQL[name])
    names = [c[0] for c in cursor.description]
    want = canon(cursor.fetchall(), names)
    assert sorted(got.columns) == sorted(names)
    assert canon([tuple(r) for r in got.collect()], got.columns) == want
    assert want, "an empty result tests nothing"


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
