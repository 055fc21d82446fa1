"""Every registered graph query against its SQL oracle."""

import re

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
ORACLES = entry_module.oracle_sql()
# The text operators, if present, have tests of their own.
QUERIES = {k: q for k, q in entry_module.queries().items() if not re.match(r"op\d+_|pipeline$", k)}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("lineitem", "part", "supplier", "orders"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLES) <= set(entry_module.queries())


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert [tuple(r) for r in rows] == [(1, 200), (2, 1852), (3, 7852), (4, 19814)]


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_oracle(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
