"""Every query that SQL can say gives the rows that DuckDB gives for its SQL."""

from __future__ import annotations

import math

import duckdb
import pytest

from palimpsest.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value if isinstance(value, int) else str(value)


def normal(names: list[str], found: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(found.columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
