"""Every registered tracking query against its SQL twin in DuckDB."""

import decimal
import os

import duckdb
import pytest

from loomtrack import registry


def _plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 8)
    return str(value)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, sf, duck, name):
    found = registry.queries()[name](spark, sf)
    wanted = duck.sql(registry.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    place = [wanted.columns.index(c) for c in columns]
    rows = sorted(str([_plain(r[c]) for c in columns]) for r in found.collect())
    assert rows == sorted(str([_plain(r[k]) for k in place]) for r in wanted.fetchall())
