"""Every registered query against its SQL text over the same tables."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from postlens.catalog import oracles, registry

FOLDER = "/root/testdata/sf0.001"
TABLES = [p.stem for p in Path(FOLDER).glob("*.parquet")]
QUERIES, ORACLES = registry.QUERIES, oracles.ORACLES

pytestmark = pytest.mark.skipif(not TABLES, reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return con


def canonical(rows, order):
    def cell(value):
        if isinstance(value, float):
            return None if math.isnan(value) else round(value, 9) + 0.0
        assert not isinstance(value, decimal.Decimal), "cast to bigint or double"
        return value

    picked = [tuple(cell(row[i]) for i in order) for row in rows]
    return sorted(picked, key=lambda r: [(v is None, str(v)) for v in r])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in frame.collect()]
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    assert sorted(frame.columns) == sorted(names)
    ordered = sorted(names)
    ours = canonical(rows, [frame.columns.index(c) for c in ordered])
    theirs = canonical(expected, [names.index(c) for c in ordered])
    assert len(rows) > 0
    assert ours == theirs


def test_entry(spark):
    assert contract.entry(spark).count() == 10
