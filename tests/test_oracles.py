"""Every registered query against its SQL statement, values and types."""

import pytest

import compare
from __spark_entry__ import entry
from claimweave.oracles import ORACLES
from claimweave.registry import QUERIES

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def con(tiny):
    return compare.connect(tiny)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, con, name):
    df, sql = QUERIES[name](spark, tiny), ORACLES[name]
    assert compare.difference(df, con, sql) is None
    want = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    assert {c: TYPES.get(t, t.upper()) for c, t in df.dtypes} == want


def test_comparison_notices_a_change(spark, tiny, con):
    df = QUERIES["freq"](spark, tiny)
    assert compare.difference(df.limit(2), con, ORACLES["freq"])
    assert compare.difference(df.withColumn("claims", df.claims + 1), con, ORACLES["freq"])
