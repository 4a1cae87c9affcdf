"""Every registered query against its checking SQL on the test tables."""

import pytest
from compare import connect, differences
from pyspark.sql import types as T

import __spark_entry__ as entry
from roadledger.plans import oracle
from roadledger.plans.queries import QUERIES

ORACLE = oracle.statements()
DUCK_TYPES = {
    T.LongType: "BIGINT",
    T.DoubleType: "DOUBLE",
    T.StringType: "VARCHAR",
    T.BooleanType: "BOOLEAN",
    T.TimestampNTZType: "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck(data_dir):
    return connect(data_dir)


def test_every_query_has_checking_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_checking_sql(spark, duck, data_dir, name):
    result = QUERIES[name](spark, data_dir)
    assert differences(result, duck, ORACLE[name]) == ""
    described = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {ORACLE[name]}").fetchall()}
    assert described == {f.name: DUCK_TYPES[type(f.dataType)] for f in result.schema.fields}


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
