"""Every registered query against its SQL counterpart."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from morphotab.plans.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")
ORACLES = contract.oracle_sql()
TYPES = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER"}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{name}'")
    return connection


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    types = {c[0]: str(c[1]) for c in result.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == types
    expected = sorted((tuple(r[columns.index(c)] for c in order) for r in result.fetchall()), key=str)
    got = sorted((tuple(r[c] for c in order) for r in rows), key=str)
    assert len(got) == len(expected)
    assert [g for g, e in zip(got, expected) if g != e] == []


def test_all_have_sql():
    assert set(QUERIES) <= set(ORACLES) <= set(contract.queries())


def test_entry(spark):
    out = contract.entry(spark)
    assert out.count() > 0
    assert {"object", "genotype", "lower", "n"} <= set(out.columns)
