"""Every registered query against its SQL twin on an independent engine."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tallyworks.plans import all_queries, all_sql

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

QUERIES = all_queries()
SQL = all_sql()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def ordered(found):
    return sorted(found, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, oracle, name):
    result = QUERIES[name](spark, FOLDER)
    columns = sorted(result.columns)
    found = oracle.sql(SQL[name])
    assert sorted(found.columns) == columns
    kinds = dict(zip(found.columns, map(str, found.types)))
    assert {c: TYPES[k] for c, k in result.dtypes} == kinds
    names = ", ".join(f'"{c}"' for c in columns)
    expected = ordered(oracle.sql(f"SELECT {names} FROM ({SQL[name]})").fetchall())
    actual = ordered(tuple(r) for r in result.select(*columns).collect())
    assert actual == expected
    assert actual


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_sketches_are_close_to_exact_counts(spark):
    exact = {r["day"]: r["dau"] for r in QUERIES["food_dau"](spark, FOLDER).collect()}
    sketch = {r["day"]: r["dau"] for r in QUERIES["food_dau_sketch"](spark, FOLDER).collect()}
    assert exact.keys() == sketch.keys()
    assert all(abs(sketch[d] - exact[d]) <= 0.05 * exact[d] + 1 for d in exact)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0
