"""Every registered query against its SQL on the whole tables."""

import os

import duckdb
import pytest

import __spark_entry__ as spark_entry
from layerframe.plans.table_queries import ORACLES, QUERIES

SF_DIR = os.environ.get("LAYERFRAME_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'"
        )
    return connection


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = spark_entry.queries()[name](spark, SF_DIR)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(got.columns)
    expected = sorted_rows(columns, result.fetchall())
    actual = sorted_rows(got.columns, [tuple(r) for r in got.collect()])
    assert len(expected) > 0
    assert len(actual) == len(expected)
    assert actual == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"list_page_files"}))
def test_plan_has_no_pairing_of_everything_and_no_python(spark, name):
    got = spark_entry.queries()[name](spark, SF_DIR)
    plan = got._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas"):
        assert bad not in plan


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLES) <= set(spark_entry.oracle_sql())


def test_entry_runs(spark):
    got = spark_entry.entry(spark)
    assert got.columns == ["partkey", "size", "price", "origin"]
    assert {r.origin for r in got.collect()} == {"base", "overridden", "added"}
