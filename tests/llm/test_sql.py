"""Queries that SQL can express, against DuckDB over whole tables."""

import duckdb
import pytest

from layerframe.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    expected = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    actual = [tuple(r) for r in got.select(*columns).collect()]
    assert expected and sorted(actual, key=repr) == sorted(expected, key=repr)
