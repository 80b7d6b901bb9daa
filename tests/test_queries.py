"""Every catalogued query against its DuckDB SQL on the small tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

from clausegrid.plans.catalogue import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(value: object) -> str:
    """A value in a form that both engines share."""
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def rows(columns: list[str], found: list[tuple]) -> list[tuple[str, ...]]:
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in by) for r in found)


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{SF_DIR}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark: SparkSession, duck: duckdb.DuckDBPyConnection, name: str) -> None:
    df = QUERIES[name](spark, SF_DIR)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark: SparkSession, name: str) -> None:
    assert QUERIES[name](spark, SF_DIR).count() > 0
