"""Queries on whole given tables against their SQL in DuckDB."""

import os

import duckdb
import pytest

from fleetloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, tables, name):
    with duckdb.connect() as db:
        for table in ("documents", "benchmark", "labels"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(tables, table)}.parquet'")
        wanted = db.execute(queries.ORACLES[name])
        columns = sorted(column[0] for column in wanted.description)
        rows = wanted.df()[columns].values.tolist()
    df = queries.QUERIES[name](spark, tables)
    assert sorted(df.columns) == columns
    assert sorted(df.select(*columns).toPandas().values.tolist(), key=repr) == sorted(rows, key=repr)
