"""Every registered query against its SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from fleetloom.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(tables):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(tables, name)}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return str(value) if hasattr(value, "isoformat") else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(driver.oracle_sql())))
def test_query_equals_sql(spark, duck, tables, name):
    df = driver.queries()[name](spark, tables)
    result = duck.execute(driver.oracle_sql()[name])
    columns = [column[0] for column in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_entry(spark):
    assert driver.entry(spark).columns == ["cluster_name", "host", "role", "path", "value", "layer_rank"]


def test_redaction_changes_something(spark, tables):
    changed = driver.queries()["redact_documents"](spark, "/root/testdata/sf0.01").where("changed").count()
    assert changed > 0


@pytest.mark.parametrize("name", ["applicable_layers", "config_drift", "upgrade_plan", "resolve_refs", "stop_after_failure"])
def test_plans_have_no_nested_loops_or_python(spark, tables, name):
    plan = driver.queries()[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
