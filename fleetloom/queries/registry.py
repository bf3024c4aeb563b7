"""Registry of the driver queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL counterpart."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as nodes: cluster is the nation, role follows the segment."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("cluster_name"),
        F.col("c_name").alias("host"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("control-plane"))
        .otherwise(F.lit("worker"))
        .alias("role"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("10.0.0."), F.col("c_nationkey"))).alias("ip"),
        F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_custkey").alias("custkey"),
    )


# The same nodes as a SQL common table expression.
FLEET_SQL = """fleet AS (
  SELECT c_nationkey AS cluster_name, c_name AS host,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 'control-plane' ELSE 'worker' END AS role,
         CASE WHEN c_acctbal > 0 THEN '10.0.0.' || c_nationkey END AS ip,
         c_acctbal AS acctbal, c_mktsegment AS segment, c_custkey AS custkey
  FROM customer)"""
