"""Streaming operators run to their end over replayed event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetloom.queries.health_queries import DAY, FIRST_STABLE_SQL, RETRY_SQL, node_events
from fleetloom.queries.registry import query, table
from fleetloom.streaming import stability
from fleetloom.streaming.replay import replay

SLICES = 3
DELAY = 60


def _slices(log: DataFrame, horizon_seconds: int) -> tuple[list[DataFrame], int]:
    """The log in time slices, then one far heartbeat row that moves the watermark on; and how long to remember.

    A decided key may come back at any time of the log, so it is remembered for the whole of it; the
    heartbeat is later than that, and then all are forgotten.
    """
    first, last = log.agg(F.min("ts"), F.max("ts")).first()
    span = int((last - first).total_seconds()) + 1
    width = (last - first) / SLICES
    bounds = [first + width * i for i in range(1, SLICES)]
    parts = []
    for i in range(SLICES):
        part = log
        if i > 0:
            part = part.where(F.col("ts") >= F.lit(bounds[i - 1]))
        if i < SLICES - 1:
            part = part.where(F.col("ts") < F.lit(bounds[i]))
        parts.append(part)
    beat = log.agg(
        (F.max("ts") + F.make_dt_interval(secs=F.lit(max(horizon_seconds, span) + 2 * DELAY))).alias("ts")
    ).select(*[F.col("ts") if c == "ts" else F.lit(None).cast(log.schema[c].dataType).alias(c) for c in log.columns])
    return [*parts, beat], span


@query(FIRST_STABLE_SQL)
def stable_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = node_events(spark, sf_dir).select(
        "node", "event_id", F.col("ts").cast("timestamp").alias("ts"), "good"
    )
    slices, span = _slices(log, 12 * DAY)
    decided = replay(
        slices,
        lambda stream: stability.stable_stream(stream, 2 * DAY, 10 * DAY, DELAY, span),
        "stability",
    )
    return decided.where(F.col("node").isNotNull()).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(RETRY_SQL)
def retry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") == "purchase").alias("ok"),
    )
    slices, span = _slices(log, DAY)
    decided = replay(
        slices,
        lambda stream: stability.retry_stream(stream, DAY, DELAY, span),
        "retries",
    )
    return decided.where(F.col("key").isNotNull()).withColumn("at", F.col("at").cast("timestamp_ntz"))
