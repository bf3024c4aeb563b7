"""Replay of tables as file streams, used to run streaming operators to their end."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from fleetloom.session import shared_path

_PARTITIONS = "spark.sql.shuffle.partitions"


def replay(
    slices: Sequence[DataFrame], operator: Callable[[DataFrame], DataFrame], label: str
) -> DataFrame:
    """Feed *slices* one after the other to a streaming *operator*; return its output.

    Every slice is written to the stream's folder and consumed with one
    ``availableNow`` run on the same checkpoint, as a restarted job would.  State is
    kept in at most two stores per core: more would only add to every trigger.
    """
    spark = slices[0].sparkSession
    partitions = spark.conf.get(_PARTITIONS)
    stores = min(int(partitions), 2 * spark.sparkContext.defaultParallelism)
    source, sink, progress = (
        shared_path(spark, f"{label}-{part}") for part in ("source", "sink", "progress")
    )
    schema = slices[0].schema
    for part in slices:
        part.write.mode("append").parquet(source)
        output = operator(spark.readStream.schema(schema).parquet(source))
        writer = (
            output.writeStream.format("parquet")
            .option("path", sink)
            .option("checkpointLocation", progress)
            .outputMode("append")
            .trigger(availableNow=True)
        )
        # A query keeps the settings it was started with.
        spark.conf.set(_PARTITIONS, stores)
        try:
            running = writer.start()
        finally:
            spark.conf.set(_PARTITIONS, partitions)
        running.awaitTermination()
    return spark.read.schema(output.schema).parquet(sink)
