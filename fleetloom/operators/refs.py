"""References to definitions, content-addressed IDs and once-per-key work."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from fleetloom.functions.columns import col_of
from fleetloom.session import cut_lineage


def content_id(text: Column | str) -> Column:
    """SHA-256 of a canonical document text."""
    return F.sha2(col_of(text).cast("binary"), 256)


def once_per_key(
    df: DataFrame, keys: Sequence[str], work: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Run *work* on the distinct keys only and join its columns back; null is a key too."""
    done = work(df.select(*keys).distinct())
    added = [c for c in done.columns if c not in keys]
    # As one struct of keys, nulls equal each other.
    done = done.select(F.struct(*keys).alias("_once_key"), *added)
    keyed = df.withColumn("_once_key", F.struct(*keys))
    return keyed.join(done, "_once_key", "left").select(*df.columns, *added)


def once_ever(
    df: DataFrame, keys: Sequence[str], work: Callable[[DataFrame], DataFrame], folder: str, run: str
) -> DataFrame:
    """:func:`once_per_key` with results kept in *folder*: *work* sees only keys that no earlier run had.

    Adds the columns of *work* and ``done_in``, the name of the run that did the work.  Kept rows are
    addressed by the digest of their key, so the keys themselves are not kept; null is a key too.
    A run that dies leaves whole results or none of a key, and the next one does what
    is missing.  Of results that two runs at a time have added, that of the least run name counts.
    The folder belongs to one kind of work; each run adds files of its own to it.
    """
    spark = df.sparkSession
    address = content_id(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    wanted = df.select(*keys).distinct()
    try:
        known = spark.read.parquet(folder).select("_id")
        # A broken-off first run leaves a folder without any file of results.
    except AnalysisException as absent:
        if absent.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        known = spark.createDataFrame([], "_id string")
    fresh = cut_lineage(wanted.withColumn("_id", address).join(known, "_id", "left_anti").drop("_id"))
    done = work(fresh)
    added = [c for c in done.columns if c not in keys]
    kept = done.select(address.alias("_id"), *added, F.lit(run).alias("done_in"))
    kept.write.mode("append").parquet(folder)
    every = spark.read.schema(kept.schema).parquet(folder)
    results = every.groupBy("_id").agg(F.min_by(F.struct(*added), "done_in").alias("_row"), F.min("done_in").alias("done_in"))
    joined = df.withColumn("_id", address).join(results, "_id", "left")
    return joined.select(*df.columns, *[F.col("_row")[c].alias(c) for c in added], "done_in")


def resolve_refs(
    nodes: DataFrame, definitions: DataFrame, ref_col: str, row_key: Sequence[str]
) -> DataFrame:
    """Resolve ``@path`` references to the ID of their definition.

    Adds ``resolved_id`` and ``error``.  Plain IDs pass through; they join on a
    key of their own row that no path can equal, so they do not pile up in one
    task the way null keys would.  A path that is defined twice in different ways
    is an error of the nodes that refer to it.
    """
    ref = F.col(ref_col)
    is_path = F.coalesce(F.startswith(ref, F.lit("@")), F.lit(False))
    own_key = F.concat_ws("\u0000", F.lit(""), *[F.col(k).cast("string") for k in row_key])
    ids = (
        definitions.select(F.col("path").alias("_path"), content_id("definition").alias("_id"))
        .groupBy("_path")
        .agg(F.min("_id").alias("_id"), (F.min("_id") != F.max("_id")).alias("_several"))
    )
    keyed = nodes.withColumn(
        "_path", F.when(is_path, F.substring(ref, F.lit(2), F.length(ref))).otherwise(own_key)
    )
    joined = keyed.join(ids, "_path", "left")
    return joined.select(
        *nodes.columns,
        F.when(is_path, F.when(~F.col("_several"), F.col("_id"))).otherwise(ref).alias("resolved_id"),
        F.when(
            is_path & F.col("_id").isNull(),
            F.concat(F.lit("definition not found: "), F.col("_path")),
        )
        .when(is_path & F.col("_several"), F.concat(F.lit("several definitions: "), F.col("_path")))
        .alias("error"),
    )


def missing_definitions(nodes: DataFrame, definitions: DataFrame, ref_col: str) -> DataFrame:
    """Distinct referenced paths without a definition."""
    ref = F.col(ref_col)
    wanted = (
        nodes.where(F.startswith(ref, F.lit("@")))
        .select(F.substring(ref, F.lit(2), F.length(ref)).alias("path"))
        .distinct()
    )
    return wanted.join(definitions.select("path"), "path", "left_anti")
