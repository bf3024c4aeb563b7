"""Running totals, ranks and pages that never gather one key in one task.

A plain window sorts all rows of a key in a single task, which fails when one
key holds a third of the table.  Here each key is cut into ordered slices; a
window runs inside a slice, and the totals of earlier slices are added from a
small table of one row per key and slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetloom.session import cut_lineage


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    value: Column,
    out: str,
) -> DataFrame:
    """Inclusive running sum of *value* per key.

    Slices are even whatever the data, and the partition number is the slice.
    """
    keys, order = list(keys), [*order_by, "_tie"]
    sliced = _ranged(df.withColumn("_value", value.cast("bigint")), keys, order_by)
    sliced = cut_lineage(sliced.withColumn("_slice", F.spark_partition_id()))
    inside = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = (
        W.partitionBy(*[f"_p_{k}" for k in keys])
        .orderBy("_p_slice")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    prefix = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.sum("_value").alias("_sum"))
        .select(
            *[F.col(k).alias(f"_p_{k}") for k in keys], F.col("_slice").alias("_p_slice"), "_sum"
        )
        .withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    condition = F.col("_slice") == F.col("_p_slice")
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_p_{key}"))
    return (
        sliced.withColumn("_local", F.sum("_value").over(inside))
        .join(prefix, condition, "inner")
        .select(*df.columns, (F.col("_local") + F.col("_before")).alias(out))
    )


def ordinals(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], out: str) -> DataFrame:
    """1-based position of each row inside its key, for any sortable order.

    Rows are sorted where the range partitioning has put them, and their number in
    the partition gives the position inside the slice, so rows are shuffled once.
    The table of slices, one row per key and partition, is joined by its size.
    """
    keys = list(keys)
    sorted_rows = _ranged(df, keys, order_by).sortWithinPartitions(*keys, *order_by, "_tie")
    # The upper bits of this number are the partition, the lower ones count its rows.
    rows = cut_lineage(sorted_rows.withColumn("_at", F.monotonically_increasing_id()).drop("_tie"))
    rows = rows.withColumn("_slice", F.shiftright("_at", 33).cast("int"))
    before = W.partitionBy(*[f"_p_{k}" for k in keys]).orderBy("_p_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = (
        rows.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_p_first"))
        .select(*[F.col(k).alias(f"_p_{k}") for k in keys], F.col("_slice").alias("_p_slice"), "_rows", "_p_first")
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    condition = F.col("_slice") == F.col("_p_slice")
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_p_{key}"))
    position = F.col("_at") - F.col("_p_first") + F.col("_before") + 1
    return rows.join(slices, condition, "inner").select(*df.columns, position.alias(out))


def _ranged(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """*df* in even ranges of key and order, with a number ``_tie`` that tells equal rows apart.

    The number counts sorted rows, so that a task run again after a lost executor
    places them the same.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return (
        df.sortWithinPartitions(*keys, *order_by, F.xxhash64(*plain))
        .withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, *keys, *order_by, "_tie")
    )


def pages(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    item: Column,
    page_size: int,
    out: str,
) -> DataFrame:
    """Ordered lists per key, cut into pages of at most *page_size* entries.

    A key with no more rows than that has exactly one page; longer ones get
    more rows instead of one row that no task could hold.
    """
    ranked = ordinals(df, keys, order_by, "_rn")
    return (
        ranked.withColumn("page", F.call_function("div", F.col("_rn") - 1, F.lit(page_size)))
        .groupBy(*keys, "page")
        .agg(F.sort_array(F.collect_list(F.struct("_rn", item.alias("item")))).alias("_items"))
        .select(*keys, "page", F.transform("_items", lambda e: e["item"]).alias(out))
    )
