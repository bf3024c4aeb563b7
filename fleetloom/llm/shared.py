"""Steps that several operators share."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetloom.session import shared_path

#: Characters that separate words and that normalisation removes.
WHITE_SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write *df* to the shared folder and read it back: later readers see the same rows."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def total_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def in_blocks(docs: DataFrame, total: int, block_bytes: int) -> DataFrame:
    """``doc_id``, ``body`` (bytes), ``text_hash`` and ``block`` of each document, one shuffle.

    Blocks are drawn by a hash of ID and text, so copies of one text under many
    IDs spread out.  Their number follows *total*, the bytes of the corpus, so a
    block is a bounded amount of work.  Used several times in one plan, the shuffle
    is done once.
    """
    blocks = max(1, math.ceil(total / block_bytes))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (64 << 20)))
    marked = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("body"),
        F.xxhash64("text").alias("text_hash"),
    )
    block = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(blocks)).cast("int")
    return marked.withColumn("block", block).repartition(parts, "block")


def in_order(table: pa.Table) -> pa.Table:
    """A block's documents by ID, nulls last, and text: the same order in every pass."""
    ids = table.column("doc_id")
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    number = ids.fill_null(0).to_numpy(zero_copy_only=False)
    return table.take(np.lexsort((table.column("text_hash").to_numpy(), number, missing)))


def rank_by(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by the columns, and the number of each row's distinct value."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for column in columns:
        ordered = column[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    group = np.zeros(len(order), np.int64)
    group[order] = np.cumsum(new)
    return order, group


def fits_broadcast(rows: int, row_bytes: int, limit: int = 8 << 20) -> bool:
    """Whether a counted table is small enough to be sent to every executor."""
    return rows * row_bytes <= limit
