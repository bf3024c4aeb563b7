"""Differences between desired and current settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetloom.session import cut_lineage

#: Documents that differ are sent to all tasks up to this many; of more, a bitmap of their hashes.
SENT_KEYS = 100_000
#: Bits of that bitmap for each document, and in all, as a power of two.
_BITS_EACH, _MOST_BITS = 16, 28


def config_drift(desired: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer comparison of two leaf tables ``(keys, path, value)``.

    ``change`` is added (only desired), removed (only current), changed or same.
    Null keys are keys like others.
    """
    on = [*keys, "path"]
    # As one struct of keys, nulls equal each other.
    key = F.struct(*on).alias("_key")
    left = desired.select(key, F.col("value").alias("desired"), F.lit(True).alias("_d"))
    right = current.select(key, F.col("value").alias("current"), F.lit(True).alias("_c"))
    joined = left.join(right, "_key", "full")
    return joined.select(
        *[F.col("_key")[name].alias(name) for name in on],
        "desired",
        "current",
        F.when(F.col("_c").isNull(), F.lit("added"))
        .when(F.col("_d").isNull(), F.lit("removed"))
        .when(F.col("desired").eqNullSafe(F.col("current")), F.lit("same"))
        .otherwise(F.lit("changed"))
        .alias("change"),
    )


def any_change(drift: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, did a dry run find anything to change?"""
    return drift.groupBy(*keys).agg(F.bool_or(F.col("change") != "same").alias("changed"))


def _digests(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """Count of leaves and 128 bits that depend on which leaves there are, not on their order, per key."""
    parts = []
    for seed in (1, 2):
        hashed = F.xxhash64(F.lit(seed), F.size("path") if _is_list(leaves) else F.lit(0), "path", F.col("value").isNull(), "value")
        parts += [F.sum(hashed.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(hashed, 32))]
    return leaves.groupBy(*keys).agg(F.struct(F.count(F.lit(1)), *parts).alias("digest"))


def _is_list(leaves: DataFrame) -> bool:
    return dict(leaves.dtypes)["path"].startswith("array")


def document_digests(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, digest)``: equal for documents with the same leaves.

    Partial sums are made where the leaves are read, so one row per document and
    task is shuffled.  Digests may be kept and passed to :func:`drift_by_digest`.
    """
    return _digests(leaves, keys)


def _differing(desired: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digests differ or that only one side has."""
    key = F.struct(*keys).alias("_key")
    left = desired.select(key, F.col("digest").alias("_desired"))
    both = left.join(current.select(key, F.col("digest").alias("_current")), "_key", "full")
    return both.where(~F.col("_desired").eqNullSafe(F.col("_current"))).select("_key")


def _only(leaves: DataFrame, keys: list[str], wanted: DataFrame, count: int) -> DataFrame:
    """Leaves of the *wanted* keys, of which there are *count*; others are dropped where they are read."""
    keyed = leaves.withColumn("_key", F.struct(*keys))
    if count <= SENT_KEYS:
        return keyed.join(F.broadcast(wanted), "_key", "left_semi").drop("_key")
    bits = 1 << min(max((count * _BITS_EACH).bit_length(), 16), _MOST_BITS)
    place = lambda key: F.pmod(F.xxhash64(key), F.lit(bits))
    # One row of 4 KB for every 32,768 places.
    filled = wanted.select(place("_key").alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket"))
    filled = filled.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bitmap"))
    marked = keyed.withColumn("_place", place("_key")).withColumn("_bucket", F.bitmap_bucket_number("_place"))
    likely = marked.join(F.broadcast(filled), "_bucket").where(_bit("_bitmap", F.bitmap_bit_position("_place")))
    return likely.drop("_place", "_bucket", "_bitmap").join(wanted, "_key", "left_semi").drop("_key")


def _bit(bitmap: str, position: Column) -> Column:
    """Whether a bit of a bitmap is set; the first bit of a byte is its lowest."""
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.call_function("div", position, F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10)
    return F.call_function("getbit", byte.cast("int"), F.pmod(position, F.lit(8)).cast("int")) == 1


def drift_by_digest(
    desired: DataFrame,
    current: DataFrame,
    keys: list[str],
    desired_digests: DataFrame | None = None,
    current_digests: DataFrame | None = None,
) -> DataFrame:
    """The rows of :func:`config_drift` whose change is not ``same``, found from the top of a digest tree.

    Digests of whole documents are compared first, then those of the parts below each top-level key, and
    only leaves of parts that differ are joined.  Of documents that are equal nothing but their
    digest is shuffled.  Paths, arrays or dotted texts, occur once per document.
    """
    wanted = cut_lineage(
        _differing(
            document_digests(desired, keys) if desired_digests is None else desired_digests,
            document_digests(current, keys) if current_digests is None else current_digests,
            keys,
        )
    )
    count = wanted.count()
    top = F.get("path", F.lit(0)) if _is_list(desired) else F.substring_index("path", ".", 1)
    parts = [*keys, "_part"]
    sides = [cut_lineage(_only(side, keys, wanted, count).withColumn("_part", top)) for side in (desired, current)]
    differing = _differing(*(_digests(side, parts) for side in sides), parts)
    left, right = (
        side.withColumn("_key", F.struct(*parts)).join(differing, "_key", "left_semi").drop("_key", "_part") for side in sides
    )
    return config_drift(left, right, keys).where(F.col("change") != "same")
