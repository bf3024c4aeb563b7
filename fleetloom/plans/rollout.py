"""Upgrade plans, rollout waves and the stop-after-failure audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetloom.functions.columns import effective_parallel, is_control_plane, parse_ref, role_rank
from fleetloom.operators.ordered import ordinals


def upgrade_plan(desired: DataFrame, running: DataFrame, keys: list[str]) -> DataFrame:
    """Compare the desired ``installer`` with the running version and schematic.

    ``needs_upgrade`` is plain inequality; unlike in fallbacks an empty value is
    a value here.  Unreadable references give an ``error`` instead.
    """
    parsed = desired.select(*keys, "installer", parse_ref("installer").alias("_want"))
    joined = parsed.join(running.select(*keys, "running_version", "running_schematic"), keys, "inner")
    running_version = F.coalesce("running_version", F.lit(""))
    running_schematic = F.coalesce("running_schematic", F.lit(""))
    return joined.select(
        *keys,
        F.col("_want.schematic").alias("desired_schematic"),
        F.col("_want.version").alias("desired_version"),
        running_schematic.alias("running_schematic"),
        running_version.alias("running_version"),
        F.col("_want.error").alias("error"),
        (
            (running_version != F.col("_want.version"))
            | (running_schematic != F.col("_want.schematic"))
        ).alias("needs_upgrade"),
    )


def upgrade_required(plan: DataFrame) -> DataFrame:
    """Per cluster, does anything need an upgrade?"""
    return plan.groupBy("cluster_name").agg(
        F.coalesce(F.bool_or("needs_upgrade"), F.lit(False)).alias("upgrade_required")
    )


def rollout_waves(processed: DataFrame, spec: Column | str, selected: Column | None = None) -> DataFrame:
    """Static waves: control-plane one by one first, then workers *n* at a time.

    *spec* is a text such as ``"5"`` or ``"25%"``, or a column holding one.
    *n* is resolved on every processed node of the cluster, also those that
    *selected* leaves out of the plan.  Positions come from range-partitioned
    ordinals, so a cluster of any size is ranked by many tasks.  A *spec* that is
    no positive integer or percentage is an error.
    """
    picked = F.lit(True) if selected is None else F.coalesce(selected, F.lit(False))
    nodes = processed.select(
        "cluster_name", "host", role_rank().alias("_rank"), is_control_plane().alias("_lead"), picked.alias("_picked")
    )
    totals = nodes.groupBy("cluster_name").agg(
        F.count(F.lit(1)).alias("_total"),
        F.count_if(F.col("_picked") & F.col("_lead")).alias("_leads"),
    )
    ranked = ordinals(nodes.where("_picked"), ["cluster_name", "_rank"], ["host"], "_rn")
    sized = ranked.join(totals, "cluster_name").withColumn(
        "parallel",
        F.coalesce(
            effective_parallel("_total", F.lit(spec)),
            F.raise_error(F.concat(F.lit("invalid concurrency: "), F.coalesce(F.lit(spec), F.lit("null")))).cast("bigint"),
        ),
    )
    worker_wave = F.col("_leads") + 1 + F.call_function("div", F.col("_rn") - 1, F.col("parallel"))
    return sized.select(
        "cluster_name",
        "host",
        F.when(F.col("_lead"), F.lit("control-plane")).otherwise(F.lit("worker")).alias("group"),
        F.when(F.col("_lead"), F.lit(1).cast("bigint")).otherwise(F.col("parallel")).alias("parallel"),
        F.when(F.col("_lead"), F.col("_rn")).otherwise(worker_wave).alias("wave"),
    )


def audit_stop_after_failure(runs: DataFrame) -> DataFrame:
    """Flag work that started after its rollout had recorded a failure."""
    failures = (
        runs.where(F.col("failed"))
        .groupBy("rollout_id")
        .agg(F.min("end_ts").alias("first_failure"))
    )
    return runs.join(failures, "rollout_id", "left").withColumn(
        "violation", F.coalesce(F.col("start_ts") > F.col("first_failure"), F.lit(False))
    )
