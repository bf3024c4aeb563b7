"""Whole chains over the other plans: upgrade rollout and redacted drift."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from fleetloom.operators.health import upgrade_precheck
from fleetloom.operators.layers import merged_settings
from fleetloom.operators.nested import extract_changed
from fleetloom.operators.redact import redact_columns, secret_set
from fleetloom.plans.drift import config_drift
from fleetloom.plans.render import INSTALLER_PATH
from fleetloom.plans.rollout import rollout_waves, upgrade_plan


def upgrade_rollout(
    nodes: DataFrame, settings: DataFrame, status: DataFrame, spec: Column | str
) -> tuple[DataFrame, DataFrame]:
    """(waves, problems) of an upgrade of ``nodes(cluster_name, host, role)``.

    The wanted installer is what the layers in *settings* merge to.  *status* is
    ``(cluster_name, host, stage, error, running_version, running_schematic)``.  A
    node that fails the check before, or whose installer cannot be read, is a problem and
    takes no part; concurrency is resolved on all nodes that passed the check.
    """
    key = ["cluster_name", "host"]
    checked = upgrade_precheck(nodes.join(status, key, "left"))
    passed = checked.where(F.col("problem").isNull())
    image = F.col("path") == F.array(*map(F.lit, INSTALLER_PATH))
    merged = merged_settings(passed.select(*key, "role"), settings).where(image)
    desired = merged.select(*key, F.col("value").alias("installer"))
    plan = upgrade_plan(desired, status, key)
    wanted = passed.join(plan.select(*key, "needs_upgrade", F.col("error").alias("_unread")), key, "left")
    wanted = wanted.withColumn("_unread", F.coalesce("_unread", F.when(F.col("needs_upgrade").isNull(), F.lit("no installer"))))
    problems = checked.where(F.col("problem").isNotNull()).select(*key, "problem").unionByName(
        wanted.where(F.col("_unread").isNotNull()).select(*key, F.col("_unread").alias("problem"))
    )
    waves = rollout_waves(wanted, spec, F.col("needs_upgrade") & F.col("_unread").isNull())
    return waves, problems


def redacted_drift(
    desired: DataFrame,
    current: DataFrame,
    keys: list[str],
    before: DataFrame,
    after: DataFrame,
    predicate: Callable[[Column], Column],
    *more_secrets: DataFrame,
) -> DataFrame:
    """Differences of two leaf tables in which no known secret can be read.

    Secrets are the decrypted values of *before* and *after* (see
    ``extract_changed``) and *more_secrets*.  Values are compared as they are and
    redacted afterwards, so a changed secret still shows as a change.
    """
    secrets = secret_set(extract_changed(before, after, predicate).select("secret"), *more_secrets)
    drift = config_drift(desired, current, keys).where(F.col("change") != "same")
    return redact_columns(drift, ["desired", "current"], secrets)
