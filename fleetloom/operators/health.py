"""Node status: classification, gates, tallies, reports and event-log outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetloom.functions.columns import shorten
from fleetloom.operators.ordered import pages, running_total

# Stages in which a node may be processed or upgraded.
PROCESSABLE_STAGES = ("running", "maintenance", "booting")
UPGRADE_STAGE = "running"
BOOTSTRAP_STATES = ("Preparing", "Waiting")


def preflight(status: DataFrame, allow_not_ready: bool = False) -> DataFrame:
    """Add ``reject_reason``: the first of error, not ready, stage that applies."""
    has_error = F.col("error").isNotNull()
    not_ready = F.lit(not allow_not_ready) & ~F.coalesce(F.col("ready"), F.lit(False))
    bad_stage = ~F.coalesce(F.col("stage").isin(*PROCESSABLE_STAGES), F.lit(False))
    return status.withColumn(
        "reject_reason",
        F.when(has_error, F.lit("error"))
        .when(not_ready, F.lit("not ready"))
        .when(bad_stage, F.lit("unprocessable stage")),
    )


def upgrade_precheck(status: DataFrame) -> DataFrame:
    """Add ``problem`` for nodes that stop an upgrade."""
    wrong_stage = ~F.coalesce(F.col("stage") == UPGRADE_STAGE, F.lit(False))
    return status.withColumn(
        "problem",
        F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), F.col("error"))).when(
            wrong_stage,
            F.concat(F.lit("stage is not running: "), F.coalesce("stage", F.lit("unknown"))),
        ),
    )


def preflight_gate(checked: DataFrame, skip_bad: bool = False) -> DataFrame:
    """One decision per cluster from the rows of :func:`preflight`."""
    healthy = F.col("reject_reason").isNull()
    counted = checked.groupBy("cluster_name").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(healthy).alias("healthy"),
        F.count_if(healthy & (F.col("stage") == "maintenance")).alias("_maintenance"),
    )
    some_bad = F.lit("continue with healthy nodes" if skip_bad else "abort: some nodes failed")
    return counted.select(
        "cluster_name",
        "total",
        "healthy",
        ((F.col("healthy") > 0) & (F.col("_maintenance") == F.col("healthy"))).alias(
            "all_maintenance"
        ),
        F.when(F.col("healthy") == 0, F.lit("abort: no healthy nodes"))
        .when(F.col("healthy") < F.col("total"), some_bad)
        .otherwise(F.lit("ok"))
        .alias("decision"),
    )


def status_report(status: DataFrame) -> DataFrame:
    """Display columns: ready mark, unmet conditions as lines, shortened schematic."""
    lines = F.transform("unmet", lambda c: F.concat(c["name"], F.lit(": "), c["reason"]))
    return status.select(
        "cluster_name",
        "host",
        "role",
        "stage",
        F.when(F.coalesce("ready", F.lit(False)), F.lit("✓")).otherwise(F.lit("✗")).alias("ready"),
        F.coalesce(F.array_join(lines, "\n"), F.lit("")).alias("unmet"),
        shorten("running_schematic").alias("schematic"),
        F.col("running_version").alias("version"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


def outcome_tally(outcomes: DataFrame, outcome_col: str = "outcome") -> DataFrame:
    return outcomes.groupBy("cluster_name").agg(
        *[F.count_if(F.col(outcome_col) == name).alias(name) for name in ("success", "skip", "fail")]
    )


def error_report(rows: DataFrame, page_size: int = 10_000) -> DataFrame:
    """All errors of a cluster as ``host: error`` lines in host order, paged."""
    failed = rows.where(F.col("error").isNotNull())
    line = F.concat(F.col("host"), F.lit(": "), F.col("error"))
    listed = pages(failed, ["cluster_name"], ["host"], line, page_size, "_lines")
    return listed.select("cluster_name", "page", F.array_join("_lines", "\n").alias("report"))


def pick_value(
    rows: DataFrame,
    keys: Sequence[str],
    value: Column,
    order_by: Sequence[str],
    where: Column | None = None,
    default: Column | None = None,
    pick: str = "last",
    out: str = "value",
) -> DataFrame:
    """First or last *value* per key among rows that satisfy *where*, else *default*."""
    order = F.struct(*order_by)
    if where is not None:
        order = F.when(where, order)
    chosen = F.max_by(value, order) if pick == "last" else F.min_by(value, order)
    if default is not None:
        chosen = F.coalesce(chosen, default)
    return rows.groupBy(*keys).agg(chosen.alias(out))


def bootstrap_state(status: DataFrame) -> DataFrame:
    """Add ``action`` from the service ``state`` and its ``members`` count."""
    return status.withColumn(
        "action",
        F.when(F.col("state").isin(*BOOTSTRAP_STATES), F.lit("bootstrap"))
        .when((F.col("state") == "Running") & (F.col("members") > 0), F.lit("done"))
        .otherwise(F.lit("retry")),
    )


def stream_outcome(messages: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    """Result of each progress stream: its first terminal message decides.

    Terminal kinds are ``exit_code`` and ``name``.  Streams listed in *streams*
    but absent from *messages* ended without a result as well.
    """
    terminal = F.col("kind").isin("exit_code", "name")
    decided = messages.groupBy("stream_id").agg(
        F.min_by(F.struct("kind", "value"), F.when(terminal, F.col("seq"))).alias("_end")
    )
    if streams is not None:
        decided = streams.select("stream_id").distinct().join(decided, "stream_id", "left")
    ok = (F.col("_end.kind") == "name") | (F.col("_end.value").try_cast("int") == 0)
    return decided.select(
        "stream_id",
        F.when(F.col("_end").isNull(), F.lit("ended without result"))
        .when(ok, F.lit("ok"))
        .otherwise(F.concat(F.lit("failed with exit code "), F.col("_end.value")))
        .alias("outcome"),
    )


def first_stable(events: DataFrame, quiet_seconds: int, deadline_seconds: int) -> DataFrame:
    """When each node first stayed good for *quiet_seconds*, or timed out.

    Events are ``(node, event_id, ts, good)``.  A bad event restarts the wait, the
    next good one begins it again; no event at all counts as good.  Bad events
    are numbered with a running total that cuts a noisy node into slices; all
    the rest are aggregates with a map-side part.
    """
    bad = F.when(F.coalesce(F.col("good"), F.lit(False)), F.lit(0)).otherwise(F.lit(1))
    marked = running_total(
        events.select("node", "event_id", "ts", bad.alias("_bad")),
        ["node"],
        ["ts", "event_id"],
        F.col("_bad"),
        "_island",
    )
    # A bad event opens island n and ends island n - 1.
    ends = F.when(
        F.col("_bad") == 1,
        F.array(
            F.struct(F.col("_island").alias("island"), F.lit(False).alias("ends")),
            F.struct((F.col("_island") - 1).alias("island"), F.lit(True).alias("ends")),
        ),
    ).otherwise(
        F.array(F.struct(F.col("_island").alias("island"), F.lit(False).alias("ends")))
    )
    islands = (
        marked.select("node", "ts", "_bad", F.explode(ends).alias("i"))
        .groupBy("node", F.col("i.island").alias("island"))
        .agg(
            F.min(F.when(F.col("_bad") == 0, F.col("ts"))).alias("began"),
            F.min(F.when(F.col("i.ends"), F.col("ts"))).alias("ended"),
            F.min("ts").alias("seen"),
        )
    )
    quiet = F.make_dt_interval(secs=F.lit(quiet_seconds))
    limit = F.make_dt_interval(secs=F.lit(deadline_seconds))
    held = F.col("ended").isNull() | (F.col("ended") >= F.col("began") + quiet)
    per_node = islands.groupBy("node").agg(
        F.min("seen").alias("_t0"),
        (F.min(F.when(held, F.col("began"))) + quiet).alias("_stable"),
    )
    in_time = F.coalesce(F.col("_stable") <= F.col("_t0") + limit, F.lit(False))
    return per_node.select(
        "node",
        F.when(in_time, F.lit("stable")).otherwise(F.lit("timeout")).alias("outcome"),
        F.when(in_time, F.col("_stable")).otherwise(F.col("_t0") + limit).alias("at"),
    )


def first_matching(
    rows: DataFrame,
    key: str,
    ts: str,
    matches: Column,
    budget_seconds: int,
    reached: str,
    missed: str,
) -> DataFrame:
    """First matching row per key within a budget counted from the key's first row."""
    limit = F.make_dt_interval(secs=F.lit(budget_seconds))
    first = rows.groupBy(key).agg(
        F.min(ts).alias("_t0"), F.min(F.when(matches, F.col(ts))).alias("_hit")
    )
    in_time = F.coalesce(F.col("_hit") <= F.col("_t0") + limit, F.lit(False))
    return first.select(
        key,
        F.when(in_time, F.lit(reached)).otherwise(F.lit(missed)).alias("outcome"),
        F.when(in_time, F.col("_hit")).otherwise(F.col("_t0") + limit).alias("at"),
    )


def first_in_stage(events: DataFrame, stage: str, deadline_seconds: int) -> DataFrame:
    """When each node first reached *stage*, or timed out."""
    return first_matching(
        events, "node", "ts", F.col("stage") == stage, deadline_seconds, "reached", "timeout"
    )


def retry_outcome(attempts: DataFrame, budget_seconds: int) -> DataFrame:
    """Success at the first good attempt, or giving up when the budget is spent."""
    return first_matching(
        attempts, "key", "ts", F.col("ok"), budget_seconds, "success", "gave up"
    )
