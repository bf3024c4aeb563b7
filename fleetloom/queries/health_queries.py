"""Queries over status tables, plans and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetloom.functions.columns import is_encrypted, version_gte
from fleetloom.operators import health
from fleetloom.plans import chains, drift, rollout
from fleetloom.queries.registry import FLEET_SQL, fleet, query, table

DAY = 86_400


def order_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as status rows of machines that belong to the customer's nation."""
    orders = table(spark, sf_dir, "orders")
    owners = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    unmet = F.array_compact(
        F.array(
            F.when(priority == "1-URGENT", F.struct(F.lit("nodeReady").alias("name"), F.lit("not registered").alias("reason"))),
            F.when(priority <= "2-HIGH", F.struct(F.lit("services").alias("name"), priority.alias("reason"))),
        )
    )
    return orders.join(owners, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("cluster_name"),
        F.concat(F.lit("m-"), F.col("o_orderkey")).alias("host"),
        F.when(status == "P", F.lit("control-plane")).otherwise(F.lit("worker")).alias("role"),
        F.when(status == "F", F.lit("running"))
        .when(status == "O", F.lit("maintenance"))
        .otherwise(F.lit("rebooting"))
        .alias("stage"),
        (priority != "1-URGENT").alias("ready"),
        unmet.alias("unmet"),
        F.sha2("o_orderpriority", 256).alias("running_schematic"),
        F.concat(F.lit("1.13."), F.year("o_orderdate") - 1990).alias("running_version"),
        F.when(F.col("o_totalprice") < 20000, F.lit("unreachable")).alias("error"),
    )


STATUS_SQL = """status AS (
  SELECT c_nationkey AS cluster_name, 'm-' || o_orderkey AS host,
         CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'O' THEN 'maintenance' ELSE 'rebooting' END AS stage,
         CASE o_orderstatus WHEN 'P' THEN 'control-plane' ELSE 'worker' END AS role,
         o_orderpriority <> '1-URGENT' AS ready, o_orderpriority AS priority,
         '1.13.' || (year(o_orderdate) - 1990) AS running_version,
         CASE WHEN o_totalprice < 20000 THEN 'unreachable' END AS error
  FROM orders JOIN customer ON o_custkey = c_custkey),
checked AS (
  SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN NOT ready THEN 'not ready'
                 WHEN stage = 'rebooting' THEN 'unprocessable stage' END AS reject_reason
  FROM status)"""


@query(f"WITH {STATUS_SQL} SELECT cluster_name, host, stage, ready, reject_reason FROM checked")
def preflight_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.preflight(order_status(spark, sf_dir)).select(
        "cluster_name", "host", "stage", "ready", "reject_reason"
    )


@query(
    f"""
    WITH {STATUS_SQL}, counted AS (
      SELECT cluster_name, stage, count(*) AS total, count(*) FILTER (reject_reason IS NULL) AS healthy,
             count(*) FILTER (reject_reason IS NULL AND stage = 'maintenance') AS maintenance
      FROM checked GROUP BY ALL)
    SELECT cluster_name || '/' || stage AS cluster_name, total, healthy,
           healthy > 0 AND healthy = maintenance AS all_maintenance,
           CASE WHEN healthy = 0 THEN 'abort: no healthy nodes'
                WHEN healthy < total THEN 'continue with healthy nodes' ELSE 'ok' END AS decision
    FROM counted
    """
)
def preflight_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = order_status(spark, sf_dir).withColumn(
        "cluster_name", F.concat("cluster_name", F.lit("/"), "stage")
    )
    return health.preflight_gate(health.preflight(grouped), skip_bad=True)


@query(
    f"""
    WITH {STATUS_SQL}
    SELECT cluster_name, host, CASE WHEN error IS NOT NULL THEN 'error: ' || error
             WHEN stage <> 'running' THEN 'stage is not running: ' || stage END AS problem
    FROM status
    """
)
def upgrade_precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.upgrade_precheck(order_status(spark, sf_dir)).select("cluster_name", "host", "problem")


@query(
    f"""
    WITH {STATUS_SQL}
    SELECT cluster_name, host, role, stage, CASE WHEN ready THEN '✓' ELSE '✗' END AS ready,
           CASE priority WHEN '1-URGENT' THEN 'nodeReady: not registered' || chr(10) || 'services: 1-URGENT'
             WHEN '2-HIGH' THEN 'services: 2-HIGH' ELSE '' END AS unmet,
           left(sha256(priority), 8) || '...' AS schematic, running_version AS version,
           coalesce(error, '') AS error
    FROM status
    """
)
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.status_report(order_status(spark, sf_dir))


@query(
    f"""
    WITH {STATUS_SQL}, placed AS (
      SELECT cluster_name, host || ': ' || error AS line, host,
             (row_number() OVER (PARTITION BY cluster_name ORDER BY host) - 1) // 10000 AS page
      FROM status WHERE error IS NOT NULL)
    SELECT cluster_name, CAST(page AS BIGINT) AS page, string_agg(line, chr(10) ORDER BY host) AS report
    FROM placed GROUP BY ALL
    """
)
def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.error_report(order_status(spark, sf_dir).select("cluster_name", "host", "error"))


_PLAN_SQL = """plan AS (
  SELECT o_custkey AS cluster_name, o_orderkey AS host, o_orderstatus AS desired_schematic,
         CAST(year(o_orderdate) AS VARCHAR) || '.0' AS desired_version,
         coalesce(l.status, '') AS running_schematic, l.version AS running_version
  FROM orders JOIN (SELECT l_orderkey, min(l_linestatus) AS status,
                           CAST(year(min(l_shipdate)) AS VARCHAR) || '.0' AS version
                    FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey)"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    desired = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("cluster_name"),
        F.col("o_orderkey").alias("host"),
        F.concat(
            F.lit("registry/metal-installer/"), "o_orderstatus", F.lit(":v"), F.year("o_orderdate"), F.lit(".0")
        ).alias("installer"),
    )
    running = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("host"))
        .agg(
            F.min("l_linestatus").alias("running_schematic"),
            F.concat(F.year(F.min("l_shipdate")), F.lit(".0")).alias("running_version"),
        )
    )
    return rollout.upgrade_plan(desired, running, ["host"])


@query(
    f"""
    WITH {_PLAN_SQL}
    SELECT host, desired_schematic, desired_version, running_schematic, running_version,
           CAST(NULL AS VARCHAR) AS error,
           running_version <> desired_version OR running_schematic <> desired_schematic AS needs_upgrade
    FROM plan
    """
)
def upgrade_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@query(
    f"""
    WITH {_PLAN_SQL}
    SELECT cluster_name,
           bool_or(running_version <> desired_version OR running_schematic <> desired_schematic) AS upgrade_required
    FROM plan GROUP BY 1
    """
)
def upgrade_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("host"), F.col("o_custkey").alias("cluster_name")
    )
    return rollout.upgrade_required(_plan(spark, sf_dir).join(owners, "host"))


_DRIFT_SQL = """desired AS (
  SELECT o_orderkey, 'spec.status' AS path, o_orderstatus AS value FROM orders
  UNION ALL SELECT o_orderkey, 'spec.priority', o_orderpriority FROM orders
  UNION ALL SELECT o_orderkey, 'spec.year', CAST(year(o_orderdate) AS VARCHAR) FROM orders),
lines AS (
  SELECT l_orderkey AS o_orderkey, min(l_linestatus) AS status, min(l_returnflag) AS flag,
         CAST(year(min(l_shipdate)) AS VARCHAR) AS ship FROM lineitem GROUP BY 1),
current AS (
  SELECT o_orderkey, 'spec.status' AS path, status AS value FROM lines
  UNION ALL SELECT o_orderkey, 'spec.flag', flag FROM lines
  UNION ALL SELECT o_orderkey, 'spec.year', ship FROM lines),
drift AS (
  SELECT coalesce(d.o_orderkey, c.o_orderkey) AS o_orderkey, coalesce(d.path, c.path) AS path,
         d.value AS desired, c.value AS current,
         CASE WHEN c.path IS NULL THEN 'added' WHEN d.path IS NULL THEN 'removed'
              WHEN d.value IS NOT DISTINCT FROM c.value THEN 'same' ELSE 'changed' END AS change
  FROM desired d FULL JOIN current c ON d.o_orderkey = c.o_orderkey AND d.path = c.path)"""


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.min("l_linestatus").alias("status"),
            F.min("l_returnflag").alias("flag"),
            F.year(F.min("l_shipdate")).cast("string").alias("ship"),
        )
    )

    def leaves(df: DataFrame, values: dict[str, str]) -> DataFrame:
        wide = df.select("o_orderkey", *[F.col(c).cast("string").alias(p) for p, c in values.items()])
        return wide.unpivot("o_orderkey", list(values), "path", "value")

    desired = leaves(
        orders.withColumn("year", F.year("o_orderdate")),
        {"spec_status": "o_orderstatus", "spec_priority": "o_orderpriority", "spec_year": "year"},
    )
    current = leaves(lines, {"spec_status": "status", "spec_flag": "flag", "spec_year": "ship"})
    dotted = F.replace("path", F.lit("_"), F.lit("."))
    return drift.config_drift(
        desired.withColumn("path", dotted), current.withColumn("path", dotted), ["o_orderkey"]
    )


_FEW_SQL = """WITH desired AS (
  SELECT o_orderkey, 'spec.status' AS path, o_orderstatus AS value FROM orders
  UNION ALL SELECT o_orderkey, 'spec.priority', o_orderpriority FROM orders
  UNION ALL SELECT o_orderkey, 'meta.year', CAST(year(o_orderdate) AS VARCHAR) FROM orders),
current AS (
  SELECT o_orderkey, path, CASE WHEN path = 'spec.status' AND o_orderkey % 100 = 7 THEN 'X' ELSE value END AS value
  FROM desired WHERE o_orderkey % 1000 <> 3
  UNION ALL SELECT o_orderkey, 'extra.flag', CAST(NULL AS VARCHAR) FROM orders WHERE o_orderkey % 500 = 11)
SELECT coalesce(d.o_orderkey, c.o_orderkey) AS o_orderkey, coalesce(d.path, c.path) AS path,
       d.value AS desired, c.value AS current,
       CASE WHEN c.path IS NULL THEN 'added' WHEN d.path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM desired d FULL JOIN current c ON d.o_orderkey = c.o_orderkey AND d.path = c.path
WHERE c.path IS NULL OR d.path IS NULL OR d.value IS DISTINCT FROM c.value"""


@query(_FEW_SQL)
def drift_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few orders differ: found by digests of whole documents, then of their parts."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    values = {"spec.status": F.col("o_orderstatus"), "spec.priority": F.col("o_orderpriority"), "meta.year": F.year("o_orderdate").cast("string")}
    leaves = F.inline(F.array(*[F.struct(F.lit(path).alias("path"), value.alias("value")) for path, value in values.items()]))
    desired = orders.select(key, leaves)
    other = F.when((F.col("path") == "spec.status") & (key % 100 == 7), F.lit("X")).otherwise(F.col("value"))
    current = desired.where(key % 1000 != 3).withColumn("value", other)
    extra = orders.where(key % 500 == 11).select(key, F.lit("extra.flag").alias("path"), F.lit(None).cast("string").alias("value"))
    return drift.drift_by_digest(desired, current.unionByName(extra), ["o_orderkey"])


@query(f"WITH {_DRIFT_SQL} SELECT * FROM drift")
def config_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir)


@query(
    f"WITH {_DRIFT_SQL} SELECT o_orderkey, bool_or(change <> 'same') AS changed FROM drift GROUP BY 1"
)
def drift_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.any_change(_drift(spark, sf_dir), ["o_orderkey"])


@query(
    """
    SELECT l_orderkey,
           coalesce(arg_max(l_linestatus || l_linenumber, (l_shipdate, l_partkey, l_suppkey, l_linenumber))
             FILTER (l_returnflag = 'R'), 'default') AS value
    FROM lineitem GROUP BY 1
    """
)
def pick_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.pick_value(
        table(spark, sf_dir, "lineitem"),
        ["l_orderkey"],
        F.concat("l_linestatus", "l_linenumber"),
        ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"],
        where=F.col("l_returnflag") == "R",
        default=F.lit("default"),
    )


@query(
    f"""
    WITH {FLEET_SQL}, totals AS (SELECT cluster_name, count(*) AS total,
             count(*) FILTER (role = 'control-plane' AND acctbal >= 0) AS leads FROM fleet GROUP BY 1),
    ranked AS (
      SELECT cluster_name, host, role,
             row_number() OVER (PARTITION BY cluster_name, role ORDER BY host) AS rn
      FROM fleet WHERE acctbal >= 0)
    SELECT r.cluster_name, host, role AS "group",
           CASE WHEN role = 'control-plane' THEN 1 ELSE greatest((total * 15 + 99) // 100, 1) END AS parallel,
           CASE WHEN role = 'control-plane' THEN rn
                ELSE leads + 1 + (rn - 1) // greatest((total * 15 + 99) // 100, 1) END AS wave
    FROM ranked r JOIN totals t ON t.cluster_name = r.cluster_name
    """
)
def rollout_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollout.rollout_waves(fleet(spark, sf_dir), "15%", F.col("acctbal") >= 0)


@query(
    """
    WITH runs AS (
      SELECT CAST(ts AS DATE) AS rollout_id, event_id AS host, ts AS start_ts,
             ts + to_minutes(CAST(floor(value) AS BIGINT)) AS end_ts, event_type = 'error' AS failed
      FROM events),
    failures AS (SELECT rollout_id, min(end_ts) AS first_failure FROM runs WHERE failed GROUP BY 1)
    SELECT r.rollout_id, host, start_ts, end_ts, failed, first_failure,
           coalesce(start_ts > first_failure, false) AS violation
    FROM runs r LEFT JOIN failures f ON f.rollout_id = r.rollout_id
    """
)
def stop_after_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("rollout_id"),
        F.col("event_id").alias("host"),
        F.col("ts").alias("start_ts"),
        (F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int"))).alias("end_ts"),
        (F.col("event_type") == "error").alias("failed"),
    )
    return rollout.audit_stop_after_failure(runs)


def node_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a status log: an ``error`` event means not ready."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("node"),
        "event_id",
        "ts",
        (F.col("event_type") != "error").alias("good"),
        F.col("event_type").alias("stage"),
    )


FIRST_STABLE_SQL = """
    WITH e AS (
      SELECT user_id AS node, ts, event_id, event_type = 'error' AS bad,
             sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)
               OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island
      FROM events),
    islands AS (
      SELECT node, island, min(ts) FILTER (NOT bad) AS began, min(ts) AS seen,
             lead(min(ts)) OVER (PARTITION BY node ORDER BY island) AS ended
      FROM e GROUP BY node, island),
    nodes AS (
      SELECT node, min(seen) AS t0,
             min(began) FILTER (ended IS NULL OR ended >= began + INTERVAL 2 DAY) + INTERVAL 2 DAY AS stable
      FROM islands GROUP BY node)
    SELECT node, CASE WHEN stable <= t0 + INTERVAL 10 DAY THEN 'stable' ELSE 'timeout' END AS outcome,
           CASE WHEN stable <= t0 + INTERVAL 10 DAY THEN stable ELSE t0 + INTERVAL 10 DAY END AS at
    FROM nodes"""


@query(FIRST_STABLE_SQL)
def first_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.first_stable(node_events(spark, sf_dir), 2 * DAY, 10 * DAY)


@query(
    """
    WITH n AS (SELECT user_id AS node, min(ts) AS t0, min(ts) FILTER (event_type = 'signup') AS hit
               FROM events GROUP BY 1)
    SELECT node, CASE WHEN hit <= t0 + INTERVAL 1 DAY THEN 'reached' ELSE 'timeout' END AS outcome,
           CASE WHEN hit <= t0 + INTERVAL 1 DAY THEN hit ELSE t0 + INTERVAL 1 DAY END AS at
    FROM n
    """
)
def first_in_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.first_in_stage(node_events(spark, sf_dir), "signup", DAY)


RETRY_SQL = """
    WITH n AS (SELECT user_id AS key, min(ts) AS t0, min(ts) FILTER (event_type = 'purchase') AS hit
               FROM events GROUP BY 1)
    SELECT key, CASE WHEN hit <= t0 + INTERVAL 1 DAY THEN 'success' ELSE 'gave up' END AS outcome,
           CASE WHEN hit <= t0 + INTERVAL 1 DAY THEN hit ELSE t0 + INTERVAL 1 DAY END AS at
    FROM n"""


@query(RETRY_SQL)
def retry_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), "ts", (F.col("event_type") == "purchase").alias("ok")
    )
    return health.retry_outcome(attempts, DAY)


@query(
    """
    WITH m AS (
      SELECT conv_id AS stream_id, turn AS seq,
             CASE role WHEN 'assistant' THEN 'exit_code' WHEN 'system' THEN 'other' ELSE 'message' END AS kind,
             CASE WHEN length(text) % 3 = 0 THEN 2 ELSE 0 END AS value
      FROM conversations),
    ends AS (SELECT stream_id, arg_min(value, seq) FILTER (kind = 'exit_code') AS code FROM m GROUP BY 1)
    SELECT stream_id, CASE WHEN code IS NULL THEN 'ended without result' WHEN code = 0 THEN 'ok'
                           ELSE 'failed with exit code ' || code END AS outcome
    FROM ends
    """
)
def stream_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("stream_id"),
        F.col("turn").alias("seq"),
        F.when(F.col("role") == "assistant", F.lit("exit_code"))
        .when(F.col("role") == "system", F.lit("other"))
        .otherwise(F.lit("message"))
        .alias("kind"),
        F.when(F.length("text") % 3 == 0, F.lit("2")).otherwise(F.lit("0")).alias("value"),
    )
    return health.stream_outcome(messages, messages)


@query(
    """
    WITH s AS (
      SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type,
             coalesce(arg_min(CAST(floor(value) AS BIGINT), (ts, event_id))
                        FILTER (CAST(floor(value) AS BIGINT) > 0), 0) AS members
      FROM events GROUP BY 1),
    states AS (
      SELECT user_id, members, CASE last_type WHEN 'view' THEN 'Preparing' WHEN 'click' THEN 'Waiting'
               WHEN 'error' THEN 'Failed' ELSE 'Running' END AS state FROM s)
    SELECT user_id, state, members,
           CASE WHEN state IN ('Preparing', 'Waiting') THEN 'bootstrap'
                WHEN state = 'Running' AND members > 0 THEN 'done' ELSE 'retry' END AS action
    FROM states
    """
)
def bootstrap_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", "event_type", F.floor("value").alias("members")
    )
    order = ["ts", "event_id"]
    last = health.pick_value(events, ["user_id"], F.col("event_type"), order, out="last_type")
    members = health.pick_value(
        events,
        ["user_id"],
        F.col("members"),
        order,
        where=F.col("members") > 0,
        default=F.lit(0).cast("bigint"),
        pick="first",
        out="members",
    )
    state = (
        F.when(F.col("last_type") == "view", F.lit("Preparing"))
        .when(F.col("last_type") == "click", F.lit("Waiting"))
        .when(F.col("last_type") == "error", F.lit("Failed"))
        .otherwise(F.lit("Running"))
    )
    return health.bootstrap_state(
        last.join(members, "user_id").select("user_id", state.alias("state"), "members")
    )


@query(
    f"""
    WITH {STATUS_SQL}
    SELECT cluster_name, host, running_version,
           CAST(string_split(running_version, '.')[3] AS INT) >= 7 AS lifecycle
    FROM status
    """
)
def upgrade_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which machines run a version that knows the newer upgrade call."""
    return order_status(spark, sf_dir).select(
        "cluster_name", "host", "running_version", version_gte("running_version", "1.13.7").alias("lifecycle")
    )


@query(
    f"""
    WITH {FLEET_SQL}, n AS (
      SELECT f.*, n_regionkey, acctbal >= 0 AS good, custkey % 7 = 0 AS pinned,
             'v1.' || (12 + n_regionkey % 2) || '.0' AS base_version FROM fleet f JOIN nation ON n_nationkey = cluster_name),
    wanted AS (
      SELECT *, CASE WHEN pinned THEN '1.11.5' ELSE substr(base_version, 2) END AS desired FROM n WHERE good),
    totals AS (SELECT cluster_name, count(*) AS total,
        count(*) FILTER (role = 'control-plane' AND desired <> '1.12.0') AS leads FROM wanted GROUP BY 1),
    ranked AS (
      SELECT cluster_name, host, role, row_number() OVER (PARTITION BY cluster_name, role ORDER BY host) AS rn
      FROM wanted WHERE desired <> '1.12.0')
    SELECT r.cluster_name, host,
           CASE WHEN role = 'control-plane' THEN rn
                ELSE leads + 1 + (rn - 1) // greatest((total * 20 + 99) // 100, 1) END AS wave,
           CAST(NULL AS VARCHAR) AS problem
    FROM ranked r JOIN totals t ON t.cluster_name = r.cluster_name
    UNION ALL
    SELECT cluster_name, host, NULL, 'stage is not running: booting' FROM n WHERE NOT good
    """
)
def upgrade_rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check, merge of the installer, plan and waves; nodes that fail the check are problems."""
    nodes = fleet(spark, sf_dir)
    nation = table(spark, sf_dir, "nation")

    def layer(df: DataFrame, scope: str, value, image) -> DataFrame:
        return df.select(
            "cluster_name",
            F.lit(scope).alias("scope"),
            value.cast("string").alias("scope_value"),
            F.lit("10-install.yaml").alias("layer_path"),
            F.lit(0).alias("doc_index"),
            F.array(F.lit("machine"), F.lit("install"), F.lit("image")).alias("path"),
            F.lit("string").alias("kind"),
            image.alias("value"),
        )

    shared = F.concat(F.lit("factory/metal-installer/abc:v1."), 12 + F.col("n_regionkey") % 2, F.lit(".0"))
    clusters = nation.withColumn("cluster_name", F.col("n_nationkey"))
    settings = layer(clusters, "all", F.lit(None), shared).unionByName(
        layer(nodes.where("custkey % 7 = 0"), "node", F.col("host"), F.lit("factory/metal-installer/abc:v1.11.5"))
    )
    status = nodes.select(
        "cluster_name",
        "host",
        F.when(F.col("acctbal") >= 0, F.lit("running")).otherwise(F.lit("booting")).alias("stage"),
        F.lit(None).cast("string").alias("error"),
        F.lit("1.12.0").alias("running_version"),
        F.lit("abc").alias("running_schematic"),
    )
    waves, problems = chains.upgrade_rollout(nodes.select("cluster_name", "host", "role"), settings, status, "20%")
    return waves.select("cluster_name", "host", "wave").unionByName(problems, allowMissingColumns=True)


@query(
    """
    SELECT o_orderkey, path, change, desired, current FROM (
      SELECT o_orderkey, 'token' AS path, 'changed' AS change, 'key=' || '*** redacted ***' AS desired, 'key=old' AS current
      FROM orders WHERE o_orderstatus = 'F'
      UNION ALL
      SELECT o_orderkey, 'priority', 'added', CASE WHEN o_orderpriority > '3' THEN '*** redacted ***' ELSE o_orderpriority END,
             NULL
      FROM orders WHERE o_orderstatus = 'O')
    """
)
def redacted_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of order settings; decrypted priorities above 3 and tokens are secrets."""
    orders = table(spark, sf_dir, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    leaf = lambda path, value, when: orders.where(when).select(
        "o_orderkey", F.lit(path).alias("path"), value.alias("value")
    )
    token = F.concat(F.lit("key=s3cr3t-"), F.col("o_orderkey") % 5)
    desired = leaf("token", token, status == "F").unionByName(leaf("priority", priority, status == "O"))
    current = leaf("token", F.lit("key=old"), status == "F").unionByName(leaf("state", status, F.lit(False)))
    secret = F.filter(F.array(F.concat(F.lit("s3cr3t-"), F.col("o_orderkey") % 5), F.when(priority > "3", priority)), lambda v: v.isNotNull())
    sealed = F.transform(secret, lambda v: F.concat(F.lit("ENC["), F.sha2(v, 256), F.lit("]")))
    document = lambda values: orders.select(
        F.col("o_orderkey").alias("file"), F.lit(0).alias("doc_index"), F.parse_json(F.to_json(F.struct(values.alias("v")))).alias("doc")
    )
    found = chains.redacted_drift(desired, current, ["o_orderkey"], document(sealed), document(secret), is_encrypted)
    return found.select("o_orderkey", "path", "change", "desired", "current")
