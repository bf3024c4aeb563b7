import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetloom.operators import health
from fleetloom.streaming import stability
from fleetloom.queries import QUERIES
from fleetloom.streaming import replay as replay_module
from fleetloom.streaming.replay import replay

STATUS = (
    "cluster_name string, host string, role string, stage string, ready boolean, "
    "unmet array<struct<name:string,reason:string>>, running_schematic string, "
    "running_version string, error string"
)
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def status(spark):
    rows = [
        ("a", "ok", "worker", "running", True, [], "s" * 9, "1.2", None),
        ("a", "down", "worker", "running", True, None, None, None, "refused"),
        ("a", "sick", "worker", "running", False, [("x", "y"), ("z", "w")], "s" * 8, "1.2", None),
        ("a", "odd", "worker", "upgrading", True, [], "", "", None),
        ("b", "new", "worker", "maintenance", True, [], "s", "1", None),
        ("c", "late", "worker", "booting", None, [], "s", "1", None),
    ]
    return spark.createDataFrame(rows, STATUS)


def test_preflight(status):
    got = {r.host: r.reject_reason for r in health.preflight(status).collect()}
    assert got == {
        "ok": None,
        "down": "error",
        "sick": "not ready",
        "odd": "unprocessable stage",
        "new": None,
        "late": "not ready",
    }
    lenient = {r.host for r in health.preflight(status, True).where("reject_reason is null").collect()}
    assert lenient == {"ok", "sick", "new", "late"}


def test_gate(status):
    gate = {r.cluster_name: (r.decision, r.all_maintenance) for r in health.preflight_gate(health.preflight(status)).collect()}
    assert gate == {
        "a": ("abort: some nodes failed", False),
        "b": ("ok", True),
        "c": ("abort: no healthy nodes", False),
    }
    skipping = health.preflight_gate(health.preflight(status), skip_bad=True)
    assert {r.cluster_name: r.decision for r in skipping.collect()}["a"] == "continue with healthy nodes"


def test_upgrade_precheck_reports_every_problem(status):
    got = {r.host: r.problem for r in health.upgrade_precheck(status).collect()}
    assert got["ok"] is None and got["sick"] is None
    assert got["down"] == "error: refused"
    assert got["new"] == "stage is not running: maintenance"


def test_status_report(status):
    rows = {r.host: r for r in health.status_report(status).collect()}
    assert (rows["ok"].ready, rows["ok"].schematic, rows["ok"].unmet) == ("✓", "ssssssss...", "")
    assert (rows["sick"].ready, rows["sick"].schematic, rows["sick"].unmet) == ("✗", "ssssssss", "x: y\nz: w")
    assert rows["down"].error == "refused"


def test_tally_and_report(spark, status):
    outcomes = spark.createDataFrame([("a", "success"), ("a", "skip"), ("a", "skip"), ("b", "fail")], "cluster_name string, outcome string")
    assert {tuple(r) for r in health.outcome_tally(outcomes).collect()} == {("a", 1, 2, 0), ("b", 0, 0, 1)}
    failing = status.withColumn("error", F.coalesce("error", F.when(F.col("host") == "odd", F.lit("stuck"))))
    report = health.error_report(failing.select("cluster_name", "host", "error"))
    assert [tuple(r) for r in report.collect()] == [("a", 0, "down: refused\nodd: stuck")]


def test_pick_value(spark):
    rows = spark.createDataFrame(
        [("n", 1, "schematic", "v1"), ("n", 2, "schematic", "v2"), ("n", 3, "other", "v3"), ("m", 1, "other", "v4")],
        "k string, i int, name string, v string",
    )
    last = health.pick_value(rows, ["k"], F.col("v"), ["i"], F.col("name") == "schematic", F.lit("default"))
    assert {tuple(r) for r in last.collect()} == {("n", "v2"), ("m", "default")}
    first = health.pick_value(rows, ["k"], F.col("v"), ["i"], pick="first")
    assert {tuple(r) for r in first.collect()} == {("n", "v1"), ("m", "v4")}


def test_bootstrap_state(spark):
    rows = [("Preparing", 0), ("Waiting", 3), ("Running", 3), ("Running", 0), ("Failed", 3), (None, None)]
    df = spark.createDataFrame(rows, "state string, members int")
    got = [r.action for r in health.bootstrap_state(df).collect()]
    assert got == ["bootstrap", "bootstrap", "done", "retry", "retry", "retry"]


def test_stream_outcome(spark):
    rows = [
        ("a", 1, "message", "x"),
        ("a", 3, "exit_code", "7"),
        ("a", 2, "exit_code", "0"),
        ("b", 1, "exit_code", "2"),
        ("c", 1, "message", "y"),
        ("d", 1, "name", "image"),
    ]
    messages = spark.createDataFrame(rows, "stream_id string, seq int, kind string, value string")
    streams = spark.createDataFrame([(s,) for s in "abcdee"], "stream_id string")
    assert {tuple(r) for r in health.stream_outcome(messages, streams).collect()} == {
        ("a", "ok"),
        ("b", "failed with exit code 2"),
        ("c", "ended without result"),
        ("d", "ok"),
        ("e", "ended without result"),
    }


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def direct_stable(events, quiet, deadline):
    """First stable moment of one node by stepping through its sorted events."""
    start, t0 = None, events[0][0]
    for ts, _, good in events:
        if start is not None and not good and ts < start + quiet:
            start = None
        elif start is not None and ts >= start + quiet:
            break
        elif good and start is None:
            start = ts
    if start is not None and start + quiet <= t0 + deadline:
        return "stable", start + quiet
    return "timeout", t0 + deadline


def random_log(seed, nodes=25):
    rng = random.Random(seed)
    log = []
    for node in range(nodes):
        bad = rng.choice([0.1, 0.4, 0.8])
        times = sorted(rng.sample(range(0, 600), rng.randint(1, 60)))
        log += [(node, i, ts, rng.random() > bad) for i, ts in enumerate(times)]
    return log


def expected_stable(log, quiet, deadline):
    by_node = {}
    for node, event_id, ts, good in log:
        by_node.setdefault(node, []).append((ts, event_id, good))
    return {
        node: (outcome, at(seconds))
        for node, events in by_node.items()
        for outcome, seconds in [direct_stable(sorted(events), quiet, deadline)]
    }


EVENTS = "node long, event_id long, ts timestamp, good boolean"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_first_stable_equals_stepping(spark, seed):
    log = random_log(seed)
    df = spark.createDataFrame([(n, i, at(ts), good) for n, i, ts, good in log], EVENTS)
    got = {r.node: (r.outcome, r.at) for r in health.first_stable(df, 30, 300).collect()}
    assert got == expected_stable(log, 30, 300)


@pytest.mark.parametrize("seed, pieces", [(4, 1), (5, 3)])
def test_stable_stream_equals_batch(spark, seed, pieces):
    log = random_log(seed)
    rng = random.Random(seed)
    # Disorder within the allowed delay: files are cut by jittered arrival.
    arrival = sorted(log, key=lambda e: e[2] + rng.uniform(0, 15))
    size = -(-len(arrival) // pieces)
    slices = [
        spark.createDataFrame([(n, i, at(ts), good) for n, i, ts, good in arrival[k : k + size]], EVENTS)
        for k in range(0, len(arrival), size)
    ]
    slices.append(spark.createDataFrame([(None, None, at(10_000), None)], EVENTS))
    decided = replay(slices, lambda s: stability.stable_stream(s, 30, 300, 20), "test-stability")
    got = {r.node: (r.outcome, r.at) for r in decided.where("node is not null").collect()}
    assert got == expected_stable(log, 30, 300)
    assert decided.where("node is not null").count() == len(got)


def test_decided_keys_leave_the_state(spark, tmp_path):
    rows = [(f"k{i}", at(i), False) for i in range(20)]
    attempts = spark.createDataFrame(rows, "key string, ts timestamp, ok boolean")
    beats = [spark.createDataFrame([("beat", at(t), True)], attempts.schema) for t in (500, 5000, 9000)]
    source, progress = str(tmp_path / "source"), str(tmp_path / "log")
    sizes = []
    for part in (attempts, *beats):
        part.write.mode("append").parquet(source)
        stream = stability.retry_stream(spark.readStream.schema(attempts.schema).parquet(source), 10, 5, forget_seconds=100)
        writer = stream.writeStream.format("noop").option("checkpointLocation", progress).trigger(availableNow=True)
        writer.start().awaitTermination()
        sizes.append(spark.read.format("statestore").load(progress).count())
    assert sizes[0] == 20 and sizes[-1] <= 1


@pytest.mark.parametrize("name", ["stable_stream", "retry_stream"])
def test_registered_streams_end_with_an_empty_state(spark, tables, tmp_path, monkeypatch, name):
    places = iter(range(100))
    monkeypatch.setattr(replay_module, "shared_path", lambda _, label: str(tmp_path / f"{label}-{next(places)}"))
    decided = QUERIES[name](spark, tables).count()
    progress = next(path for path in tmp_path.iterdir() if "-progress" in path.name)
    # Only the heartbeat is left, whatever the number of keys.
    assert decided > 10 and spark.read.format("statestore").load(str(progress)).count() <= 1


def test_stage_and_retry(spark):
    events = spark.createDataFrame(
        [("a", at(0), "booting"), ("a", at(5), "maintenance"), ("a", at(9), "maintenance"), ("b", at(0), "booting"), ("c", at(0), "x"), ("c", at(11), "maintenance")],
        "node string, ts timestamp, stage string",
    )
    assert {tuple(r) for r in health.first_in_stage(events, "maintenance", 10).collect()} == {
        ("a", "reached", at(5)),
        ("b", "timeout", at(10)),
        ("c", "timeout", at(10)),
    }
    attempts = spark.createDataFrame(
        [("a", at(0), False), ("a", at(10), True), ("b", at(0), False), ("b", at(11), True)],
        "key string, ts timestamp, ok boolean",
    )
    expected = {("a", "success", at(10)), ("b", "gave up", at(10))}
    assert {tuple(r) for r in health.retry_outcome(attempts, 10).collect()} == expected
    beat = spark.createDataFrame([(None, at(500), None)], attempts.schema)
    live = replay([attempts, beat], lambda s: stability.retry_stream(s, 10, 5), "test-retry")
    assert {tuple(r) for r in live.where("key is not null").collect()} == expected
