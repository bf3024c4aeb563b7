import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fleetloom.operators import nodes as ops, refs
from fleetloom.operators.ordered import ordinals, pages, running_total
from fleetloom.plans import drift, rollout


def as_set(df):
    return {tuple(row) for row in df.collect()}


@pytest.fixture()
def nodes(spark):
    return spark.createDataFrame(
        [
            ("a", "n2", "worker", None),
            ("a", "n1", "worker", "10.0.0.1"),
            ("a", "z0", "control-plane", None),
            ("a", "y0", "control-plane", "10.0.0.9"),
            ("b", "solo", "worker", None),
        ],
        "cluster_name string, host string, role string, ip string",
    )


def test_filter_is_an_unanchored_search(nodes):
    assert {r.host for r in ops.filter_nodes(nodes, "0$").collect()} == {"z0", "y0"}
    assert ops.filter_nodes(nodes, "").count() == 5
    with pytest.raises(Exception):
        ops.filter_nodes(nodes, "(")


def test_order_and_position(nodes):
    order = [r.host for r in ops.order_nodes(nodes.where("cluster_name = 'a'")).collect()]
    assert order == ["y0", "z0", "n1", "n2"]
    assert as_set(ops.with_position(nodes).select("host", "position")) == {
        ("y0", 1),
        ("z0", 2),
        ("n1", 3),
        ("n2", 4),
        ("solo", 1),
    }


def test_role_split_counts_missing_role_as_other(spark):
    df = spark.createDataFrame([("a", "x", None), ("a", "y", "control-plane")], "cluster_name string, host string, role string")
    lead, rest = ops.partition_by_role(df)
    assert (lead.count(), rest.count()) == (1, 1)
    assert as_set(ops.role_counts(df)) == {("a", 1, 1)}


def test_validation(spark):
    df = spark.createDataFrame(
        [("a", "", "worker"), ("a", "h", ""), ("a", "h", "boss"), ("a", None, None), ("a", "ok", "worker")],
        "cluster_name string, host string, role string",
    )
    reasons = [r.reasons for r in ops.validate_nodes(df).collect()]
    assert reasons == [
        ["host is empty"],
        ["role is empty"],
        ["unknown role: boss"],
        ["host is empty", "role is empty"],
        [],
    ]
    with pytest.raises(PySparkException):
        ops.validate_nodes(df, "fail").count()
    assert ops.validate_nodes(df.where("host = 'ok'"), "fail").count() == 1


def test_defaults_prefer_node_then_cluster(spark):
    fields = "factory string, platform string, schematic_id string, talos_version string, secureboot boolean"
    nodes = spark.createDataFrame(
        [("a", "n1", "", None, "s", "v1.2.3", False), ("a", "n2", "f", "", None, None, True)],
        f"cluster_name string, host string, {fields}",
    )
    clusters = spark.createDataFrame([("a", "cf", "", None, "v1.9.0", False)], f"cluster_name string, {fields}")
    rows = {
        r.host: (r.factory, r.platform, r.schematic_id, r.talos_version, r.secureboot)
        for r in ops.resolve_defaults(nodes, clusters, "v1.13.0").collect()
    }
    assert rows == {
        "n1": ("cf", "metal", "s", "1.2.3", False),
        "n2": ("f", "metal", ops.DEFAULT_SCHEMATIC, "1.9.0", True),
    }


def test_generation_version_ignores_node_override(spark):
    df = spark.createDataFrame([("v1.1.0", "v1.2.0"), ("", "v1.2.0"), (None, "")], "r string, c string")
    got = [r[0] for r in df.select(ops.generation_version("r", "c", "v1.3.0")).collect()]
    assert got == ["1.1.0", "1.2.0", "1.3.0"]


def test_first_reachable(nodes):
    got = as_set(ops.first_reachable(nodes, F.col("host") != "y0").select("cluster_name", "host", F.col("error").isNull()))
    assert got == {("a", "z0", True), ("b", None, False)}


def test_cluster_info_and_pages(spark, nodes):
    clusters = spark.createDataFrame([("a", bytearray(b"ca")), ("c", None)], "cluster_name string, ca binary")
    rows = ops.cluster_info(clusters, nodes, ["host"], ("ca",), page_size=3).collect()
    got = {(r.cluster_name, r.page): (r.ca, [n.host for n in r.nodes or []]) for r in rows}
    assert got == {
        ("a", 0): ("Y2E=", ["y0", "z0", "n1"]),
        ("a", 1): ("Y2E=", ["n2"]),
        ("c", 0): (None, []),
    }


def test_client_contexts(nodes):
    rows = ops.client_contexts(nodes).collect()
    assert {(r.cluster_name, r.list): r.entries for r in rows} == {
        ("a", "endpoints"): ["10.0.0.9", "z0"],
        ("a", "nodes"): ["10.0.0.9", "z0", "10.0.0.1", "n2"],
        ("b", "endpoints"): ["solo"],
        ("b", "nodes"): ["solo"],
    }


def test_hot_key_is_ranked_by_many_tasks(spark):
    rng = random.Random(5)
    hosts = [f"h{i:05d}" for i in range(3000)]
    rng.shuffle(hosts)
    rows = [("hot" if i % 3 else f"k{i}", host) for i, host in enumerate(hosts)]
    df = spark.createDataFrame(rows, "k string, host string").repartition(6)
    got = {(r.k, r.host): r.rn for r in ordinals(df, ["k"], ["host"], "rn").collect()}
    expected = {}
    for key in {k for k, _ in rows}:
        for rn, host in enumerate(sorted(h for k, h in rows if k == key), 1):
            expected[key, host] = rn
    assert got == expected
    listed = pages(df, ["k"], ["host"], F.col("host"), 100, "hosts").where("k = 'hot'").orderBy("page").collect()
    assert max(len(r.hosts) for r in listed) == 100
    assert [h for r in listed for h in r.hosts] == sorted(h for k, h in rows if k == "hot")


def test_running_total_matches_plain_window(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), i, rng.randint(0, 3)) for i in range(500)] + [(None, 1, 2), (None, 2, 5)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    plain = as_set(df.select("k", "i", F.expr("sum(v) over (partition by k order by i)")))
    assert as_set(running_total(df, ["k"], ["i"], F.col("v"), "t").select("k", "i", "t")) == plain


def test_ranks_shuffle_rows_once(spark):
    rows = [("hot" if i % 3 else None, f"h{i % 50}") for i in range(600)]
    df = spark.createDataFrame(rows, "k string, host string").repartition(5)
    got = [(r.k, r.rn) for r in ordinals(df, ["k"], ["host"], "rn").collect()]
    assert sorted(rn for k, rn in got if k is None) == list(range(1, 201))
    assert sorted(rn for k, rn in got if k) == list(range(1, 401))
    plan = ordinals(df, ["k"], ["host"], "rn")._jdf.queryExecution().executedPlan().toString()
    # What comes after the range step are the checkpointed rows joined with a table of slices.
    assert "rangepartitioning" not in plan and "Window" in plan


def test_equal_rows_are_spread_too(spark):
    df = spark.createDataFrame([("hot", "same")] * 4000 + [("k", "a")], "k string, host string").repartition(3)
    ranked = ordinals(df, ["k"], ["host"], "rn")
    assert sorted(r.rn for r in ranked.where("k = 'hot'").collect()) == list(range(1, 4001))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = tie.repartitionByRange(parts, "k", "host", "_tie").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in placed.collect()) < 4000


def test_refs(spark):
    assert spark.range(1).select(refs.content_id(F.lit("customization: {}\n"))).first()[0] == ops.DEFAULT_SCHEMATIC
    nodes = spark.createDataFrame([("n1", "@a.yaml"), ("n2", "plain"), ("n3", "@gone"), ("n4", None)], "host string, ref string")
    definitions = spark.createDataFrame([("a.yaml", "customization: {}\n")], "path string, definition string")
    got = {r.host: (r.resolved_id, r.error) for r in refs.resolve_refs(nodes, definitions, "ref", ["host"]).collect()}
    assert got == {
        "n1": (ops.DEFAULT_SCHEMATIC, None),
        "n2": ("plain", None),
        "n3": (None, "definition not found: gone"),
        "n4": (None, None),
    }
    assert as_set(refs.missing_definitions(nodes, definitions, "ref")) == {("gone",)}


def test_a_null_key_has_its_result(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "k string, v int")
    done = refs.once_per_key(rows, ["k"], lambda keys: keys.withColumn("r", F.coalesce("k", F.lit("none"))))
    assert sorted((r.v, r.r) for r in done.collect()) == [(1, "a"), (2, "none"), (3, "none")]


def test_costly_work_runs_once_per_key(spark):
    calls = spark.sparkContext.accumulator(0)

    def work(keys):
        def note(frames):
            for frame in frames:
                calls.add(len(frame))
                yield frame.assign(out=frame.k * 2)

        return keys.mapInPandas(note, "k long, out long")

    rows = spark.createDataFrame([(i % 3,) for i in range(30)], "k long")
    done = refs.once_per_key(rows, ["k"], work).collect()
    assert len(done) == 30 and all(r.out == r.k * 2 for r in done)
    assert calls.value == 3


def test_upgrade_plan_and_waves(spark):
    desired = spark.createDataFrame(
        [("a", "n1", "r/i/s1:v1.2"), ("a", "n2", "r/i/s1:v1.2"), ("a", "n3", "broken"), ("a", "n4", "r/i/s1:v1.2")],
        "cluster_name string, host string, installer string",
    )
    running = spark.createDataFrame(
        [("a", "n1", "1.2", "s1"), ("a", "n2", "", "s1"), ("a", "n3", "1", "s"), ("a", "n4", None, None)],
        "cluster_name string, host string, running_version string, running_schematic string",
    )
    plan = rollout.upgrade_plan(desired, running, ["cluster_name", "host"])
    assert {r.host: r.needs_upgrade for r in plan.collect()} == {"n1": False, "n2": True, "n3": None, "n4": True}
    assert as_set(rollout.upgrade_required(plan)) == {("a", True)}
    fleet = spark.createDataFrame(
        [("a", f"w{i}", "worker") for i in range(5)] + [("a", "c1", "control-plane"), ("a", "c0", "control-plane")],
        "cluster_name string, host string, role string",
    )
    waves = rollout.rollout_waves(fleet, F.lit("25%"), F.col("host") != "w0")
    assert {r.host: (r.wave, r.parallel) for r in waves.collect()} == {
        "c0": (1, 1),
        "c1": (2, 1),
        "w1": (3, 2),
        "w2": (3, 2),
        "w3": (4, 2),
        "w4": (4, 2),
    }


def test_stop_after_failure(spark):
    runs = spark.createDataFrame(
        [("r", "a", 0, 10, False), ("r", "b", 1, 5, True), ("r", "c", 5, 9, False), ("r", "d", 6, 9, True), ("q", "a", 9, 9, False)],
        "rollout_id string, host string, start_ts int, end_ts int, failed boolean",
    )
    got = {(r.rollout_id, r.host): r.violation for r in rollout.audit_stop_after_failure(runs).collect()}
    assert got == {("r", "a"): False, ("r", "b"): False, ("r", "c"): False, ("r", "d"): True, ("q", "a"): False}


def test_drift(spark):
    schema = "n string, path string, value string"
    desired = spark.createDataFrame([("x", "p", "1"), ("x", "q", "2"), ("x", "r", None), ("y", "p", "1")], schema)
    current = spark.createDataFrame([("x", "p", "1"), ("x", "q", "3"), ("x", "r", None), ("x", "s", "4"), ("y", "p", "1")], schema)
    found = drift.config_drift(desired, current, ["n"])
    assert {(r.n, r.path): r.change for r in found.collect()} == {
        ("x", "p"): "same",
        ("x", "q"): "changed",
        ("x", "r"): "same",
        ("x", "s"): "removed",
        ("y", "p"): "same",
    }
    assert as_set(drift.any_change(found, ["n"])) == {("x", True), ("y", False)}


def test_known_keys_are_not_worked_on_again(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    folder = str(tmp_path / "kept")

    def work(keys):
        def note(frames):
            for frame in frames:
                calls.add(len(frame))
                yield frame.assign(out=frame.k.fillna("none") + "!")

        return keys.mapInPandas(note, "k string, out string")

    def run(rows, name):
        made = refs.once_ever(spark.createDataFrame(rows, "k string, v int"), ["k"], work, folder, name)
        return sorted((r.v, r.out, r.done_in) for r in made.collect())

    assert run([("a", 1), ("b", 2), ("a", 3)], "x") == [(1, "a!", "x"), (2, "b!", "x"), (3, "a!", "x")]
    assert calls.value == 2
    assert run([("b", 1), (None, 2), ("c", 3)], "y") == [(1, "b!", "x"), (2, "none!", "y"), (3, "c!", "y")]
    assert calls.value == 4
    assert run([("a", 1), (None, 2), ("c", 3)], "z") == [(1, "a!", "x"), (2, "none!", "y"), (3, "c!", "y")]
    assert calls.value == 4
    assert run([], "empty") == []
