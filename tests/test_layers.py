"""Layer merge against a plain dictionary merge, and the shape of its plan."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fleetloom.operators import layers, nested

SCHEMA = "cluster_name string, scope string, scope_value string, layer_path string, doc_index int, text string"


def random_document(rng, depth=3):
    doc = {}
    for key in rng.sample("abcd", rng.randint(1, 3)):
        draw = rng.random()
        if depth > 1 and draw < 0.5:
            doc[key] = random_document(rng, depth - 1)
        elif draw < 0.6:
            doc[key] = {"$patch": "delete"}
        elif draw < 0.68:
            doc[key] = {}
        elif draw < 0.8:
            doc[key] = [rng.randint(0, 9) for _ in range(rng.randint(0, 2))]
        elif draw < 0.85:
            doc[key] = None
        else:
            doc[key] = rng.choice([1, 2, True, "x", "y"])
    return doc


def merge(tree, doc, append):
    for key, value in doc.items():
        if isinstance(value, dict) and value.get("$patch") == "delete":
            tree.pop(key, None)
        elif isinstance(value, dict):
            if not isinstance(tree.get(key), dict):
                tree[key] = {}
            merge(tree[key], value, append)
        elif append and isinstance(value, list) and isinstance(tree.get(key), list):
            tree[key] = tree[key] + value
        else:
            tree[key] = value
    return tree


def leaves_of(tree, path=()):
    for key, value in tree.items():
        if isinstance(value, dict):
            yield from leaves_of(value, (*path, key))
        else:
            yield (*path, key), value


def settings_of(spark, rows):
    documents = spark.createDataFrame(rows, SCHEMA).withColumn("body", F.parse_json("text")).drop("text")
    return nested.flatten_leaves(documents, "body", 6, walk_lists=False, directives=True)


def as_value(row):
    if row.value is None:
        return None
    return row.value if row.kind == "string" else json.loads(row.value)


@pytest.mark.parametrize("append", [False, True])
def test_merge_equals_dictionary_merge(spark, append):
    rng = random.Random(11 + append)
    rows, expected = [], {}
    for case in range(150):
        name, tree = f"c{case}", {}
        for i in range(rng.randint(1, 5)):
            doc = random_document(rng)
            rows.append((name, "all", None, f"{i:02d}.yaml", 0, json.dumps(doc)))
            merge(tree, doc, append)
        for path, value in leaves_of(tree):
            expected[name, path] = value
    settings = layers.with_precedence(settings_of(spark, rows))
    merged = layers.merge_layers(settings, ["cluster_name"], "append" if append else "replace")
    assert {(r.cluster_name, tuple(r.path)): as_value(r) for r in merged.collect()} == expected


@pytest.mark.parametrize("append", [False, True])
def test_scoped_merge_equals_dictionary_merge(spark, append):
    rng = random.Random(23 + append)
    rows, nodes, expected = [], [], {}
    for cluster in map("k{}".format, range(25)):
        layers_of = {}

        def add(scope, value, count):
            for i in range(count):
                doc = random_document(rng)
                layers_of.setdefault((scope, value), []).append(doc)
                rows.append((cluster, scope, value, f"{i:02d}.yaml", 0, json.dumps(doc)))

        hosts = [(f"h{i}", rng.choice(["worker", "control-plane"])) for i in range(3)]
        nodes += [(cluster, host, role) for host, role in hosts]
        add("base", None, rng.randint(0, 1))
        add("all", None, rng.randint(0, 2))
        add("role", "worker", rng.randint(0, 2))
        add("role", "control-plane", rng.randint(0, 2))
        for host, _ in hosts:
            add("base", host, rng.randint(0, 1) if rng.random() < 0.3 else 0)
            add("node", host, rng.randint(0, 2))
        for host, role in hosts:
            # Base layers of both kinds share rank, path and index: skip the ambiguous pair.
            if layers_of.get(("base", None)) and layers_of.get(("base", host)):
                continue
            tree = {}
            for key in (("base", None), ("base", host), ("all", None), ("role", role), ("node", host)):
                for doc in layers_of.get(key, []):
                    merge(tree, doc, append)
            expected.update({(cluster, host, path): value for path, value in leaves_of(tree)})
            expected[cluster, host, "seen"] = True
    node_table = spark.createDataFrame(nodes, "cluster_name string, host string, role string")
    merged = layers.merged_settings(node_table, settings_of(spark, rows), "append" if append else "replace")
    got = {(r.cluster_name, r.host, tuple(r.path)): as_value(r) for r in merged.collect()}
    judged = {key[:2] for key in expected if key[2] == "seen"}
    assert {k: v for k, v in got.items() if k[:2] in judged} == {
        k: v for k, v in expected.items() if k[2] != "seen"
    }


def test_later_folder_wins_in_walk_order(spark):
    rows = [
        ("c", "all", None, "a.yaml", 0, '{"x": "file"}'),
        ("c", "all", None, "a/b.yaml", 0, '{"x": "folder"}'),
        ("c", "all", None, "a.yaml", 1, '{"y": 2}'),
        ("c", "all", None, "a.yaml", 0, '{"y": 1}'),
    ]
    merged = layers.merge_layers(layers.with_precedence(settings_of(spark, rows)), ["cluster_name"])
    assert {(".".join(r.path), r.value) for r in merged.collect()} == {("x", "file"), ("y", "2")}


def test_kinds_are_kept_apart_by_the_key(spark):
    rows = [("c", "all", None, "a.yaml", 0, '{"v": 1}'), ("c", "all", None, "b.yaml", 0, '{"v": 2}')]
    settings = layers.with_precedence(settings_of(spark, rows)).withColumn(
        "doc_kind", F.when(F.col("layer_path") == "a.yaml", F.lit("Host")).otherwise(F.lit("Mirror"))
    )
    merged = layers.merge_layers(settings, ["cluster_name", "doc_kind"])
    assert {(r.doc_kind, r.value) for r in merged.collect()} == {("Host", "1"), ("Mirror", "2")}


def test_applicable_layers_is_equi_joins_only(spark):
    nodes = spark.createDataFrame(
        [("a", "n1", "worker"), ("a", "n2", "control-plane"), ("b", "n1", "worker")],
        "cluster_name string, host string, role string",
    )
    rows = [
        ("a", "all", None, "all.yaml", 0, ""),
        ("a", "role", "worker", "role.yaml", 0, ""),
        ("a", "node", "n2", "node.yaml", 0, ""),
        ("a", "base", None, "base.yaml", 0, ""),
        ("b", "node", "n2", "other.yaml", 0, ""),
    ]
    applied = layers.applicable_layers(nodes, spark.createDataFrame(rows, SCHEMA))
    got = {(r.cluster_name, r.host, r.layer_path) for r in applied.collect()}
    assert got == {
        ("a", "n1", "all.yaml"),
        ("a", "n2", "all.yaml"),
        ("a", "n1", "base.yaml"),
        ("a", "n2", "base.yaml"),
        ("a", "n1", "role.yaml"),
        ("a", "n2", "node.yaml"),
    }
    plan = applied._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_list_mode_is_checked(spark):
    with pytest.raises(ValueError):
        layers.merge_layers(spark.range(1), ["id"], "zip")


def test_tasks_of_a_merge_follow_its_leaves(spark, monkeypatch):
    """No task aggregates before the shuffle, and each one behind it gets a bounded number of leaves."""
    monkeypatch.setattr(layers, "TASK_LEAVES", 10)
    kept = []
    monkeypatch.setattr(layers, "cut_lineage", lambda df: kept.append(df) or df.localCheckpoint())
    leaf = lambda i: ("c", "node", f"h{i}", f"{i % 2}.yaml", 0, ["a", "b", str(i % 3)], "scalar", str(i))
    names = "cluster_name string, scope string, scope_value string, layer_path string, doc_index int, path array<string>, kind string, value string"
    leaves = layers.with_precedence(spark.createDataFrame([leaf(i) for i in range(95)], names))
    merged = layers.merge_layers(leaves, ["cluster_name", "scope_value"])
    plan = kept[0]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Aggregate" not in plan[plan.index("Exchange") :]
    assert kept[0].rdd.getNumPartitions() == 10
    assert {(r.scope_value, r.value) for r in merged.collect()} == {(f"h{i}", str(i)) for i in range(95)}
