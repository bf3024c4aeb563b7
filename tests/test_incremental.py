"""Updates of a kept merge against a merge of everything, and what they read."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fleetloom.operators import layers
from fleetloom.plans.incremental import MergedStore
from tests.test_layers import random_document, settings_of


OUT = ["cluster_name", "host", "role", "path", "kind", "value"]


def rows_of(df):
    return sorted((tuple(map(str, row)) for row in df.select(*OUT).collect()), key=repr)


def random_files(rng, clusters, hosts):
    """Layer files ``(cluster, layer_path) -> (scope, scope_value, documents)``."""
    files = {}
    for cluster in clusters:
        files[cluster, "base.yaml"] = ("base", None, [random_document(rng)])
        files[cluster, "all/1.yaml"] = ("all", None, [random_document(rng) for _ in range(2)])
        for role in ("worker", "lead"):
            files[cluster, f"{role}/1.yaml"] = ("role", role, [random_document(rng)])
        for host in rng.sample(hosts, 2):
            files[cluster, f"node/{host}.yaml"] = ("node", host, [random_document(rng)])
    return files


def settings(spark, files):
    rows = [(c, s, v, p, i, json.dumps(d)) for (c, p), (s, v, docs) in files.items() for i, d in enumerate(docs)]
    return settings_of(spark, rows)


def named(spark, files):
    return spark.createDataFrame(sorted(files), "cluster_name string, layer_path string")


@pytest.fixture
def nodes(spark):
    rows = [(c, f"h{i}", [None, "worker", "lead"][i % 3]) for c in "xyz" for i in range(6)]
    return spark.createDataFrame(rows, "cluster_name string, host string, role string")


def test_updates_give_the_full_merge(spark, nodes, tmp_path):
    # Other tests and the query replace lists.
    list_mode = "append"
    rng = random.Random(11)
    hosts = [f"h{i}" for i in range(6)]
    files = random_files(rng, "xyz", hosts)
    store = MergedStore(spark, f"file://{tmp_path}/store", shards=5, list_mode=list_mode)
    store.build(nodes, settings(spark, files))
    assert rows_of(store.settings(nodes)) == rows_of(layers.merged_settings(nodes, settings(spark, files), list_mode))
    fresh = random_files(rng, "x", hosts)
    changed = {key: fresh[key] for key in list(fresh)[:3]} | {("y", "node/new.yaml"): ("node", "h1", [{"a": 1}, {"b": {"$patch": "delete"}}])}
    gone = {("z", "all/1.yaml"), ("x", "lead/1.yaml")}
    files = {k: v for k, v in (files | changed).items() if k not in gone}
    store.update(nodes, settings(spark, changed), named(spark, [*changed, *gone]))
    assert rows_of(store.settings(nodes)) == rows_of(layers.merged_settings(nodes, settings(spark, files), list_mode))


def test_other_roles_and_new_nodes(spark, nodes, tmp_path):
    files = {("x", "all.yaml"): ("all", None, [{"a": 1, "b": 1}]), ("x", "lead.yaml"): ("role", "lead", [{"a": 2}]),
             ("x", "h9.yaml"): ("node", "h9", [{"b": {"c": 3}}]), ("x", "h1.yaml"): ("node", "h1", [{"a": {"d": 4}}])}
    store = MergedStore(spark, f"file://{tmp_path}/store", shards=3)
    store.build(nodes, settings(spark, files))
    moved = nodes.where("host <> 'h1'").unionByName(spark.createDataFrame([("x", "h1", "lead"), ("x", "h9", "lead")], nodes.schema))
    with pytest.raises(Exception, match="role of a node with layers has changed"):
        store.settings(moved).collect()
    none = settings(spark, files).limit(0)
    store.update(moved, none, named(spark, [("x", "-")]).limit(0), hosts=moved.where("host IN ('h1', 'h9')"))
    assert rows_of(store.settings(moved)) == rows_of(layers.merged_settings(moved, settings(spark, files)))


def test_an_update_reads_and_writes_its_own_shards_only(spark, tmp_path):
    nodes = spark.createDataFrame([(f"c{i}", "h", "worker") for i in range(200)], "cluster_name string, host string, role string")
    files = {(f"c{i}", "all.yaml"): ("all", None, [{"a": i, "b": {"c": i}}]) for i in range(200)}
    store = MergedStore(spark, f"file://{tmp_path}/store", shards=64)
    store.build(nodes, settings(spark, files))
    before = store._manifest()[1]
    change = {("c7", "all.yaml"): ("all", None, [{"a": "new", "b": {"c": 7}}])}
    read = []
    plain = store._read
    store._read = lambda part, homes, schemas, shards: read.append(plain(part, homes, schemas, shards)) or read[-1]
    store.update(nodes, settings(spark, change), named(spark, change))
    after = store._manifest()[1]
    # Two top-level keys of one cluster: at most two shards of leaves and of merged rows, one of the index.
    assert len(read) == 3 and [len({f.split("/shard=")[1].split("/")[0] for f in df.inputFiles()}) for df in read] <= [1, 2, 2]
    assert sum(before.get(key) != home for key, home in after.items()) <= 5
    # Of the leaves in these shards, only those of the touched cluster are merged again.
    assert spark.read.parquet(f"{tmp_path}/store/leaves/version=2").count() < 40
    assert store.settings(nodes).where("value = 'new'").count() == 1 and store.settings(nodes).count() == 400


def test_a_run_that_dies_leaves_the_version_before(spark, nodes, tmp_path, monkeypatch):
    files = {("x", "all.yaml"): ("all", None, [{"a": 1, "b": 1}])}
    store = MergedStore(spark, f"file://{tmp_path}/store", shards=3)
    store.build(nodes, settings(spark, files))
    old = rows_of(store.settings(nodes))
    change = {("x", "all.yaml"): ("all", None, [{"a": 5}])}

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(MergedStore, "_commit", die)
        with pytest.raises(RuntimeError, match="lost"):
            store.update(nodes, settings(spark, change), named(spark, change))
    assert rows_of(store.settings(nodes)) == old
    assert store.update(nodes, settings(spark, change), named(spark, change)) == 2
    assert rows_of(store.settings(nodes)) == rows_of(layers.merged_settings(nodes, settings(spark, change)))
    with pytest.raises(ValueError, match="there is a store"):
        store.build(nodes, settings(spark, files))


def test_nothing_left(spark, nodes, tmp_path):
    files = {("x", "all.yaml"): ("all", None, [{"a": 1}])}
    store = MergedStore(spark, f"file://{tmp_path}/store", shards=3)
    with pytest.raises(ValueError, match="there is no store"):
        store.settings(nodes)
    store.build(nodes, settings(spark, files))
    store.update(nodes, settings(spark, files).limit(0), named(spark, files))
    assert store.settings(nodes).count() == 0
    store.update(nodes, settings(spark, files), named(spark, files))
    assert store.settings(nodes).select(F.countDistinct("host")).first()[0] == 6
