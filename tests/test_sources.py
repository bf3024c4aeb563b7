import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fleetloom.functions.columns import DEFAULT_SCHEMATIC
from fleetloom.operators import layers, nested, templates
from fleetloom.plans.render import render
from fleetloom.session import task_count
from fleetloom.sources import documents, sinks

CLUSTER = """
clusterName: east
clusterEndpoint: https://east.local:6443
kubernetesVersion: v1.34.1
talosVersion: 1.10
secureboot: true
data:
  zone: {name: z1, weight: 3}
nodes:
  - host: e1
    role: control-plane
    ip: 10.1.0.1
  - host: e2
    role: worker
    platform: vmware
    data: {rack: r7}
"""


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)


@pytest.mark.parametrize(
    "text, kept, failed",
    [
        ("", [], False),
        ("  \n\n", [], False),
        ("# only a note\n", [], False),
        ("a: 1\n", [{"a": 1}], False),
        ("---\n---\nb: {c: x}\n", [{"b": {"c": "x"}}], False),
        ("---\n{}\n---\n# note\n---\nnull\n", [], False),
        ("a: 1\n---\nb: 2\n", [{"a": 1}, {"b": 2}], False),
        ("- op: add\n", None, True),
        ("[]\n", None, True),
        ("just text\n", None, True),
        ("a: 1\n---\n- x\n", None, True),
        ("a: [1\n", None, True),
    ],
)
def test_split_yaml_documents(spark, text, kept, failed):
    df = spark.createDataFrame([("f", text)], "file string, t string")
    rows = documents.split_yaml_documents(df, "t").orderBy("doc_index").collect()
    if failed:
        assert [r.error is not None and r.body is None for r in rows] == [True]
    else:
        assert [json.loads(r.body) for r in rows] == kept
        assert [r.doc_index for r in rows] == list(range(len(kept)))


@pytest.mark.parametrize(
    "text, kept, failed",
    [
        ('{"a": 1}\n---\n\n---\n{"b": "--- no"}\n---\n{}', 2, None),
        ('{"a": 1}\n---\n["x"]', 0, 1),
        ('"text"', 0, 0),
        ('{"a": 1}\n---\n{"b"', 0, 1),
        (" # note\n", 0, None),
    ],
)
def test_split_json_documents(spark, text, kept, failed):
    df = spark.createDataFrame([("f", text)], "file string, t string")
    rows = documents.split_documents(df, "t").collect()
    assert sum(r.error is None for r in rows) == kept
    assert [r.doc_index for r in rows if r.error is not None] == ([] if failed is None else [failed])


def test_load_yaml_clusters(spark, tmp_path):
    write(str(tmp_path / "east.yaml"), CLUSTER)
    write(str(tmp_path / "sub" / "west.yaml"), "clusterName: west\nnodes: []\n")
    clusters, nodes = documents.load_clusters(spark, str(tmp_path))
    rows = {r.cluster_name: r for r in clusters.withColumn("data", F.to_json("data")).collect()}
    assert set(rows) == {"east", "west"}
    # A version keeps its text: 1.10 is not the number 1.1.
    assert (rows["east"].talos_version, rows["east"].secureboot) == ("1.10", True)
    assert json.loads(rows["east"].data) == {"zone": {"name": "z1", "weight": 3}}
    got = {r.host: (r.role, r.ip, r.platform) for r in nodes.drop("data").collect()}
    assert got == {"e1": ("control-plane", "10.1.0.1", None), "e2": ("worker", None, "vmware")}


@pytest.mark.parametrize("text", ["clusterName: x\nconfigDir: old\n", "nodes: []\n", "a: [\n"])
def test_bad_cluster_documents_stop_the_load(spark, tmp_path, text):
    write(str(tmp_path / "bad.yaml"), text)
    clusters, _ = documents.load_clusters(spark, str(tmp_path))
    with pytest.raises(PySparkException):
        clusters.count()


def test_discover_layers(spark, tmp_path):
    root = tmp_path / "my fleet+1"
    for path in (
        "east/all/a.yaml",
        "east/all/a/b.yml",
        "east/control-plane/c.yaml.tpl",
        "east/node/e1/d.yaml",
        "east/node/e1/notes.txt",
        "east/other/x.yaml",
        "west/worker/deep/er/w.yaml",
    ):
        write(str(root / path), f"path: {path}\n")
    found = documents.discover_layers(spark, str(root))
    got = {(r.cluster_name, r.scope, r.scope_value, r.layer_path) for r in found.collect()}
    assert got == {
        ("east", "all", None, "a.yaml"),
        ("east", "all", None, "a/b.yml"),
        ("east", "role", "control-plane", "c.yaml.tpl"),
        ("east", "node", "e1", "d.yaml"),
        ("west", "role", "worker", "deep/er/w.yaml"),
    }
    assert documents.discover_layers(spark, str(tmp_path / "absent")).count() == 0


def test_render_end_to_end(spark, tmp_path):
    """Files to merged settings: discover, fill, split, flatten, merge, write."""
    write(str(tmp_path / "conf" / "east.yaml"), CLUSTER)
    layer = tmp_path / "layers" / "east"
    write(str(layer / "all" / "10.yaml"), "machine:\n  disk: sda # {{ .No.Template }}\n  tags: [x]\n---\nkubelet: {max: 100}\n")
    write(str(layer / "worker" / "20.yaml.tpl"), "machine:\n  name: {{ .Node.Host }}\n")
    write(str(layer / "node" / "e2" / "30.yaml"), "machine:\n  tags: {$patch: delete}\nkubelet: {max: 250}\n")
    _, nodes = documents.load_clusters(spark, str(tmp_path / "conf"))
    applied = layers.applicable_layers(
        nodes, documents.discover_layers(spark, str(tmp_path / "layers")).withColumn("doc_index", F.lit(0))
    ).drop("doc_index")
    filled = templates.fill_templates(
        applied.withColumnRenamed("text", "body").withColumn(
            "context", F.create_map(F.lit("Node.Host"), F.col("host"))
        ),
        "body",
        "context",
        where=F.endswith("layer_path", F.lit(".tpl")),
    ).drop("context", "error", "body")
    split = documents.split_yaml_documents(filled, "text")
    leaves = nested.flatten_leaves(
        split.withColumn("body", F.parse_json("body")).drop("error"), "body", 6, walk_lists=False, directives=True
    )
    merged = layers.merge_layers(layers.with_precedence(leaves), ["cluster_name", "host"])
    got = {(r.host, ".".join(r.path)): r.value for r in merged.collect()}
    assert got == {
        ("e1", "machine.disk"): "sda",
        ("e1", "machine.tags"): '["x"]',
        ("e1", "kubelet.max"): "100",
        ("e2", "machine.disk"): "sda",
        ("e2", "machine.name"): "e2",
        ("e2", "kubelet.max"): "250",
    }


def test_render(spark, tmp_path):
    write(str(tmp_path / "conf" / "east.yaml"), CLUSTER)
    layer = tmp_path / "layers" / "east"
    write(str(layer / "all" / "10.yaml"), "kubelet: {max: 100}\n---\nkind: Mirror\nname: a\nmax: 1\n")
    write(str(layer / "all" / "20.yaml"), "kind: Mirror\nname: b\nmax: 2\n---\nkind: Mirror\nname: a\nmax: 3\n")
    write(str(layer / "worker" / "20.yaml.tpl"), "rack: {{ .Node.Data.rack }}\nzone: {{ .Data.zone.name }}\n")
    write(str(layer / "node" / "e1" / "30.yaml"), "- not a mapping\n")
    clusters, nodes = documents.load_clusters(spark, str(tmp_path / "conf"))
    files = documents.discover_layers(spark, str(tmp_path / "layers"))
    definitions = spark.createDataFrame([], "path string, definition string")
    settings, errors = render(nodes, clusters, files, definitions, "v1.13.0")
    assert {(r.host, r.error) for r in errors.collect()} == {
        ("e1", "30.yaml: list of operations is not supported")
    }
    got = {(r.host, r.doc_kind, r.doc_name, ".".join(r.path)): r.value for r in settings.collect()}
    image = f"factory.talos.dev/vmware-installer-secureboot/{DEFAULT_SCHEMATIC}:v1.10"
    assert got == {
        ("e2", "", "", "machine.install.image"): image,
        ("e2", "", "", "kubelet.max"): "100",
        ("e2", "", "", "rack"): "r7",
        ("e2", "", "", "zone"): "z1",
        ("e2", "Mirror", "a", "kind"): "Mirror",
        ("e2", "Mirror", "a", "name"): "a",
        ("e2", "Mirror", "a", "max"): "3",
        ("e2", "Mirror", "b", "kind"): "Mirror",
        ("e2", "Mirror", "b", "name"): "b",
        ("e2", "Mirror", "b", "max"): "2",
    }


@pytest.mark.parametrize("per_host", [False, True])
def test_write_by_host(spark, tmp_path, per_host):
    rows = [("a", "h1", "x", None), ("a", "h2", "y", None), ("b", "h1", None, "broken")]
    rendered = spark.createDataFrame(rows, "cluster_name string, host string, config string, error string")
    good, bad = sinks.write_by_host(rendered, str(tmp_path / "out"), per_host)
    assert {(r.cluster_name, r.host, r.config) for r in spark.read.parquet(good).collect()} == {
        ("a", "h1", "x"),
        ("a", "h2", "y"),
    }
    assert [(r.cluster_name, r.host, r.error) for r in spark.read.parquet(bad).collect()] == [("b", "h1", "broken")]
    assert os.path.isdir(os.path.join(good, "cluster_name=a", "host=h1")) == per_host


def test_render_loses_nobody(spark):
    none = "CAST(NULL AS STRING)"
    clusters = spark.sql(
        f"SELECT 'c' AS cluster_name, 'https://c' AS cluster_endpoint, '1.34' AS kubernetes_version, {none} AS talos_version,"
        f" 'id' AS schematic_id, {none} AS factory, {none} AS platform, false AS secureboot, parse_json('{{}}') AS data"
    )
    rows = [("c", "n1", "worker"), ("c", "n2", None), ("x", "n3", "worker"), ("c", "n4", "worker"), ("c", "n5", "worker")]
    nodes = spark.createDataFrame(rows, "cluster_name string, host string, role string").selectExpr(
        "*", f"{none} AS ip", f"{none} AS talos_version", f"{none} AS schematic_id", f"{none} AS factory", f"{none} AS platform",
        "false AS secureboot", """parse_json('{"a.b": 1, "a": {"b": 2}}') AS data""",
    )
    deep = '{"a": {"b": {"c": {"d": {"e": 1}}}}}'
    layers = [
        ("c", "all", None, "10.yaml", '{"k": 1}'),
        ("c", "role", "worker", "20.yaml", '{"w": 1}'),
        ("c", "all", None, "30.yaml.tpl", '{"v": "{{ .Node.Data.a.b }}"}'),
        ("c", "node", "n4", "40.yaml", deep),
        ("c", "node", "n5", "40.yaml", '{"machine": {"install": {"$patch": "delete"}}}'),
    ]
    files = spark.createDataFrame(layers, "cluster_name string, scope string, scope_value string, layer_path string, text string")
    definitions = spark.createDataFrame([], "path string, definition string")
    settings, errors = render(nodes, clusters, files, definitions, "v1.13.0", encoding="json", max_depth=4)
    got = {}
    for r in settings.collect():
        got.setdefault((r.host, r.role), {})[".".join(r.path)] = r.value
    image = got["n1", "worker"].pop("machine.install.image")
    assert image.endswith("/id:v1.13.0")
    assert got == {
        ("n1", "worker"): {"k": "1", "w": "1", "v": "2"},
        ("n2", None): {"k": "1", "v": "2", "machine.install.image": image},
        ("n5", "worker"): {"k": "1", "w": "1", "v": "2"},
    }
    assert sorted((r.host, r.error) for r in errors.collect()) == [
        ("n3", "cluster is not listed"),
        ("n4", "40.yaml: document deeper than 4"),
    ]


def test_documents_are_whole_or_an_error(spark):
    good = '{"a": 1}'
    texts = {
        good: [good],
        f"{good}\n--- # note\n{good}": [good, good],
        f"{good}\n...\n{good}\n": [good, good],
        f"# about\n\n{good}\n# end": [good],
        f"{good} {good}": "undecodable",
        f"{good} garbage": "undecodable",
        f"{good}] junk": "undecodable",
        f"{good}, {good}": "undecodable",
        "# only a comment": [],
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text AS origin", "text")
    found = {t: [] for t in texts}
    for r in documents.split_documents(df, "text").orderBy("doc_index").collect():
        if r.error:
            found[r.origin] = r.error
        else:
            found[r.origin].append(r.body)
    assert found == texts


def test_mistyped_clusters_stop_the_load(spark):
    node = '{"host": "h", "role": "worker"}'
    fine = f'{{"clusterName": "c", "nodes": [{node}], "unknown": 1}}'
    for bad, why in (
        ('{"clusterName": "c", "secureboot": "yes"}', "wrong type of secureboot"),
        ('{"clusterName": "c", "nodes": {"host": "x"}}', "wrong type of nodes"),
        ('{"clusterName": "c", "nodes": [{"host": "", "role": "worker"}]}', "host is empty"),
        ('{"clusterName": "c", "nodes": [{"host": "h", "role": "bogus"}]}', "bad node"),
        (fine + " {}", "not one document"),
    ):
        texts = spark.createDataFrame([("f", bad)], "file string, text string")
        with pytest.raises(Exception, match=why):
            documents.parse_clusters(texts, "json")[0].collect()
    texts = spark.createDataFrame([("f", fine), ("g", fine)], "file string, text string")
    clusters, loaded = documents.parse_clusters(texts, "json")
    assert clusters.count() == 1 and loaded.count() == 2


def test_settings_of_a_cluster_come_from_all_its_documents(spark):
    whole = {
        "clusterName": "c", "clusterEndpoint": "https://c", "kubernetesVersion": "1.34", "talosVersion": "1.10",
        "schematicId": "id", "factory": "f", "platform": "p", "secureboot": True, "data": {"b": 1, "a": [2]},
    }
    pages = [{"clusterName": "c", "data": None, "nodes": [{"host": f"h{i}", "role": "worker"}]} for i in range(20)]
    pieces = [{"clusterName": "c", key: value} for key, value in whole.items() if key != "clusterName"]
    for given in ([whole, *pages], [*pages, whole], [*pieces, *pages], [whole, {**whole, "data": {"a": [2], "b": 1}}]):
        rows = [(f"f{i}", json.dumps(d)) for i, d in enumerate(given)]
        texts = spark.createDataFrame(rows, "file string, text string").repartition(3, "file")
        clusters, nodes = documents.parse_clusters(texts, "json")
        (row,) = clusters.withColumn("data", F.to_json("data")).collect()
        assert tuple(row)[:8] == tuple(whole.values())[:8] and json.loads(row.data) == whole["data"]
        assert nodes.count() == (20 if pages[0] in given else 0)
    for key, value in (("talosVersion", "1.11"), ("secureboot", False), ("data", {"b": 2})):
        rows = [("f", json.dumps(whole)), ("g", json.dumps({"clusterName": "c", key: value}))]
        clusters, _ = documents.parse_clusters(spark.createDataFrame(rows, "file string, text string"), "json")
        column = documents._SETTINGS.get(key, key)
        with pytest.raises(PySparkException, match=f"c: documents disagree on {column}"):
            clusters.select("cluster_name").collect()


def configs(spark, rows):
    return spark.createDataFrame(rows, "cluster_name string, host string, config string, error string")


def seen(spark, folder):
    return {(r.cluster_name, r.host, r.config, r.error, r.run) for r in sinks.published(spark, folder).collect()}


def test_a_run_that_dies_is_never_read(spark, tmp_path):
    folder = str(tmp_path / "out")
    with pytest.raises(ValueError):
        sinks.published(spark, folder)
    dies = F.when(F.col("host") == "h9", F.raise_error(F.lit("lost"))).otherwise(F.col("config"))
    half = [("a", "h1", "half", None), ("b", "h9", "half", None), (None, "h3", "half", None)]
    with pytest.raises(PySparkException):
        sinks.publish(configs(spark, half).withColumn("config", dies), folder, "one")
    with pytest.raises(ValueError):
        sinks.published(spark, folder)
    sinks.publish(configs(spark, [("a", "h1", "x", None), ("b", "h1", None, "bad"), (None, "h1", "n", None)]), folder, "one")
    first = {("a", "h1", "x", None, "one"), ("b", "h1", None, "bad", "one"), (None, "h1", "n", None, "one")}
    assert seen(spark, folder) == first
    with pytest.raises(PySparkException):
        sinks.publish(configs(spark, half).withColumn("config", dies), folder, "two")
    assert seen(spark, folder) == first
    # Done again under its name; clusters that it does not have stay as they were.
    sinks.publish(configs(spark, [("b", "h9", "y", None), (None, "h3", "m", None)]), folder, "two")
    assert seen(spark, folder) == {("a", "h1", "x", None, "one"), ("b", "h9", "y", None, "two"), (None, "h3", "m", None, "two")}
    with pytest.raises(ValueError):
        sinks.publish(configs(spark, half), folder, "two")


def test_changes_of_layer_files(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "my layers+1")
    put = lambda *rows: sinks.write_files(spark.createDataFrame(list(rows), "file string, text string"), root)
    found = lambda df: {(r.cluster_name, r.scope, r.scope_value, r.layer_path): (r.change, r.text) for r in df.collect()}
    listing, changes = documents.discover_changes(spark, root)
    assert listing.count() == changes.count() == 0
    odd = "a [1]{2}*?%41.yaml"
    assert put(("east/all/" + odd, "odd"), ("east/node/e1/d.yaml", "one\ntwo"), ("east/worker/w.yml", ""), ("east/worker/full.yml", "text"), ("east/all/x.md", "no")) == 5
    listing, changes = documents.discover_changes(spark, root)
    assert found(changes) == {
        ("east", "all", None, odd): ("new", "odd"),
        ("east", "node", "e1", "d.yaml"): ("new", "one\ntwo"),
        ("east", "role", "worker", "full.yml"): ("new", "text"),
    }
    assert documents.discover_changes(spark, root, listing)[1].count() == 0
    put(("east/all/" + odd, "changed"), ("east/node/e1/d.yaml", None), ("west/all/deep/er/w.yaml", "west"), ("west/gone.yaml", None), ("east/worker/full.yml", ""))
    after = {
        ("east", "role", "worker", "full.yml"): ("gone", None),
        ("east", "all", None, odd): ("changed", "changed"),
        ("east", "node", "e1", "d.yaml"): ("gone", None),
        ("west", "all", None, "deep/er/w.yaml"): ("new", "west"),
    }
    assert found(documents.discover_changes(spark, root, listing)[1]) == after
    monkeypatch.setattr(documents, "NAMED_FILES", 1)
    assert found(documents.discover_changes(spark, root, listing)[1]) == after


def test_only_changed_layer_files_are_opened(spark, tmp_path):
    root = str(tmp_path / "layers")
    put = lambda *rows: sinks.write_files(spark.createDataFrame(list(rows), "file string, text string"), root)
    put(*[(f"c{i}/all/a.yaml", "x") for i in range(30)])
    listing, _ = documents.discover_changes(spark, root)
    put(("c3/all/a.yaml", "longer"))
    _, changes = documents.discover_changes(spark, root, listing)
    assert [r.text for r in changes.collect()] == ["longer"]
    opened = [path for path in changes.inputFiles() if path.endswith(".yaml")]
    assert len(opened) == 1 and opened[0].endswith("c3/all/a.yaml")


def test_many_layer_folders_take_few_tasks(spark, tmp_path, monkeypatch):
    root, most, context = str(tmp_path / "layers"), task_count(spark), spark.sparkContext
    folders = max(40, 2 * most)
    rows = [(f"c/node/h{i}/a.yaml", str(i)) for i in range(folders)]
    sinks.write_files(spark.createDataFrame(rows, "file string, text string"), root)
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    for named in (10_000, 1):
        monkeypatch.setattr(documents, "NAMED_FILES", named)
        context.setJobGroup(f"listing-{named}", "")
        try:
            _, changes = documents.discover_changes(spark, root)
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        tracker = context.statusTracker()
        jobs = [tracker.getJobInfo(job) for job in tracker.getJobIdsForGroup(f"listing-{named}")]
        stages = [tracker.getStageInfo(stage) for job in jobs for stage in job.stageIds]
        assert stages and max(stage.numTasks for stage in stages if stage) <= most
        assert {(r.scope_value, r.text) for r in changes.collect()} == {(f"h{i}", str(i)) for i in range(folders)}
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before


def test_last_row_of_a_file_name_counts(spark, tmp_path):
    rows = [("c/all/a.yaml", "x" * 100_000), ("c/all/a.yaml", None), ("c/all/a.yaml", "last")]
    for parts in (1, 3):
        sinks.write_files(spark.createDataFrame(rows, "file string, text string").coalesce(parts), str(tmp_path / f"{parts}"))
        assert (tmp_path / f"{parts}/c/all/a.yaml").read_text() == "last"


def test_file_names_stay_below_the_root(spark, tmp_path):
    rows = spark.createDataFrame([("../x.yaml", "x")], "file string, text string")
    with pytest.raises(PySparkException):
        sinks.write_files(rows, str(tmp_path / "layers"))
