"""Queries over nested documents, layers, templates and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetloom.functions.columns import is_encrypted, path_key, trim_space
from fleetloom.operators import layers, nested, templates
from fleetloom.operators.ordered import pages
from fleetloom.queries.registry import FLEET_SQL, fleet, query, table
from fleetloom.session import cut_lineage, shared_path, spread
from fleetloom.plans.render import render
from fleetloom.sources import documents, places, sinks


@query(
    """
    WITH docs AS (
      SELECT o_orderkey, 0 AS doc_index, '{"status":"' || o_orderstatus || '"}' AS body, o_orderpriority
      FROM orders
      UNION ALL
      SELECT o_orderkey, 1, '{"priority":"' || o_orderpriority || '"}', o_orderpriority FROM orders)
    SELECT o_orderkey, doc_index, body, CAST(NULL AS VARCHAR) AS error FROM docs
    WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')
    UNION ALL
    SELECT o_orderkey, 2, NULL, CASE o_orderpriority WHEN '5-LOW' THEN 'expected a mapping'
                                ELSE 'list of operations is not supported' END
    FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')
    """
)
def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    text = F.concat_ws(
        "\n---\n",
        F.concat(F.lit('{"status":"'), status, F.lit('"}')),
        F.when(status == "F", F.lit("# nothing here")).when(status == "O", F.lit("{}")).otherwise(F.lit("")),
        F.concat(F.lit('{"priority":"'), priority, F.lit('"}')),
        F.when(priority == "1-URGENT", F.lit('[{"op": "remove"}]')).when(priority == "5-LOW", F.lit('"text"')),
    )
    orders = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    texts = orders.select("o_orderkey", text.alias("text"))
    return documents.split_documents(texts, "text").withColumn("body", trim_space("body"))


def _order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.struct(
        F.struct(
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("priority"),
            F.year("o_orderdate").alias("year"),
        ).alias("order"),
        F.when(F.col("o_orderstatus") == "F", F.lit("")).otherwise(F.col("o_orderpriority")).alias("note"),
        F.array(
            F.struct(F.lit("a").alias("k"), F.col("o_orderstatus").alias("v")),
            F.struct(F.lit("b").alias("k"), F.col("o_orderpriority").alias("v")),
        ).alias("tags"),
    )
    orders = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    return orders.select("o_orderkey", F.parse_json(F.to_json(doc)).alias("doc"))


@query(
    """
    SELECT o_orderkey, 'order.status' AS path, 'string' AS kind, o_orderstatus AS value FROM orders
    UNION ALL SELECT o_orderkey, 'order.priority', 'string', o_orderpriority FROM orders
    UNION ALL SELECT o_orderkey, 'order.year', 'scalar', CAST(year(o_orderdate) AS VARCHAR) FROM orders
    UNION ALL SELECT o_orderkey, 'note', 'string', CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END
              FROM orders
    UNION ALL SELECT o_orderkey, 'tags.0.k', 'string', 'a' FROM orders
    UNION ALL SELECT o_orderkey, 'tags.0.v', 'string', o_orderstatus FROM orders
    UNION ALL SELECT o_orderkey, 'tags.1.k', 'string', 'b' FROM orders
    UNION ALL SELECT o_orderkey, 'tags.1.v', 'string', o_orderpriority FROM orders
    """
)
def flatten_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = nested.flatten_leaves(_order_documents(spark, sf_dir), "doc", max_depth=4)
    return leaves.withColumn("path", F.array_join("path", "."))


@query(
    """
    SELECT event_id, true AS found, json_extract_string(props, '$.k') AS value, false AS item_found
    FROM events
    """
)
def value_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("doc"))
    wrong_kind = nested.value_at(docs, "doc", ["k", 0], out="_none").withColumnRenamed("found", "item_found")
    return nested.value_at(wrong_kind, "doc", ["k"]).select("event_id", "found", "value", "item_found")


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'tags.7.v' ELSE 'tags.1.v' END AS path,
           o_orderstatus <> 'O' AS found, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS value
    FROM orders
    """
)
def values_at_row_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "O", F.split(F.lit("tags.7.v"), "\\."))
        .otherwise(F.split(F.lit("tags.1.v"), "\\."))
        .alias("path"),
    )
    asked = wanted.join(_order_documents(spark, sf_dir), "o_orderkey")
    found = nested.values_at_paths(asked, "doc", "path", max_depth=4)
    return found.select("o_orderkey", F.array_join("path", ".").alias("path"), "found", "value")


@query(
    "SELECT page_id FROM pages WHERE url LIKE 'https://%' OR regexp_matches(url, '[?&]ref=')"
)
def docs_with_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    link = F.when(url.startswith("https://"), F.concat(F.lit("ref+"), url)).otherwise(url)
    extra = F.when(url.rlike("[?&]ref="), F.lit("ref+vault://page#/link")).otherwise(F.lit("ref+none"))
    doc = F.struct(F.struct(link.alias("link")).alias("meta"), F.array(F.lit("plain"), extra).alias("items"))
    pages_docs = table(spark, sf_dir, "pages").select("page_id", F.parse_json(F.to_json(doc)).alias("doc"))
    return nested.docs_with_refs(nested.flatten_leaves(pages_docs, "doc", max_depth=4), ["page_id"])


@query(
    """
    SELECT o_orderkey AS file, 0 AS doc_index, 'spec.status' AS path, o_orderstatus AS secret
    FROM orders WHERE o_orderpriority > '2'
    UNION ALL
    SELECT o_orderkey, 1, 'tokens.0', o_orderpriority FROM orders WHERE o_orderstatus = 'F'
    """
)
def extract_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encrypted fields of two documents per order and their plain values.

    Urgent orders have no encrypted status, open ones an empty token, and the
    second document of pending ones cannot be decoded.
    """
    orders = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    sealed = lambda text: F.concat(F.lit("ENC["), F.sha2(text, 256), F.lit("]"))

    def two(first, second) -> DataFrame:
        return orders.select(
            F.col("o_orderkey").alias("file"),
            F.posexplode(F.array(F.to_json(first), second)).alias("doc_index", "text"),
        ).select("file", "doc_index", documents.parse_whole("text").alias("doc"))

    def first(value):
        return F.struct(F.struct(value.alias("status")).alias("spec"), F.lit("plain").alias("other"))

    def second(value):
        tokens = F.to_json(F.struct(F.array(value).alias("tokens")))
        return F.when(status == "P", F.lit("{broken")).otherwise(tokens)

    before = two(
        first(F.when(priority > "2", sealed(status)).otherwise(status)), second(sealed(priority))
    )
    after = two(
        first(status), second(F.when(status == "O", F.lit("")).otherwise(priority))
    )
    secrets = nested.extract_changed(before, after, is_encrypted, max_depth=4)
    return secrets.withColumn("path", F.array_join("path", "."))


@query(
    f"""
    WITH {FLEET_SQL}
    SELECT host, 0 AS template, cluster_name || '-' || host || ' runs as ' || role AS text,
           CAST(NULL AS VARCHAR) AS error FROM fleet
    UNION ALL
    SELECT host, 1, CASE WHEN segment <> 'HOUSEHOLD' THEN 'zone: ' || segment || chr(10) END,
           CASE WHEN segment = 'HOUSEHOLD' THEN 'missing key: Data.zone' END FROM fleet
    UNION ALL
    SELECT host, 2, NULL, 'unsupported template action' FROM fleet
    """
)
def fill_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three templates per node, one of them with an action that is not a key."""
    texts = [
        "{{ .ClusterName }}-{{.Node.Host}} runs as {{ .Node.Role }}",
        "zone: {{ .Data.zone }}\n",
        "{{ if .Data.zone }}on{{ end }}",
    ]
    known = F.create_map(
        F.lit("ClusterName"),
        F.col("cluster_name").cast("string"),
        F.lit("Node.Host"),
        F.col("host"),
        F.lit("Node.Role"),
        F.col("role"),
    )
    zone = F.when(F.col("segment") != "HOUSEHOLD", F.create_map(F.lit("Data.zone"), F.col("segment"))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    rows = fleet(spark, sf_dir).select(
        "host",
        F.map_concat(known, zone).alias("context"),
        F.posexplode(F.array(*map(F.lit, texts))).alias("template", "body"),
    )
    filled = templates.fill_templates(rows, "body", "context")
    return filled.select("host", "template", "text", "error")


@query(
    f"""
    WITH {FLEET_SQL}, n AS (
      SELECT f.*, r_name FROM fleet f JOIN nation ON n_nationkey = cluster_name
      JOIN region ON r_regionkey = n_regionkey)
    SELECT cluster_name, host, 'machine.install.disk' AS path,
           CASE WHEN acctbal > 5000 THEN '/dev/nvme0' ELSE '/dev/sda' END AS value,
           CASE WHEN acctbal > 5000 THEN 3 ELSE 1 END AS layer_rank
    FROM n WHERE role = 'worker' OR acctbal > 5000
    UNION ALL SELECT cluster_name, host, 'machine.install.wipe', 'true', 1 FROM n WHERE role = 'worker'
    UNION ALL SELECT cluster_name, host, 'machine.labels.region', r_name, 1 FROM n WHERE segment <> 'BUILDING'
    UNION ALL SELECT cluster_name, host, 'machine.labels', 'none', 3 FROM n WHERE segment = 'BUILDING'
    UNION ALL SELECT cluster_name, host, 'mirrors', CASE WHEN role = 'worker' THEN '["a","b"]' ELSE '["c"]' END,
                     CASE WHEN role = 'worker' THEN 1 ELSE 2 END FROM n
    """
)
def merged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents merged with subtree rules: delete markers, scalars over maps, lists."""
    nodes = fleet(spark, sf_dir)
    places = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_nationkey").alias("cluster_name"), "r_name")
    )

    def layer(df: DataFrame, scope: str, value, body) -> DataFrame:
        return df.select(
            "cluster_name",
            F.lit(scope).alias("scope"),
            value.cast("string").alias("scope_value"),
            F.lit("20-machine.yaml").alias("layer_path"),
            F.lit(0).alias("doc_index"),
            body.alias("body"),
        )

    shared = F.concat(
        F.lit('{"machine":{"install":{"disk":"/dev/sda","wipe":true},"labels":{"region":"'),
        F.col("r_name"),
        F.lit('"}},"mirrors":["a","b"]}'),
    )
    stacked = layer(places, "all", F.lit(None), shared)
    for part in (
        layer(
            places,
            "role",
            F.lit("control-plane"),
            F.lit('{"machine":{"install":{"$patch":"delete"}},"mirrors":["c"]}'),
        ),
        layer(
            nodes.where(F.col("acctbal") > 5000),
            "node",
            F.col("host"),
            F.lit('{"machine":{"install":{"disk":"/dev/nvme0"}}}'),
        ),
        layer(
            nodes.where(F.col("segment") == "BUILDING"),
            "node",
            F.col("host"),
            F.lit('{"machine":{"labels":"none"}}'),
        ),
    ):
        stacked = stacked.unionByName(part)
    leaves = nested.flatten_leaves(
        stacked.withColumn("body", F.parse_json("body")),
        "body",
        max_depth=4,
        walk_lists=False,
        directives=True,
    )
    return layers.merged_settings(nodes, leaves).select(
        "cluster_name",
        "host",
        F.array_join("path", ".").alias("path"),
        "value",
        F.col("precedence.layer_rank").alias("layer_rank"),
    )


@query(
    f"""
    WITH {FLEET_SQL}, layers AS (
      SELECT n_nationkey AS cluster_name, 'all' AS scope, NULL AS scope_value, 'a/b.yaml' AS layer_path FROM nation
      UNION ALL SELECT n_nationkey, 'all', NULL, 'a.yaml' FROM nation
      UNION ALL SELECT n_nationkey, 'role', 'worker', 'w.yaml' FROM nation
      UNION ALL SELECT n_nationkey, 'base', NULL, 'image' FROM nation
      UNION ALL SELECT cluster_name, 'node', host, 'n.yaml' FROM fleet WHERE acctbal > 5000),
    applied AS (
      SELECT l.cluster_name, host, scope, layer_path,
             CASE scope WHEN 'base' THEN 0 WHEN 'all' THEN 1 WHEN 'role' THEN 2 ELSE 3 END AS layer_rank
      FROM layers l JOIN fleet f ON f.cluster_name = l.cluster_name
        AND (scope IN ('base', 'all') OR (scope = 'role' AND scope_value = role)
             OR (scope = 'node' AND scope_value = host)))
    SELECT cluster_name, host, scope, layer_path, layer_rank,
           layer_path = 'a/b.yaml' AS in_folder
    FROM applied
    """
)
def applicable_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = fleet(spark, sf_dir)
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cluster_name"))

    def layer(df: DataFrame, scope: str, value, path: str) -> DataFrame:
        return df.select(
            "cluster_name",
            F.lit(scope).alias("scope"),
            value.cast("string").alias("scope_value"),
            F.lit(path).alias("layer_path"),
            F.lit(0).alias("doc_index"),
        )

    stacked = layer(nations, "all", F.lit(None), "a/b.yaml")
    for part in (
        layer(nations, "all", F.lit(None), "a.yaml"),
        layer(nations, "role", F.lit("worker"), "w.yaml"),
        layer(nations, "base", F.lit(None), "image"),
        layer(nodes.where(F.col("acctbal") > 5000), "node", F.col("host"), "n.yaml"),
    ):
        stacked = stacked.unionByName(part)
    applied = layers.with_precedence(layers.applicable_layers(nodes, stacked))
    return applied.select(
        "cluster_name",
        "host",
        "scope",
        "layer_path",
        F.col("precedence.layer_rank").alias("layer_rank"),
        (F.size(path_key("layer_path")) > 1).alias("in_folder"),
    )


@query(
    f"""
    WITH {FLEET_SQL}
    SELECT 'c' || cluster_name AS cluster_name,
           CASE segment WHEN 'BUILDING' THEN 'all' WHEN 'FURNITURE' THEN 'role' ELSE 'node' END AS scope,
           CASE segment WHEN 'BUILDING' THEN NULL WHEN 'FURNITURE' THEN 'worker' ELSE host END AS scope_value,
           CASE segment WHEN 'BUILDING' THEN 'net/10.yml' WHEN 'FURNITURE' THEN '20.yaml.tpl'
             ELSE '30.yaml' END AS layer_path, host
    FROM fleet WHERE segment NOT IN ('AUTOMOBILE', 'MACHINERY')
    """
)
def discover_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes read from layer paths; other folders and file kinds are left out."""
    segment = F.col("segment")
    inside = (
        F.when(segment == "BUILDING", F.lit("all/net/10.yml"))
        .when(segment == "FURNITURE", F.lit("worker/20.yaml.tpl"))
        .when(segment == "AUTOMOBILE", F.lit("all/readme.md"))
        .when(segment == "MACHINERY", F.lit("other/40.yaml"))
        .otherwise(F.concat(F.lit("node/"), F.col("host"), F.lit("/30.yaml")))
    )
    files = fleet(spark, sf_dir).select(
        "host", F.concat(F.lit("c"), F.col("cluster_name"), F.lit("/"), inside).alias("file")
    )
    return documents.classify_layer_paths(files, "file")


@query(
    f"""
    WITH {FLEET_SQL}, place AS (
      SELECT n_nationkey, n_name, 's3a://conf/' || CASE n_nationkey % 3 WHEN 0 THEN 'clusters/' || n_name
               WHEN 1 THEN 'shared/r' || n_regionkey ELSE 'own/' || n_nationkey END AS layer_root,
             's3a://conf/' || CASE WHEN n_nationkey % 2 = 0 THEN 'clusters/' || n_name || '/secrets.yaml'
               ELSE 'keys/' || n_name END AS secrets_file FROM nation),
    held AS (
      SELECT DISTINCT layer_root, 'all' AS scope, NULL AS scope_value, 'net/10.yml' AS layer_path, n_nationkey
      FROM fleet JOIN place ON n_nationkey = cluster_name
      UNION ALL
      SELECT layer_root, 'node', host, 'all/30.yaml', n_nationkey FROM fleet JOIN place ON n_nationkey = cluster_name
      WHERE segment = 'HOUSEHOLD')
    SELECT n_name AS cluster_name, p.layer_root, secrets_file, scope, scope_value, layer_path, h.n_nationkey AS written_for
    FROM held h JOIN place p ON p.layer_root = h.layer_root
    """
)
def layers_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer folders and secrets as cluster documents tell them; clusters of a region share some folders."""
    nation, key = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    relative = F.concat(F.lit("../.././shared//r"), "n_regionkey")
    absolute = F.concat(F.lit("/own/"), key, F.lit("/"))
    text = F.struct(
        F.col("n_name").alias("clusterName"),
        F.when(key % 3 == 1, relative).when(key % 3 == 2, absolute).alias("patchesDir"),
        F.when(key % 2 == 1, F.concat(F.lit("s3a://conf/keys/x/../"), "n_name")).alias("secretsPath"),
    )
    file = F.concat(F.lit("s3a://conf/clusters/"), "n_name", F.lit("/cluster.json"))
    found = places.cluster_places(nation.select(file.alias("file"), F.to_json(text).alias("text")), "json")
    nodes = fleet(spark, sf_dir).join(nation, F.col("cluster_name") == key).drop("cluster_name")
    nodes = nodes.join(found, F.col("cluster_name") == F.col("n_name"))
    shared = nodes.select("n_nationkey", F.concat("layer_root", F.lit("/all/net/10.yml")).alias("file")).distinct()
    held = nodes.where("segment = 'HOUSEHOLD'")
    own = held.select("n_nationkey", F.concat("layer_root", F.lit("/node/"), "host", F.lit("/all/30.yaml")).alias("file"))
    elsewhere = nation.select("n_nationkey", F.lit("s3a://conf/other/all/10.yml").alias("file"))
    files = shared.unionByName(own).unionByName(elsewhere).withColumnRenamed("n_nationkey", "written_for")
    return places.layers_of_clusters(files, found).join(found, "cluster_name")


@query(
    f"""
    WITH {FLEET_SQL}, files AS (
      SELECT DISTINCT 'c' || cluster_name AS cluster_name, 'all' AS scope, NULL AS scope_value, 'net/10.yml' AS layer_path,
             '{{"net": "' || cluster_name || '"}}' AS text, NULL AS later, false AS goes FROM fleet
      UNION ALL
      SELECT 'c' || cluster_name, 'node', host, '30.yaml', '{{"segment": "' || segment || '"}}',
             CASE WHEN acctbal < 0 THEN '{{"debt": true}}' END, acctbal > 9000
      FROM fleet WHERE segment = 'HOUSEHOLD')
    SELECT 1 AS step, cluster_name, scope, scope_value, layer_path, 'new' AS change, text FROM files
    UNION ALL
    SELECT 2, cluster_name, scope, scope_value, layer_path, CASE WHEN goes THEN 'gone' ELSE 'changed' END, later
    FROM files WHERE goes OR later IS NOT NULL
    UNION ALL
    SELECT DISTINCT 2, 'c' || cluster_name, 'role', 'worker', '20.yaml.tpl', 'new', 'added' FROM fleet
    """
)
def layer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer files are written, discovered, changed, removed and added, and discovered again."""
    nodes, root = fleet(spark, sf_dir), shared_path(spark, "layers")
    cluster = F.concat(F.lit("c"), F.col("cluster_name"))
    clusters = nodes.select("cluster_name").distinct()
    held = nodes.where(F.col("segment") == "HOUSEHOLD")
    shared = lambda path, text: clusters.select(F.concat(cluster, F.lit(path)).alias("file"), text.alias("text"))
    own = F.concat(cluster, F.lit("/node/"), F.col("host"), F.lit("/30.yaml")).alias("file")
    first = held.select(own, F.to_json(F.struct("segment")).alias("text"))
    first = first.withColumn("text", F.replace("text", F.lit(":"), F.lit(": ")))
    net = F.concat(F.lit('{"net": "'), F.col("cluster_name"), F.lit('"}'))
    ignored = shared("/all/readme.md", F.lit("no layer"))
    sinks.write_files(shared("/all/net/10.yml", net).unionByName(first).unionByName(ignored), root)
    known, new = documents.discover_changes(spark, root)
    new = cut_lineage(new)
    debt = held.where("acctbal < 0").select(own, F.lit('{"debt": true}').alias("text"))
    gone = held.where("acctbal > 9000").select(own, F.lit(None).cast("string").alias("text"))
    sinks.write_files(debt.unionByName(gone).unionByName(shared("/worker/20.yaml.tpl", F.lit("added"))), root)
    _, later = documents.discover_changes(spark, root, known)
    return new.select(F.lit(1).alias("step"), "*").unionByName(later.select(F.lit(2).alias("step"), "*"))


@query(
    f"""
    WITH {FLEET_SQL}
    SELECT cluster_name, host, CASE WHEN acctbal >= 0 OR segment = 'BUILDING' THEN 'role: ' || role END AS config,
           CASE WHEN acctbal < 0 AND segment <> 'BUILDING' THEN 'no config' END AS error,
           CASE WHEN acctbal >= 0 OR segment = 'BUILDING' THEN 'configs' ELSE 'errors' END AS outcome, 'first' AS run
    FROM fleet WHERE cluster_name <> 7
    UNION ALL
    SELECT cluster_name, host, 'again: ' || role, NULL, 'configs', 'second' FROM fleet WHERE cluster_name = 7
    """
)
def published_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clusters are published, one is published again, and a run that died before its manifest shows nothing."""
    folder = shared_path(spark, "published")
    failed = (F.col("acctbal") < 0) & (F.col("segment") != "BUILDING")
    nodes = fleet(spark, sf_dir)
    rows = nodes.select(
        "cluster_name", "host", F.when(~failed, F.concat(F.lit("role: "), "role")).alias("config"),
        F.when(failed, F.lit("no config")).alias("error"),
    )
    sinks.publish(rows, folder, "first")
    again = nodes.where("cluster_name = 7").select(
        "cluster_name", "host", F.concat(F.lit("again: "), "role").alias("config"), F.lit(None).cast("string").alias("error")
    )
    sinks.publish(again, folder, "second")
    sinks.write_by_host(rows.withColumn("config", F.lit("half a run")), f"{folder}/runs/run=third")
    return sinks.published(spark, folder)


@query(
    f"""
    WITH {FLEET_SQL}
    SELECT cluster_name, host, CASE WHEN acctbal >= 0 THEN 'role: ' || role || chr(10) END AS config,
           CASE WHEN acctbal < 0 THEN 'no config' END AS error
    FROM fleet
    """
)
def write_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = fleet(spark, sf_dir).select(
        "cluster_name",
        "host",
        F.concat(F.lit("role: "), F.col("role"), F.lit("\n")).alias("config"),
        F.when(F.col("acctbal") < 0, F.lit("no config")).alias("error"),
    )
    good, bad = sinks.write_by_host(rendered, shared_path(spark, "rendered"))
    written = spark.read.schema("host string, config string, cluster_name int").parquet(good)
    failed = spark.read.schema("cluster_name int, host string, error string").parquet(bad)
    return written.unionByName(failed, allowMissingColumns=True)


@query(
    f"""
    WITH {FLEET_SQL}, placed AS (
      SELECT * FROM fleet)
    SELECT n_name AS cluster_name, 'https://' || lower(n_name) || ':6443' AS cluster_endpoint,
           host, role, ip, segment AS platform, acctbal < 0 AS secureboot
    FROM placed JOIN nation ON n_nationkey = cluster_name
    """
)
def load_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters written as text, in documents of up to 500 nodes under one name, and loaded again."""
    entry = F.struct("host", "ip", "role", F.col("segment").alias("platform"), (F.col("acctbal") < 0).alias("secureboot"))
    lists = pages(fleet(spark, sf_dir), ["cluster_name"], ["host"], entry, 500, "nodes")
    nation = table(spark, sf_dir, "nation")
    texts = lists.join(nation, F.col("cluster_name") == F.col("n_nationkey")).select(
        F.to_json(
            F.struct(
                F.col("n_name").alias("clusterName"),
                F.concat(F.lit("https://"), F.lower("n_name"), F.lit(":6443")).alias("clusterEndpoint"),
                "nodes",
            )
        )
    )
    folder = shared_path(spark, "clusters")
    texts.write.text(folder)
    clusters, nodes = documents.load_clusters(spark, folder, encoding="json", layout="line")
    return nodes.join(clusters.select("cluster_name", "cluster_endpoint"), "cluster_name").select(
        "cluster_name", "cluster_endpoint", "host", "role", "ip", "platform", "secureboot"
    )


@query(
    f"""
    WITH {FLEET_SQL}, n AS (
      SELECT f.*, n_name, segment = 'HOUSEHOLD' AS bad FROM fleet f JOIN nation ON n_nationkey = cluster_name)
    SELECT cluster_name, host, 'machine.install.image' AS path,
           CASE WHEN role = 'control-plane' THEN 'pinned'
             ELSE 'factory.talos.dev/' || CASE WHEN segment = 'BUILDING' THEN 'vmware' ELSE 'metal' END
                  || '-installer/' || sha256('id: ' || n_name || chr(10)) || ':v1.13.0' END AS value,
           CAST(NULL AS VARCHAR) AS error
    FROM n WHERE NOT bad
    UNION ALL SELECT cluster_name, host, 'name', host || '.' || lower(n_name), NULL FROM n WHERE NOT bad
    UNION ALL SELECT cluster_name, host, 'kubelet.max', CASE WHEN acctbal > 5000 THEN '250' ELSE '100' END, NULL
              FROM n WHERE NOT bad
    UNION ALL SELECT cluster_name, host, NULL, NULL, '30-name.json.yaml.tpl: missing key: Node.Data.zone'
              FROM n WHERE bad
    """
)
def rendered_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: defaults, references, layers, templates, merge, errors per node."""
    nation = table(spark, sf_dir, "nation")
    nothing = F.lit(None).cast("string")
    clusters = nation.select(
        F.col("n_nationkey").alias("cluster_name"),
        F.concat(F.lit("https://"), F.lower("n_name"), F.lit(":6443")).alias("cluster_endpoint"),
        F.lit("v1.34.1").alias("kubernetes_version"),
        nothing.alias("talos_version"),
        F.concat(F.lit("@"), "n_name").alias("schematic_id"),
        nothing.alias("factory"),
        nothing.alias("platform"),
        F.lit(False).alias("secureboot"),
        F.parse_json(F.to_json(F.struct(F.lower("n_name").alias("domain")))).alias("data"),
    )
    segment = F.col("segment")
    nodes = fleet(spark, sf_dir).select(
        "cluster_name",
        "host",
        "role",
        "ip",
        nothing.alias("talos_version"),
        nothing.alias("schematic_id"),
        nothing.alias("factory"),
        F.when(segment == "BUILDING", F.lit("vmware")).alias("platform"),
        F.lit(False).alias("secureboot"),
        F.when(segment != "HOUSEHOLD", F.parse_json(F.to_json(F.struct(segment.alias("zone"))))).alias("data"),
        "acctbal",
    )
    definitions = nation.select(
        F.col("n_name").alias("path"), F.concat(F.lit("id: "), "n_name", F.lit("\n")).alias("definition")
    )

    def layer(df: DataFrame, scope: str, value, path: str, text: str) -> DataFrame:
        return df.select(
            "cluster_name",
            F.lit(scope).alias("scope"),
            value.cast("string").alias("scope_value"),
            F.lit(path).alias("layer_path"),
            F.lit(text).alias("text"),
        )

    files = layer(clusters, "all", F.lit(None), "10.yaml", '{"kubelet": {"max": 100}}')
    for part in (
        layer(
            clusters,
            "role",
            F.lit("control-plane"),
            "20.yaml",
            '{}\n---\n{"machine": {"install": {"image": "pinned"}}}',
        ),
        layer(
            clusters,
            "all",
            F.lit(None),
            "30-name.json.yaml.tpl",
            '{"name": "{{ .Node.Host }}.{{ .Data.domain }}", "zone": "{{ .Node.Data.zone }}"}\n'
            '---\n{"zone": {"$patch": "delete"}}',
        ),
        layer(nodes.where(F.col("acctbal") > 5000), "node", F.col("host"), "40.yaml", '{"kubelet": {"max": 250}}'),
    ):
        files = files.unionByName(part)
    settings, errors = render(
        nodes.drop("acctbal"), clusters, files, definitions, "v1.13.0", encoding="json", max_depth=4
    )
    return settings.select(
        "cluster_name", "host", F.array_join("path", ".").alias("path"), "value"
    ).unionByName(errors, allowMissingColumns=True)
