"""Queries over node tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetloom.functions.columns import (
    connect_endpoint,
    effective_parallel,
    parse_ref,
    path_key,
    url_part,
    version_gte,
)
from fleetloom.operators import health, layers, nodes as node_ops, refs
from fleetloom.operators.ordered import ordinals
from fleetloom.plans import incremental
from fleetloom.queries.registry import FLEET_SQL, fleet, query, table
from fleetloom.session import shared_path


@query(
    """
    WITH customers AS (
      SELECT c_nationkey AS cluster_name, c_name AS host, c_custkey, c_acctbal, c_mktsegment,
             CASE WHEN c_mktsegment = 'MACHINERY' THEN 'control-plane' ELSE 'worker' END AS role
      FROM customer),
    load AS (
      SELECT cluster_name, role, CAST(count(*) AS VARCHAR) AS orders
      FROM customers JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
    applied AS (
      SELECT c.cluster_name, host, role, 'install.image' AS path, 'img-' || n_regionkey AS value, 0 AS ord
      FROM customers c JOIN nation ON n_nationkey = c.cluster_name
      UNION ALL
      SELECT c.cluster_name, host, role, 'labels.region', r_name, 1
      FROM customers c JOIN nation ON n_nationkey = c.cluster_name JOIN region ON r_regionkey = n_regionkey
      UNION ALL
      SELECT cluster_name, host, role, 'limits.max', '100', 1 FROM customers
      UNION ALL
      SELECT c.cluster_name, host, c.role, 'limits.max', orders, 2
      FROM customers c JOIN load l ON l.cluster_name = c.cluster_name AND l.role = c.role
      WHERE c.role = 'control-plane'
      UNION ALL
      SELECT cluster_name, host, role, 'limits.max', CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR), 3
      FROM customers WHERE c_acctbal > 5000
      UNION ALL
      SELECT cluster_name, host, role, 'install.image', 'pinned', 3
      FROM customers WHERE c_mktsegment = 'BUILDING')
    SELECT cluster_name, host, role, path, max_by(value, ord) AS value, max(ord) AS layer_rank
    FROM applied GROUP BY cluster_name, host, role, path
    """
)
def layered_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: cluster, role and node layers merged for every node."""
    nodes = fleet(spark, sf_dir)
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    orders = table(spark, sf_dir, "orders").select("o_custkey")
    clusters = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("cluster_name"), "n_regionkey", "r_name"
    )

    def layer(df: DataFrame, scope: str, scope_value, path: list[str], value) -> DataFrame:
        return df.select(
            "cluster_name",
            F.lit(scope).alias("scope"),
            scope_value.cast("string").alias("scope_value"),
            F.lit("10-settings.yaml").alias("layer_path"),
            F.lit(0).alias("doc_index"),
            F.array(*map(F.lit, path)).alias("path"),
            F.lit("string").alias("kind"),
            value.alias("value"),
        )

    nobody = F.lit(None)
    load = (
        nodes.where(F.col("role") == "control-plane")
        .join(orders, F.col("custkey") == F.col("o_custkey"))
        .groupBy("cluster_name", "role")
        .agg(F.count(F.lit(1)).cast("string").alias("orders"))
    )
    image, limit = ["install", "image"], ["limits", "max"]
    settings = [
        layer(clusters, "base", nobody, image, F.concat(F.lit("img-"), F.col("n_regionkey"))),
        layer(clusters, "all", nobody, ["labels", "region"], F.col("r_name")),
        layer(clusters, "all", nobody, limit, F.lit("100")),
        layer(load, "role", F.col("role"), limit, F.col("orders")),
        layer(
            nodes.where(F.col("acctbal") > 5000),
            "node",
            F.col("host"),
            limit,
            F.floor("acctbal").cast("string"),
        ),
        layer(nodes.where(F.col("segment") == "BUILDING"), "node", F.col("host"), image, F.lit("pinned")),
    ]
    stacked = settings[0]
    for part in settings[1:]:
        stacked = stacked.unionByName(part)
    return layers.merged_settings(nodes, stacked).select(
        "cluster_name",
        "host",
        "role",
        F.array_join("path", ".").alias("path"),
        "value",
        F.col("precedence.layer_rank").alias("layer_rank"),
    )


@query(
    """
    WITH customers AS (
      SELECT c_nationkey AS cluster_name, c_name AS host, c_custkey, c_acctbal, c_mktsegment,
             CASE WHEN c_mktsegment = 'MACHINERY' THEN 'control-plane' ELSE 'worker' END AS role
      FROM customer),
    applied AS (
      SELECT c.cluster_name, host, role, 'install.image' AS path, 'img-' || n_regionkey AS value, 0 AS ord
      FROM customers c JOIN nation ON n_nationkey = c.cluster_name
      UNION ALL
      SELECT c.cluster_name, host, role, 'labels.region', CASE WHEN n_nationkey % 5 = 0 THEN r_name || '-new' ELSE r_name END, 1
      FROM customers c JOIN nation ON n_nationkey = c.cluster_name JOIN region ON r_regionkey = n_regionkey
      UNION ALL
      SELECT cluster_name, host, role, 'limits.max', '100', 1 FROM customers WHERE cluster_name % 5 <> 0
      UNION ALL
      SELECT cluster_name, host, role, 'limits.max', '7', 2 FROM customers WHERE role = 'control-plane'
      UNION ALL
      SELECT cluster_name, host, role, 'limits.max', CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR), 3
      FROM customers WHERE c_acctbal > 5000 AND c_custkey % 10 <> 0
      UNION ALL
      SELECT cluster_name, host, role, 'install.image', 'pinned', 3
      FROM customers WHERE c_mktsegment = 'BUILDING')
    SELECT cluster_name, host, role, path, max_by(value, ord) AS value, max(ord) AS layer_rank
    FROM applied GROUP BY cluster_name, host, role, path
    """
)
def layered_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings kept as a store; the files of some clusters change, those of some nodes go."""
    nodes = fleet(spark, sf_dir)
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    clusters = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("cluster_name"), "n_regionkey", "r_name"
    )

    def layer(df: DataFrame, scope: str, value_of, name, path: str, value) -> DataFrame:
        return df.select(
            "cluster_name", F.lit(scope).alias("scope"), value_of.cast("string").alias("scope_value"), name.alias("layer_path"),
            F.lit(0).alias("doc_index"), F.split(F.lit(path), "[.]").alias("path"), F.lit("string").alias("kind"), value.alias("value"),
        )

    nobody, common = F.lit(None), F.lit("all/10-settings.yaml")
    limits = F.concat(F.lit("node/"), F.col("host"), F.lit("/limits.yaml"))
    image = F.concat(F.lit("node/"), F.col("host"), F.lit("/image.yaml"))
    rich = nodes.where(F.col("acctbal") > 5000)
    parts = [
        layer(clusters, "base", nobody, F.lit("base/10-image.yaml"), "install.image", F.concat(F.lit("img-"), F.col("n_regionkey"))),
        layer(clusters, "all", nobody, common, "labels.region", F.col("r_name")),
        layer(clusters, "all", nobody, common, "limits.max", F.lit("100")),
        layer(clusters, "role", F.lit("control-plane"), F.lit("control-plane/10-limits.yaml"), "limits.max", F.lit("7")),
        layer(rich, "node", F.col("host"), limits, "limits.max", F.floor("acctbal").cast("string")),
        layer(nodes.where(F.col("segment") == "BUILDING"), "node", F.col("host"), image, "install.image", F.lit("pinned")),
    ]
    store = incremental.MergedStore(spark, shared_path(spark, "layered-update"), shards=32)
    store.build(nodes, reduce(DataFrame.unionByName, parts))
    fifth = clusters.where(F.col("cluster_name") % 5 == 0)
    changed = layer(fifth, "all", nobody, common, "labels.region", F.concat("r_name", F.lit("-new")))
    gone = rich.where(F.col("custkey") % 10 == 0).select("cluster_name", limits.alias("layer_path"))
    store.update(nodes, changed, fifth.select("cluster_name", common.alias("layer_path")).unionByName(gone))
    return store.settings(nodes).select(
        "cluster_name", "host", "role", F.array_join("path", ".").alias("path"), "value", F.col("precedence.layer_rank").alias("layer_rank")
    )


@query(
    f"""
    WITH {FLEET_SQL}
    SELECT cluster_name, host, role, coalesce(ip, host) AS endpoint,
           row_number() OVER (PARTITION BY cluster_name
             ORDER BY CASE WHEN role = 'control-plane' THEN 0 ELSE 1 END, host) AS position
    FROM fleet WHERE regexp_matches(host, '[3-7][0-9]$')
    """
)
def nodes_filtered_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = node_ops.filter_nodes(fleet(spark, sf_dir), "[3-7][0-9]$")
    return node_ops.with_position(picked).select(
        "cluster_name", "host", "role", connect_endpoint().alias("endpoint"), "position"
    )


@query(
    f"""
    WITH {FLEET_SQL}
    SELECT cluster_name, min(host) FILTER (role = 'control-plane' AND acctbal >= 0) AS host,
           CASE WHEN min(host) FILTER (role = 'control-plane' AND acctbal >= 0) IS NULL
                THEN 'every control-plane node is out of reach' END AS error
    FROM fleet GROUP BY cluster_name
    """
)
def first_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_ops.first_reachable(fleet(spark, sf_dir), F.col("acctbal") >= 0)


@query(
    f"""
    WITH {FLEET_SQL}, combined AS (
      SELECT cluster_name, host, role, segment FROM fleet
      UNION ALL
      SELECT s_nationkey, s_name,
             CASE WHEN s_acctbal < 0 THEN '' WHEN s_acctbal > 9000 THEN 'storage' ELSE 'worker' END, NULL
      FROM supplier)
    SELECT cluster_name, host, role, segment,
           CASE WHEN role = '' THEN 'role is empty'
                WHEN role NOT IN ('worker', 'control-plane') THEN 'unknown role: ' || role
                ELSE '' END AS reasons
    FROM combined
    """
)
def nodes_union_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    static = fleet(spark, sf_dir).select("cluster_name", "host", "role", "segment")
    provided = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("cluster_name"),
        F.col("s_name").alias("host"),
        F.when(F.col("s_acctbal") < 0, F.lit(""))
        .when(F.col("s_acctbal") > 9000, F.lit("storage"))
        .otherwise(F.lit("worker"))
        .alias("role"),
    )
    checked = node_ops.validate_nodes(node_ops.add_nodes(static, provided))
    return checked.withColumn("reasons", F.array_join("reasons", "; "))


@query(
    f"""
    WITH {FLEET_SQL}
    SELECT cluster_name, role = 'control-plane' AS lead, count(*) AS nodes,
           count(ip) AS with_ip
    FROM fleet GROUP BY ALL
    """
)
def role_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead, rest = node_ops.partition_by_role(fleet(spark, sf_dir))
    marked = lead.withColumn("lead", F.lit(True)).unionByName(rest.withColumn("lead", F.lit(False)))
    return marked.groupBy("cluster_name", "lead").agg(
        F.count(F.lit(1)).alias("nodes"), F.count("ip").alias("with_ip")
    )


def _overrides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = fleet(spark, sf_dir).select(
        "cluster_name",
        "host",
        F.when(F.col("segment") == "BUILDING", F.lit("mirror.local"))
        .when(F.col("segment") == "FURNITURE", F.lit(""))
        .alias("factory"),
        F.when(F.col("segment") == "AUTOMOBILE", F.lit("vmware")).alias("platform"),
        F.when(F.col("acctbal") > 8000, F.sha2("host", 256)).alias("schematic_id"),
        F.when(F.col("acctbal") < 0, F.lit("v1.12.4")).otherwise(F.lit("")).alias("talos_version"),
        (F.col("segment") == "HOUSEHOLD").alias("secureboot"),
    )
    nation = table(spark, sf_dir, "nation")
    clusters = nation.select(
        F.col("n_nationkey").alias("cluster_name"),
        F.when(F.col("n_regionkey") == 1, F.lit("factory.internal")).otherwise(F.lit("")).alias("factory"),
        F.when(F.col("n_regionkey") == 2, F.lit("nocloud")).alias("platform"),
        F.when(F.col("n_regionkey") == 3, F.sha2("n_name", 256)).alias("schematic_id"),
        F.when(F.col("n_regionkey") >= 2, F.concat(F.lit("v1.13."), F.col("n_regionkey"))).alias("talos_version"),
        (F.col("n_regionkey") == 4).alias("secureboot"),
    )
    return nodes, clusters


_SETTLED_SQL = f"""WITH {FLEET_SQL}, settled AS (
      SELECT cluster_name, host,
        coalesce(nullif(CASE segment WHEN 'BUILDING' THEN 'mirror.local' WHEN 'FURNITURE' THEN '' END, ''),
                 CASE WHEN n_regionkey = 1 THEN 'factory.internal' END, 'factory.talos.dev') AS factory,
        coalesce(CASE WHEN segment = 'AUTOMOBILE' THEN 'vmware' END,
                 CASE WHEN n_regionkey = 2 THEN 'nocloud' END, 'metal') AS platform,
        coalesce(CASE WHEN acctbal > 8000 THEN sha256(host) END,
                 CASE WHEN n_regionkey = 3 THEN sha256(n_name) END,
                 '376567988ad370138ad8b2698212367b8edcb69b5fd68c80be1f2ec7d603b4ba') AS schematic_id,
        coalesce(CASE WHEN acctbal < 0 THEN '1.12.4' END,
                 CASE WHEN n_regionkey >= 2 THEN '1.13.' || n_regionkey END, '1.13.0') AS talos_version,
        segment = 'HOUSEHOLD' OR n_regionkey = 4 AS secureboot
      FROM fleet JOIN nation ON n_nationkey = cluster_name)"""


@query(f"{_SETTLED_SQL} SELECT * FROM settled")
def defaults_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, clusters = _overrides(spark, sf_dir)
    return node_ops.resolve_defaults(nodes, clusters, "v1.13.0")


@query(
    f"""{_SETTLED_SQL}, refs AS (
      SELECT cluster_name, host, factory || '/' || platform || '-installer'
             || CASE WHEN secureboot THEN '-secureboot' ELSE '' END
             || '/' || schematic_id || ':v' || talos_version AS installer FROM settled)
    SELECT cluster_name, host, installer,
           regexp_extract(installer, '^.*/([a-zA-Z0-9]+):v?(.+)$', 1) AS schematic,
           regexp_extract(installer, '^.*/([a-zA-Z0-9]+):v?(.+)$', 2) AS version
    FROM refs"""
)
def installer_ref_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, clusters = _overrides(spark, sf_dir)
    settled = node_ops.with_installer(node_ops.resolve_defaults(nodes, clusters, "v1.13.0"))
    parsed = settled.select("cluster_name", "host", "installer", parse_ref("installer").alias("p"))
    return parsed.select(
        "cluster_name", "host", "installer", F.col("p.schematic").alias("schematic"), F.col("p.version").alias("version")
    )


@query(
    """
    WITH v AS (
      SELECT p_partkey, p_size, p_type, p_retailprice,
             CASE WHEN p_type = 'PROMO' THEN ''
                  WHEN p_type = 'STANDARD' THEN 'nightly'
                  WHEN p_type = 'ECONOMY' THEN 'v1.' || p_size
                  WHEN p_type = 'SMALL' THEN '1.' || p_size || '.0-beta.1'
                  ELSE 'v1.' || p_size || '.0' END AS version
      FROM part)
    SELECT p_partkey, version,
           CASE WHEN p_type IN ('PROMO', 'STANDARD') THEN true
                WHEN p_type = 'SMALL' THEN p_size > 13
                ELSE p_size >= 13 END AS lifecycle
    FROM v
    """
)
def version_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, size = F.col("p_type"), F.col("p_size")
    version = (
        F.when(kind == "PROMO", F.lit(""))
        .when(kind == "STANDARD", F.lit("nightly"))
        .when(kind == "ECONOMY", F.concat(F.lit("v1."), size))
        .when(kind == "SMALL", F.concat(F.lit("1."), size, F.lit(".0-beta.1")))
        .otherwise(F.concat(F.lit("v1."), size, F.lit(".0")))
    )
    return (
        table(spark, sf_dir, "part")
        .select("p_partkey", version.alias("version"))
        .withColumn("lifecycle", version_gte("version", "1.13.0"))
    )


@query(
    """
    SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
           regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
           regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path
    FROM pages
    """
)
def url_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id",
        url_part("url", "PROTOCOL").alias("scheme"),
        url_part("url", "HOST").alias("host"),
        url_part("url", "PATH").alias("path"),
    )


@query(
    """
    SELECT page_id, url, row_number() OVER (ORDER BY string_split(url, '/'), page_id) AS position
    FROM pages
    """
)
def layer_path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = table(spark, sf_dir, "pages").select("page_id", "url", path_key("url").alias("walk"))
    return ordinals(walked, [], ["walk", "page_id"], "position").drop("walk")


@query(
    """
    WITH refs AS (
      SELECT p_partkey, CASE WHEN p_size > 25 THEN '@brands/' || p_brand ELSE sha256(p_name) END AS ref,
             p_brand, p_size FROM part)
    SELECT p_partkey, ref,
           CASE WHEN p_size <= 25 THEN ref
                WHEN p_brand <> 'Brand#7' THEN sha256('brand: ' || p_brand || chr(10)) END AS resolved_id,
           CASE WHEN p_size > 25 AND p_brand = 'Brand#7'
                THEN 'definition not found: brands/Brand#7' END AS error
    FROM refs
    """
)
def resolve_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, definitions = _referenced(spark, sf_dir)
    return refs.resolve_refs(rows, definitions, "ref", ["p_partkey"])


def _referenced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    rows = part.select(
        "p_partkey",
        F.when(F.col("p_size") > 25, F.concat(F.lit("@brands/"), F.col("p_brand")))
        .otherwise(F.sha2("p_name", 256))
        .alias("ref"),
    )
    definitions = (
        part.where(F.col("p_brand") != "Brand#7")
        .select(F.col("p_brand").alias("brand"))
        .distinct()
        .select(
            F.concat(F.lit("brands/"), "brand").alias("path"),
            F.concat(F.lit("brand: "), F.col("brand"), F.lit("\n")).alias("definition"),
        )
    )
    return rows, definitions


@query(
    """
    SELECT DISTINCT 'brands/' || p_brand AS path FROM part
    WHERE p_size > 25 AND p_brand = 'Brand#7'
    """
)
def missing_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, definitions = _referenced(spark, sf_dir)
    return refs.missing_definitions(rows, definitions, "ref")


@query(
    f"""
    WITH {FLEET_SQL}, keyed AS (
      SELECT host, role, cluster_name || '/' || segment AS spec, acctbal FROM fleet),
    early AS (SELECT DISTINCT spec, role FROM keyed WHERE acctbal > 5000)
    SELECT k.host, k.spec, k.role, sha256('spec: ' || k.spec || ' ' || k.role) AS schematic,
           CASE WHEN e.spec IS NULL THEN 'run-2' ELSE 'run-1' END AS done_in
    FROM keyed k LEFT JOIN early e ON e.spec = k.spec AND e.role = k.role
    """
)
def kept_schematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDs of specifications; a second run over all nodes works only on those that the first has not met."""
    spec = F.concat(F.col("cluster_name").cast("string"), F.lit("/"), F.col("segment")).alias("spec")
    nodes = fleet(spark, sf_dir).select("host", "role", spec, "acctbal")
    text = F.concat(F.lit("spec: "), F.col("spec"), F.lit(" "), F.col("role"))
    submit = lambda keys: keys.withColumn("schematic", refs.content_id(text))
    folder = shared_path(spark, "schematics")
    refs.once_ever(nodes.where("acctbal > 5000"), ["spec", "role"], submit, folder, "run-1")
    return refs.once_ever(nodes.drop("acctbal"), ["spec", "role"], submit, folder, "run-2")


@query(
    f"""
    WITH {FLEET_SQL}
    SELECT DISTINCT cluster_name, sha256('segment: ' || segment || chr(10)) AS id FROM fleet
    """
)
def distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = fleet(spark, sf_dir)
    text = F.concat(F.lit("segment: "), F.col("segment"), F.lit("\n"))
    resolved = refs.once_per_key(
        nodes, ["segment"], lambda keys: keys.withColumn("schematic", refs.content_id(text))
    )
    return node_ops.distinct_ids(resolved, "schematic")


@query(
    f"""
    WITH {FLEET_SQL}, placed AS (
      SELECT cluster_name, host, role, ip,
             row_number() OVER (PARTITION BY cluster_name
               ORDER BY CASE WHEN role = 'control-plane' THEN 0 ELSE 1 END, host) - 1 AS rn
      FROM fleet)
    SELECT n_nationkey AS cluster_name, 'https://' || lower(n_name) || ':6443' AS cluster_endpoint,
           to_base64(encode('ca ' || n_name)) AS cluster_ca,
           CAST(coalesce(rn // 10000, 0) AS BIGINT) AS page,
           coalesce(string_agg(host || '=' || role || '@' || coalesce(ip, ''), ',' ORDER BY rn), '') AS nodes
    FROM nation LEFT JOIN placed ON cluster_name = n_nationkey GROUP BY ALL
    """
)
def cluster_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("cluster_name"),
        F.concat(F.lit("https://"), F.lower("n_name"), F.lit(":6443")).alias("cluster_endpoint"),
        F.concat(F.lit("ca "), "n_name").cast("binary").alias("cluster_ca"),
    )
    info = node_ops.cluster_info(
        clusters, fleet(spark, sf_dir), ["host", "role", "ip"], ("cluster_ca",)
    )
    shown = F.transform(
        "nodes",
        lambda n: F.concat(n["host"], F.lit("="), n["role"], F.lit("@"), F.coalesce(n["ip"], F.lit(""))),
    )
    return info.withColumn("nodes", F.coalesce(F.array_join(shown, ","), F.lit("")))


@query(
    f"""
    WITH {FLEET_SQL}, entries AS (
      SELECT cluster_name, 'nodes' AS list, role, host, coalesce(ip, host) AS address FROM fleet
      UNION ALL
      SELECT cluster_name, 'endpoints', role, host, coalesce(ip, host) FROM fleet
      WHERE role = 'control-plane'
         OR cluster_name IN (SELECT cluster_name FROM fleet GROUP BY 1 HAVING count(*) = 1)),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY cluster_name, list
                  ORDER BY CASE WHEN role = 'control-plane' THEN 0 ELSE 1 END, host) - 1 AS rn
      FROM entries)
    SELECT cluster_name, list, CAST(rn // 10000 AS BIGINT) AS page,
           string_agg(address, ',' ORDER BY rn) AS entries
    FROM placed GROUP BY ALL
    """
)
def client_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = node_ops.client_contexts(fleet(spark, sf_dir))
    return contexts.withColumn("entries", F.array_join("entries", ","))


@query(
    f"""
    WITH {FLEET_SQL}, t AS (SELECT cluster_name, count(*) AS total FROM fleet GROUP BY 1),
    specs AS (SELECT unnest(['1', '5', '25%', '100%', ' 7% ', '0', '101%', 'all', '99999']) AS spec)
    SELECT cluster_name, spec, total,
           CASE spec WHEN '1' THEN 1 WHEN '5' THEN least(5, total)
             WHEN '25%' THEN greatest((total * 25 + 99) // 100, 1)
             WHEN '100%' THEN total WHEN ' 7% ' THEN greatest((total * 7 + 99) // 100, 1)
             WHEN '99999' THEN least(99999, total) END AS parallel
    FROM t, specs
    """
)
def parallel_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = ["1", "5", "25%", "100%", " 7% ", "0", "101%", "all", "99999"]
    totals = fleet(spark, sf_dir).groupBy("cluster_name").agg(F.count(F.lit(1)).alias("total"))
    return totals.withColumn("spec", F.explode(F.array(*map(F.lit, specs)))).withColumn(
        "parallel", effective_parallel("total", "spec")
    )


@query(
    f"""
    WITH {FLEET_SQL}
    SELECT cluster_name, count(*) FILTER (acctbal > 3000) AS success,
           count(*) FILTER (acctbal BETWEEN 0 AND 3000) AS skip,
           count(*) FILTER (acctbal < 0) AS fail
    FROM fleet GROUP BY cluster_name
    """
)
def outcome_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = (
        F.when(F.col("acctbal") > 3000, F.lit("success"))
        .when(F.col("acctbal") >= 0, F.lit("skip"))
        .otherwise(F.lit("fail"))
    )
    return health.outcome_tally(fleet(spark, sf_dir).withColumn("outcome", outcome))


@query(
    f"""
    WITH {FLEET_SQL}
    SELECT cluster_name, host,
           coalesce(CASE WHEN acctbal > 5000 THEN '1.14.1' END,
                    CASE WHEN n_regionkey >= 2 THEN '1.13.' || n_regionkey END, '1.13.0') AS version
    FROM fleet JOIN nation ON n_nationkey = cluster_name
    """
)
def generation_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running version first, then the cluster's; node overrides do not count."""
    clusters = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("cluster_name"),
        F.when(F.col("n_regionkey") >= 2, F.concat(F.lit("v1.13."), "n_regionkey")).alias("wanted"),
    )
    running = F.when(F.col("acctbal") > 5000, F.lit("v1.14.1")).otherwise(F.lit(""))
    return fleet(spark, sf_dir).join(clusters, "cluster_name").select(
        "cluster_name", "host", node_ops.generation_version(running, "wanted", "v1.13.0").alias("version")
    )
