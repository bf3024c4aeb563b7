"""From cluster documents and layer files to the merged settings of every node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetloom.functions.columns import first_set
from fleetloom.operators.layers import applicable_layers, merged_settings, with_precedence
from fleetloom.operators.nested import flatten_leaves
from fleetloom.operators.nodes import DEFAULTS, resolve_defaults, with_installer
from fleetloom.operators.refs import resolve_refs
from fleetloom.operators.templates import fill_templates
from fleetloom.session import cut_lineage
from fleetloom.sources.documents import split_documents, split_yaml_documents

# Template field names and the path of the installer setting.
CLUSTER_FIELDS = {
    "ClusterName": "cluster_name",
    "ClusterEndpoint": "cluster_endpoint",
    "KubernetesVersion": "kubernetes_version",
    "TalosVersion": "talos_version",
}
NODE_FIELDS = {
    "Host": "host",
    "IP": "ip",
    "Role": "role",
    "TalosVersion": "talos_version",
    "SchematicID": "schematic_id",
    "Factory": "factory",
    "Platform": "platform",
    "SecureBoot": "secureboot",
}
INSTALLER_PATH = ("machine", "install", "image")
TEMPLATE_SUFFIX = ".tpl"
DOCUMENT_KEYS = ("doc_kind", "doc_name")


def _fields(prefix: str, fields: dict[str, str]) -> Column:
    pairs = []
    for name, column in fields.items():
        pairs += [F.lit(prefix + name), F.coalesce(F.col(column).cast("string"), F.lit(""))]
    return F.create_map(*pairs)


def _bag(df: DataFrame, keys: list[str], prefix: str, out: str, max_depth: int) -> DataFrame:
    """Dotted leaves of the ``data`` document of each row; one document, one map."""
    leaves = flatten_leaves(df.select(*keys, "data"), "data", max_depth)
    named = F.concat(F.lit(prefix), F.array_join("path", "."))
    entry = F.struct(F.col("_name").alias("key"), F.coalesce("value", F.lit("")).alias("value"))
    held = leaves.where((F.size("path") > 0) & (F.col("kind") != "empty"))
    # A key with dots and a nested key can have the same name: the nested one counts.
    once = held.groupBy(*keys, named.alias("_name")).agg(F.max_by("value", F.size("path")).alias("value"))
    return once.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias(out))


def template_context(nodes: DataFrame, clusters: DataFrame, max_depth: int = 8) -> DataFrame:
    """``(cluster_name, host, context)``: what templates may refer to, by dotted key.

    *nodes* needs ``resolved_id`` next to the columns of a node table.
    """
    none = F.create_map().cast("map<string,string>")
    node_key = ["cluster_name", "host"]
    bags = _bag(nodes, node_key, "Node.Data.", "_node_bag", max_depth)
    wide = clusters.join(
        _bag(clusters, ["cluster_name"], "Data.", "_bag", max_depth), "cluster_name", "left"
    ).select(
        "cluster_name",
        F.map_concat(_fields("", CLUSTER_FIELDS), F.coalesce("_bag", none)).alias("_shared"),
    )
    own = nodes.join(bags, node_key, "left").select(
        *node_key,
        F.map_concat(
            F.create_map(F.lit("SchematicID"), F.coalesce("resolved_id", F.lit(""))),
            _fields("Node.", NODE_FIELDS),
            F.coalesce("_node_bag", none),
        ).alias("_own"),
    )
    return own.join(wide, "cluster_name", "left").select(
        *node_key, F.map_concat(F.coalesce("_shared", none), "_own").alias("context")
    )


def render(
    nodes: DataFrame,
    clusters: DataFrame,
    layer_files: DataFrame,
    definitions: DataFrame,
    default_version: str,
    encoding: str = "yaml",
    list_mode: str = "replace",
    max_depth: int = 16,
) -> tuple[DataFrame, DataFrame]:
    """(settings, errors) of every node.

    *layer_files* is ``(cluster_name, scope, scope_value, layer_path, text)`` and
    *definitions* ``(path, definition)`` for ``@path`` schematic IDs.  Plain layers
    are split and flattened once, whatever the number of nodes they apply to;
    templates are filled per node.  The generated installer reference is the lowest
    layer.  Documents of another ``kind`` and ``name`` are merged apart from the main
    one.  A node with an error has no settings and does not disturb the others.
    """
    split = split_yaml_documents if encoding == "yaml" else split_documents
    node_key = ["cluster_name", "host"]
    chosen = _chosen_ids(nodes, clusters)
    # Tables read by several branches below are written once.
    resolved = cut_lineage(
        resolve_refs(chosen, definitions, "_ref", node_key).withColumnRenamed("error", "_ref_error")
    )
    context = template_context(resolved, clusters, max_depth)

    is_template = F.endswith("layer_path", F.lit(TEMPLATE_SUFFIX))
    plain = cut_lineage(split(layer_files.where(~is_template), "text"))
    bodies = (
        applicable_layers(nodes, layer_files.where(is_template))
        .join(context, node_key)
        .withColumnRenamed("text", "_body")
    )
    filled = cut_lineage(fill_templates(bodies, "_body", "context").drop("_body", "context"))
    made = cut_lineage(split(filled.where(F.col("error").isNull()).drop("error"), "text"))

    def leaves(documents: DataFrame) -> DataFrame:
        good = documents.where(F.col("error").isNull()).drop("error")
        parsed = good.withColumn("body", F.parse_json("body"))
        kind = F.coalesce(F.try_variant_get("body", "$.kind", "string"), F.lit(""))
        name = F.coalesce(F.try_variant_get("body", "$.name", "string"), F.lit(""))
        keyed = parsed.withColumn("doc_kind", kind).withColumn(
            "doc_name", F.when(F.col("doc_kind") != "", name).otherwise(F.lit(""))
        )
        return flatten_leaves(keyed, "body", max_depth, walk_lists=False, directives=True, mark_deep=True)

    installer = with_installer(
        resolve_defaults(
            resolved.withColumn("schematic_id", F.col("resolved_id")), clusters, default_version
        )
    ).select(
        *node_key,
        F.lit("base").alias("scope"),
        F.lit("").alias("layer_path"),
        F.lit(0).alias("doc_index"),
        *[F.lit("").alias(key) for key in DOCUMENT_KEYS],
        F.array(*map(F.lit, INSTALLER_PATH)).alias("path"),
        F.lit("string").alias("kind"),
        F.col("installer").alias("value"),
    )
    plain_leaves, made_leaves = cut_lineage(leaves(plain)), cut_lineage(leaves(made))
    own = with_precedence(made_leaves.select(*installer.columns))
    broken, deep = F.col("error").isNotNull(), F.col("kind") == "deep"
    too_deep = F.lit(f"document deeper than {max_depth}").alias("error")
    place = ["cluster_name", "scope", "scope_value", "layer_path"]
    deep_plain = plain_leaves.where(deep).select(*place, too_deep).distinct()
    deep_made = made_leaves.where(deep).select(*node_key, "layer_path", too_deep).distinct()
    unlisted = nodes.join(clusters.select("cluster_name"), "cluster_name", "left_anti")
    errors = cut_lineage(
        resolved.where(F.col("_ref_error").isNotNull())
        .select(*node_key, F.col("_ref_error").alias("error"))
        .unionByName(_failures(applicable_layers(nodes, plain.where(broken))))
        .unionByName(_failures(filled.where(broken)))
        .unionByName(_failures(made.where(broken)))
        .unionByName(_failures(applicable_layers(nodes, deep_plain)))
        .unionByName(_failures(deep_made))
        .unionByName(unlisted.select(*node_key, F.lit("cluster is not listed").alias("error")))
    )
    failed = errors.select(*node_key).distinct()
    healthy = nodes.join(failed, node_key, "left_anti")
    settings = merged_settings(healthy, plain_leaves, list_mode, own, DOCUMENT_KEYS)
    # The installer is the lowest layer: it stands wherever no layer says anything there. Added
    # to the merged rows, it does not make every node one with layers of its own.
    said = applicable_layers(healthy, plain_leaves.where(_at_installer()).select(*place).distinct())
    said = said.select(*node_key).unionByName(made_leaves.where(_at_installer()).select(*node_key)).distinct()
    standing = with_precedence(healthy.select(*node_key, "role").join(installer, node_key).join(said, node_key, "left_anti"))
    return settings.unionByName(standing.select(*settings.columns)), errors


def _at_installer() -> Column:
    """Leaves of the main document that decide about the installer setting.

    Such are leaves at its path, at a path above it that are no empty map, and below it.
    """
    target = F.array(*map(F.lit, INSTALLER_PATH))
    depth = len(INSTALLER_PATH)
    shorter = F.slice(target, F.lit(1), F.least(F.size("path"), F.lit(depth)))
    meets = F.slice("path", 1, depth) == shorter
    above = (F.size("path") < depth) & (F.col("kind") == "empty")
    return (F.col("doc_kind") == "") & meets & ~above


def _chosen_ids(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    side = clusters.select("cluster_name", F.col("schematic_id").alias("_cluster_id"))
    joined = nodes.join(side, "cluster_name", "left")
    chosen = first_set("schematic_id", "_cluster_id", F.lit(DEFAULTS["schematic_id"]))
    return joined.withColumn("_ref", chosen).drop("_cluster_id")


def _failures(rows: DataFrame) -> DataFrame:
    where = F.concat(F.col("layer_path"), F.lit(": "), F.col("error"))
    return rows.select("cluster_name", "host", where.alias("error"))
