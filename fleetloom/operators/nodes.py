"""Node tables: selection, validation, defaults, ordering and summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from fleetloom.functions.columns import (
    CONTROL_PLANE,
    DEFAULT_FACTORY,
    DEFAULT_PLATFORM,
    DEFAULT_SCHEMATIC,
    ROLES,
    col_of,
    connect_endpoint,
    first_set,
    installer_ref,
    is_control_plane,
    role_rank,
    strip_v,
)
from fleetloom.operators.ordered import ordinals, pages

DEFAULTS: Mapping[str, str] = {
    "factory": DEFAULT_FACTORY,
    "platform": DEFAULT_PLATFORM,
    "schematic_id": DEFAULT_SCHEMATIC,
}


def filter_nodes(nodes: DataFrame, pattern: str = "") -> DataFrame:
    """Nodes whose host contains a match of *pattern*; an empty pattern keeps all.

    The pattern is tried at once by the engine that will run it.
    """
    if not pattern:
        return nodes
    try:
        nodes.sparkSession.range(1).select(F.lit("").rlike(pattern)).first()
    except Exception as problem:
        raise ValueError(f"not a valid pattern: {pattern!r}") from problem
    return nodes.where(F.col("host").rlike(pattern))


def partition_by_role(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(control-plane, everything else); a missing role belongs to the second part."""
    lead = is_control_plane()
    return nodes.where(lead), nodes.where(~lead)


def add_nodes(nodes: DataFrame, extra: DataFrame) -> DataFrame:
    """Append provider nodes to static ones; duplicates stay."""
    return nodes.unionByName(extra, allowMissingColumns=True)


def rejection_reasons(role: Column | str = "role", host: Column | str = "host") -> Column:
    role, host = col_of(role), col_of(host)
    blank_role = F.coalesce(role == "", F.lit(True))
    return F.array_compact(
        F.array(
            F.when(F.coalesce(host == "", F.lit(True)), F.lit("host is empty")),
            F.when(blank_role, F.lit("role is empty")),
            F.when(
                ~blank_role & ~role.isin(*ROLES),
                F.concat(F.lit("unknown role: "), role),
            ),
        )
    )


def validate_nodes(nodes: DataFrame, mode: str = "quarantine") -> DataFrame:
    """Add ``reasons``; mode ``fail`` stops the job at the first bad row instead."""
    checked = nodes.withColumn("reasons", rejection_reasons())
    if mode == "quarantine":
        return checked
    if mode != "fail":
        raise ValueError(f"mode must be 'quarantine' or 'fail': {mode!r}")
    failed = F.raise_error(
        F.concat(F.coalesce(F.col("host"), F.lit("?")), F.lit(": "), F.array_join("reasons", "; "))
    )
    # As a filter, the check runs whichever columns are read later.
    fine = F.when(F.size("reasons") == 0, F.lit(True)).otherwise(failed.cast("boolean"))
    return checked.where(fine).drop("reasons")


def resolve_defaults(
    nodes: DataFrame,
    clusters: DataFrame,
    default_version: str,
    defaults: Mapping[str, str] = DEFAULTS,
) -> DataFrame:
    """Settle factory, platform, schematic, version and secure boot per node.

    Each falls back from node to cluster to default.  Secure boot is on when
    either side turns it on.  No broadcast hint: Spark measures the clusters.
    """
    fallback = {**defaults, "talos_version": default_version}
    side = clusters.select(
        F.col("cluster_name").alias("_c"),
        *[F.col(name).alias(f"_c_{name}") for name in fallback],
        F.col("secureboot").alias("_c_secureboot"),
    )
    joined = nodes.join(side, nodes["cluster_name"] == side["_c"], "left")
    kept = [c for c in nodes.columns if c not in fallback and c != "secureboot"]
    settled = joined.select(
        *[nodes[c] for c in kept],
        *[
            first_set(nodes[name], F.col(f"_c_{name}"), F.lit(default)).alias(name)
            for name, default in fallback.items()
        ],
        (
            F.coalesce(nodes["secureboot"], F.lit(False))
            | F.coalesce(F.col("_c_secureboot"), F.lit(False))
        ).alias("secureboot"),
    )
    return settled.withColumn("talos_version", strip_v("talos_version"))


def generation_version(
    running: Column | str, cluster: Column | str, default_version: str
) -> Column:
    """Version used to generate a config: running, then cluster, then default.

    A node's own version override has no say here.
    """
    return strip_v(first_set(running, cluster, F.lit(default_version)))


def with_installer(settled: DataFrame) -> DataFrame:
    """Installer reference of nodes returned by :func:`resolve_defaults`."""
    return settled.withColumn(
        "installer",
        installer_ref(
            "factory", "platform", "schematic_id", "talos_version", "secureboot", F.lit(False)
        ),
    )


def order_nodes(nodes: DataFrame) -> DataFrame:
    """Control-plane first, then by host."""
    return nodes.orderBy(role_rank(), "host")


def with_position(nodes: DataFrame, out: str = "position") -> DataFrame:
    """1-based place of each node in the node order of its cluster."""
    ranked = nodes.withColumn("_rank", role_rank())
    return ordinals(ranked, ["cluster_name"], ["_rank", "host"], out).drop("_rank")


def first_reachable(nodes: DataFrame, reachable: Column) -> DataFrame:
    """First reachable control-plane node per cluster, or an error row."""
    usable = is_control_plane() & F.coalesce(reachable, F.lit(False))
    chosen = F.min(F.when(usable, F.col("host")))
    return (
        nodes.groupBy("cluster_name")
        .agg(chosen.alias("host"))
        .withColumn(
            "error",
            F.when(F.col("host").isNull(), F.lit("every control-plane node is out of reach")),
        )
    )


def role_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("cluster_name").agg(
        F.count_if(is_control_plane()).alias("control_plane"),
        F.count_if(~is_control_plane()).alias("workers"),
    )


def distinct_ids(nodes: DataFrame, id_col: str, pattern: str = "") -> DataFrame:
    """Distinct IDs per cluster, sorted."""
    return (
        filter_nodes(nodes, pattern)
        .select("cluster_name", F.col(id_col).alias("id"))
        .distinct()
        .orderBy("cluster_name", "id")
    )


def cluster_info(
    clusters: DataFrame,
    nodes: DataFrame,
    node_fields: list[str],
    cert_columns: tuple[str, ...] = (),
    page_size: int = 10_000,
) -> DataFrame:
    """Cluster columns with the ordered node list nested, certificates as base64.

    The list comes in pages; a cluster of up to *page_size* nodes is one row.
    """
    ranked = nodes.withColumn("_rank", role_rank())
    lists = pages(
        ranked,
        ["cluster_name"],
        ["_rank", "host"],
        F.struct(*node_fields),
        page_size,
        "nodes",
    )
    encoded = clusters.withColumns({c: F.base64(F.col(c)) for c in cert_columns})
    return encoded.join(lists, "cluster_name", "left").withColumn(
        "page", F.coalesce("page", F.lit(0).cast("bigint"))
    )


def client_contexts(nodes: DataFrame, page_size: int = 10_000) -> DataFrame:
    """Endpoints and nodes of each cluster's client context, in node order.

    Endpoints are the control-plane nodes; the only node of a cluster is its
    endpoint whatever its role.  Rows are ``(cluster_name, list, page, entries)``.
    """
    sizes = nodes.groupBy("cluster_name").agg((F.count(F.lit(1)) == 1).alias("_single"))
    entries = nodes.join(sizes, "cluster_name").select(
        "cluster_name",
        role_rank().alias("_rank"),
        "host",
        connect_endpoint().alias("_address"),
        F.explode(
            F.when(
                F.col("_single") | (F.col("role") == CONTROL_PLANE),
                F.array(F.lit("endpoints"), F.lit("nodes")),
            ).otherwise(F.array(F.lit("nodes")))
        ).alias("list"),
    )
    return pages(
        entries,
        ["cluster_name", "list"],
        ["_rank", "host"],
        F.col("_address"),
        page_size,
        "entries",
    )
