"""Layered configuration: which layers apply, in what order, and their merge."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetloom.functions.columns import path_key
from fleetloom.session import cut_lineage

# Stands for a missing role; no role layer can name it.
NO_ROLE = "\u0000"

# Leaves that one task merges; the number of tasks follows the number of leaves.
TASK_LEAVES = 30_000

# Fixed order of scopes, lowest precedence first.
SCOPES = ("base", "all", "role", "node")


def scope_rank(scope: Column | str = "scope") -> Column:
    column = F.col(scope) if isinstance(scope, str) else scope
    rank = F.when(column == SCOPES[0], F.lit(0))
    for i, name in enumerate(SCOPES[1:], start=1):
        rank = rank.when(column == name, F.lit(i))
    return rank


def precedence() -> Column:
    """Sort key of a layer row: scope, then directory walk, then document."""
    return F.struct(
        scope_rank().alias("layer_rank"),
        path_key("layer_path").alias("walk"),
        F.col("doc_index").cast("int").alias("doc_index"),
    )


def with_precedence(layers: DataFrame) -> DataFrame:
    return layers.withColumn("precedence", precedence())


def _by_reach(layers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cluster-wide, role, host) layers; a base layer may name a host or nobody."""
    wide = (F.col("scope") == "all") | ((F.col("scope") == "base") & F.col("scope_value").isNull())
    hosted = (F.col("scope") == "node") | (
        (F.col("scope") == "base") & F.col("scope_value").isNotNull()
    )
    return layers.where(wide), layers.where(F.col("scope") == "role"), layers.where(hosted)


def applicable_layers(nodes: DataFrame, layers: DataFrame) -> DataFrame:
    """Pair every node with the layers meant for its cluster, role or host.

    Three equi-joins and a union; no condition with OR, hence no nested loop.
    """
    side = nodes.select("cluster_name", "host", "role")
    wide, by_role, by_host = _by_reach(layers)
    carried = [c for c in layers.columns if c != "cluster_name"]
    parts = [
        side.join(wide, "cluster_name"),
        side.join(by_role.withColumn("role", F.col("scope_value")), ["cluster_name", "role"]),
        side.join(by_host.withColumn("host", F.col("scope_value")), ["cluster_name", "host"]),
    ]
    columns = ["cluster_name", "host", "role", *carried]
    paired = parts[0].select(*columns)
    for part in parts[1:]:
        paired = paired.unionByName(part.select(*columns))
    return paired


def merge_layers(
    settings: DataFrame, keys: Sequence[str], list_mode: str = "replace"
) -> DataFrame:
    """Merge leaf rows per key; the row of highest precedence wins its path.

    *settings* is ``(keys, path, kind, value, precedence)`` with kinds as given
    by ``flatten_leaves(walk_lists=False, directives=True)``.  Rules:

    * a scalar, a list or a delete also removes what earlier layers set below it;
    * anything set below a path removes an earlier scalar or list at that path;
    * an empty map only removes an earlier scalar or list; it is not a result;
    * lists replace each other, or with ``append`` are joined in precedence order.

    Both subtree rules are equi-joins on exploded path prefixes.
    """
    if list_mode not in ("replace", "append"):
        raise ValueError(f"list_mode must be 'replace' or 'append': {list_mode!r}")
    keys = list(keys)
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.slice("path", 1, i)
    )
    own = F.struct("path", "kind", "value", F.lit(False).alias("_below"))
    nothing = F.lit(None).cast("string")
    below = F.when(
        F.size("path") > 1,
        F.transform(
            prefixes, lambda p: F.struct(p.alias("path"), nothing.alias("kind"), nothing.alias("value"), F.lit(True).alias("_below"))
        ),
    )
    rows = settings.select(*keys, "precedence", F.inline(F.concat(F.array(own), F.coalesce(below, F.array()))))
    # Dealt out first: before the shuffle nothing meets that could be aggregated, and a sort there
    # would hold what one task makes of its part of the nodes.
    tasks = max(1, math.ceil(settings.count() / TASK_LEAVES))
    rows = rows.repartition(tasks, *keys, "path")
    mine = ~F.col("_below")
    order = F.col("precedence")
    aggregates = [
        F.max_by(F.struct("kind", "value", "precedence"), F.when(mine, order)).alias("_win"),
        F.max(F.when(mine & (F.col("kind") != "empty"), order)).alias("_cut"),
        F.max(F.when(F.col("_below"), order)).alias("_under"),
    ]
    if list_mode == "append":
        is_list = mine & (F.col("kind") == "list")
        aggregates += [
            F.max(F.when(mine & ~is_list, order)).alias("_plain"),
            F.collect_list(F.when(is_list, F.struct("precedence", "value"))).alias("_lists"),
        ]
    # Read by several steps below, and the shuffle is the costly part: kept once.
    states = cut_lineage(rows.groupBy(*keys, "path").agg(*aggregates))
    winners = states.where(
        F.col("_win.kind").isNotNull() & ~F.col("_win.kind").isin("empty", "delete")
    )
    # Only paths that are set both as a leaf and as a container can remove others.
    cuts = states.where(F.col("_cut").isNotNull() & F.col("_under").isNotNull()).select(
        *keys, F.col("path").alias("_prefix"), "_cut"
    )
    if cuts.isEmpty():
        judged = winners.withColumn("_gone", F.col("_under"))
    else:
        removed = (
            winners.where(F.size("path") > 1)
            .select(*keys, "path", F.explode(prefixes).alias("_prefix"))
            .join(cuts, [*keys, "_prefix"])
            .groupBy(*keys, "path")
            .agg(F.max("_cut").alias("_above"))
        )
        judged = winners.join(removed, [*keys, "path"], "left").withColumn(
            "_gone", F.greatest("_under", "_above")
        )
    alive = judged.where(F.col("_gone").isNull() | (F.col("_win.precedence") > F.col("_gone")))
    value = F.col("_win.value")
    if list_mode == "append":
        floor = F.greatest("_gone", "_plain")
        kept = F.filter(
            F.sort_array("_lists"),
            lambda e: floor.isNull() | (e["precedence"] > floor),
        )
        bodies = F.filter(
            F.transform(kept, lambda e: F.substring(e["value"], F.lit(2), F.length(e["value"]) - 2)),
            lambda text: text != "",
        )
        joined = F.concat(F.lit("["), F.array_join(bodies, ","), F.lit("]"))
        value = F.when(F.col("_win.kind") == "list", joined).otherwise(value)
    return alive.select(
        *keys,
        "path",
        F.col("_win.kind").alias("kind"),
        value.alias("value"),
        F.col("_win.precedence").alias("precedence"),
    )


def compact_layers(settings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop rows that cannot matter to any merge they take part in.

    Per path only the last row and the last row that is not an empty map decide
    what a merge with further layers, lower or higher, gives.
    """
    row = F.struct("kind", "value", "precedence")
    last = F.max_by(row, F.col("precedence"))
    last_cut = F.max_by(row, F.when(F.col("kind") != "empty", F.col("precedence")))
    return (
        settings.groupBy(*keys, "path")
        .agg(F.array_distinct(F.array_compact(F.array(last, last_cut))).alias("_rows"))
        .select(*keys, "path", F.inline("_rows"))
    )


def merged_settings(
    nodes: DataFrame,
    settings: DataFrame,
    list_mode: str = "replace",
    node_settings: DataFrame | None = None,
    document_keys: Sequence[str] = (),
) -> DataFrame:
    """Merged configuration of every node from leaf rows of its layers.

    *settings* is ``(cluster_name, scope, scope_value, layer_path, doc_index, path,
    kind, value)``.  Layers shared by a whole cluster or role are compacted and
    merged once per ``(cluster, role)`` and handed to the nodes afterwards; only
    nodes with layers of their own are merged again and shuffled by path.
    *node_settings* adds leaves that are each node's own whatever their scope,
    such as filled templates: ``(cluster_name, host, path, kind, value, precedence)``.
    *document_keys* names further columns of both that keep documents apart.
    """
    extra = list(document_keys)
    # A node without a role has the layers of its cluster, like every other.
    nodes = nodes.withColumn("role", F.coalesce("role", F.lit(NO_ROLE)))
    wide, by_role, by_host = _by_reach(with_precedence(settings))
    group = ["cluster_name", "role"]
    node = ["cluster_name", "host", "role"]
    leaf = [*extra, "path", "kind", "value", "precedence"]
    side = nodes.select(*node)
    roles = side.select(*group).distinct()
    shared = roles.join(wide.select("cluster_name", *leaf), "cluster_name").unionByName(
        roles.join(by_role.select("cluster_name", F.col("scope_value").alias("role"), *leaf), group)
    )
    shared = cut_lineage(compact_layers(shared, [*group, *extra]) if list_mode == "replace" else shared)
    hosted = by_host.select("cluster_name", F.col("scope_value").alias("host"), *leaf)
    if node_settings is not None:
        hosted = hosted.unionByName(node_settings.select("cluster_name", "host", *leaf))
    hosted = cut_lineage(hosted)
    own = side.join(hosted, ["cluster_name", "host"])
    touched = hosted.select("cluster_name", "host").distinct()
    out = [*node, *leaf]
    passed = side.join(touched, ["cluster_name", "host"], "left_anti").join(
        merge_layers(shared, [*group, *extra], list_mode), group
    )
    remade = merge_layers(
        side.join(touched, ["cluster_name", "host"], "left_semi")
        .join(shared, group)
        .select(*out)
        .unionByName(own.select(*out)),
        [*node, *extra],
        list_mode,
    )
    return passed.select(*out).unionByName(remade.select(*out)).withColumn("role", F.nullif("role", F.lit(NO_ROLE)))
