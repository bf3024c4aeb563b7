"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard.  At each node every child draws a number
from a hash of the row's key and the child's name, stretched by the child's
weight; the least draw wins.  A draw depends on that child alone, so a change of
weights moves rows only into the subtrees that became heavier and out of those
that became lighter; children of other nodes keep their rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from fleetloom.operators.ordered import ordinals
from fleetloom.session import cut_lineage

_DIGITS = 13


class Leaf(NamedTuple):
    """One shard, its place in the tree and its weight."""

    region: str
    rack: str
    shard: int
    weight: float


def layout(shards: int, base: int = 8) -> list[Leaf]:
    """Tree of equal shards: two to a rack, two racks to a region, as far as *base*.

    Each shard beyond *base* opens a region of its own.  The new region is then
    the only subtree that gains weight, so one more shard takes rows only into itself.
    """
    leaves = [Leaf(f"r{i // 4}", f"k{i // 2}", i, 1.0) for i in range(min(shards, base))]
    return leaves + [Leaf(f"r+{i}", f"k+{i}", i, 1.0) for i in range(base, shards)]


def _draw(key: Column, name: str, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f"/{name}"))), 1, _DIGITS)
    unit = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**_DIGITS)
    return -F.log(unit) / F.lit(float(weight))


def _winner(key: Column, children: dict) -> Column:
    draws = [F.struct(_draw(key, path, weight).alias("draw"), F.lit(path).alias("path")) for path, weight in children.items()]
    return F.array_min(F.array(*draws))["path"]


def shard_of(df: DataFrame, key: Column, tree: Sequence[Leaf], out: str) -> DataFrame:
    """*df* with the shard of each row; rows with a null key go together, by the empty key.

    Only rows of heavier subtrees move when *tree* changes.  *tree* holds the
    cluster's layout, which is configuration and no data.
    """
    if not tree or len({leaf.shard for leaf in tree}) < len(tree) or any(leaf.weight <= 0 for leaf in tree):
        raise ValueError("a tree needs shards with different numbers and positive weights")
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    numbers = {}
    for leaf in tree:
        region, rack = leaf.region, f"{leaf.region}/{leaf.rack}"
        path = f"{rack}/{leaf.shard}"
        numbers[path] = leaf.shard
        for level, (parent, child) in zip(levels, (("", region), (region, rack), (rack, path)), strict=True):
            children = level.setdefault(parent, {})
            children[child] = children.get(child, 0.0) + leaf.weight
    names = [f"{out}_level_{i}" for i in range(3)]
    key = F.coalesce(key.cast("string"), F.lit(""))
    for depth, level in enumerate(levels):
        if depth == 0:
            df = df.withColumn(names[0], _winner(key, level[""]))
            continue
        chosen = F.lit(None).cast("string")
        for parent, children in level.items():
            best = _winner(key, children) if len(children) > 1 else F.lit(next(iter(children)))
            chosen = F.when(F.col(names[depth - 1]) == parent, best).otherwise(chosen)
        df = df.withColumn(names[depth], chosen)
    shard = F.substring_index(names[-1], "/", -1).cast("int")
    return df.withColumn(out, shard).drop(*names)


def shard_documents(docs: DataFrame, tree: Sequence[Leaf], grown: Sequence[Leaf]) -> DataFrame:
    """Shard and slot of each row of ``docs(doc_id, text)``, and its shard in the *grown* tree.

    ``size`` is the text's UTF-8 bytes plus one (null: one), ``text_crc32`` its
    checksum (null: that of the empty text).  ``slot`` counts the rows of a shard
    from 0 in the order of ID, checksum and size; equal rows take neighbouring
    slots, null IDs come first.  Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    placed = shard_of(narrow, F.col("doc_id"), tree, "shard")
    placed = shard_of(placed, F.col("doc_id"), grown, "grown_shard")
    # Texts are read once: what follows works on these few numbers of each row.
    ranked = ordinals(cut_lineage(placed), ["shard"], ["doc_id", "text_crc32", "size"], "rank")
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("rank") - 1).alias("slot"), "grown_shard",
    )
