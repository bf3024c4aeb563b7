"""Connected components of a table of links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetloom.llm.shared import stored

#: Links that a task ties together by itself; beyond that, tasks exchange what they found.
TASK_LINKS = 1 << 20


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``links(a, b)`` that is not the smallest of its component.

    Each task replaces its links by stars around the smallest node it knows.  If that takes
    several tasks, alternating star contractions follow: every node is tied to its
    smallest neighbour, until only stars are left, which takes a number of rounds that grows with
    the logarithm of the longest chain.  Each round is written to the shared folder.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    print_ = None
    while True:
        tasks = math.ceil(edges.count() / TASK_LINKS)
        dealt = edges.coalesce(1) if tasks <= 1 else edges.repartition(tasks)
        edges = stored(dealt.mapInArrow(_stars, "u long, v long"), "stars")
        if tasks <= 1:
            break
        edges = stored(_small_star(_large_star(edges)), "links")
        if (now := _fingerprint(edges)) == print_:
            break
        print_ = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as ``(u, v)``: each node but the smallest of its tree, and that one."""
    ends = [np.stack([batch.column(c).to_numpy() for c in ("u", "v")]) for batch in batches]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    first, second = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while (root[first] != root[second]).any():
        one, other = root[first], root[second]
        np.minimum.at(root, np.maximum(one, other), np.minimum(one, other))
        while (root[root] != root).any():
            root = root[root]
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[root[tied]])], ["u", "v"])


def _fingerprint(edges: DataFrame):
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Ties the larger neighbours of each node to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    tied = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Ties each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
