"""How filters of a corpus interact in every order in which they could be applied.

Each document fails some set of the filters, its mask.  The (min,+) product of the matrix of masks (0 where a
mask fails a filter, infinite elsewhere) with the matrix of positions (the inverse of every
order) is the step at which a mask is removed in an order.  Counts by order and step are scatters of the
documents' weights to those steps.  Documents are counted by part and mask first, so the
matrices never grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fleetloom.llm.shared import UPPER, WHITE_SPACE, stored

#: Filters of :func:`failures`; filter i sets bit i of a mask.
NAMES = "ABCDE"
#: Tallies of a part: by mask, then good or not, then toxic or not.
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def removal_steps(filters: int) -> tuple[np.ndarray, np.ndarray]:
    """Orders (a row of filter numbers each), and the step that removes each mask in each order.

    A mask that fails nothing is removed at step ``filters + 1``, which no order has.
    """
    orders = np.array(list(permutations(range(filters))))
    positions = np.argsort(orders, axis=1).T + 1
    never = filters + 1
    fails = np.arange(1 << filters)[:, None] >> np.arange(filters) & 1
    masks = np.where(fails, 0, never)
    steps = np.full((1 << filters, len(orders)), never)
    for each in range(filters):
        steps = np.minimum(steps, masks[:, each, None] + positions[each])
    return orders, steps


def interactions(tallies: np.ndarray, filters: int) -> dict[str, np.ndarray]:
    """Counts by order and step from the documents of each mask.

    *tallies* has the axes part, mask, good, toxic; results have the axes part, order, step.
    """
    orders, steps = removal_steps(filters)
    parts, masks = tallies.shape[:2]
    rows, cells = np.arange(len(orders)), len(orders) * (filters + 1)
    fails = (np.arange(masks)[:, None] >> np.arange(filters) & 1).astype(np.int64)

    def scatter(weights: np.ndarray) -> np.ndarray:
        found = np.zeros((parts, cells), np.int64)
        for mask in range(masks):
            found[:, rows * (filters + 1) + steps[mask] - 1] += weights[:, mask, None]
        return found.reshape(parts, len(orders), filters + 1)[:, :, :filters]

    documents = tallies.sum(axis=(2, 3))
    removed = scatter(documents)
    earlier = np.zeros_like(removed)
    for step in range(filters):
        late = fails[:, orders[:, step]] * (steps <= step)
        earlier[:, :, step] = documents @ late
    shapley = np.zeros((parts, filters), np.int64)
    for step in range(filters):
        np.add.at(shapley, (slice(None), orders[:, step]), removed[:, :, step])
    return {
        "kept": documents.sum(axis=1)[:, None, None] - np.cumsum(removed, axis=2),
        "removed": removed,
        "redundant": earlier,
        "unique_fails": documents[:, 1 << orders],
        "good_lost": scatter(tallies[:, :, 1, :].sum(axis=2)),
        "toxic_lost": scatter(tallies[:, :, :, 1].sum(axis=2)),
        "shapley": shapley[:, orders],
    }


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part``, ``mask`` and ``n``: the filters that documents fail, and how many rows are alike.

    A null text is an empty one, a null source the empty string.  A text is a repeat if a smaller ID has the
    same one; rows without ID neither are repeats nor make others so, rows with equal ID and text are not
    repeats of each other.  Texts are compared by their SHA-256.
    """
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    words = F.array_remove(F.split("text", f"[{WHITE_SPACE}]+"), "")
    sizes = whole.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        words.alias("words"),
        F.length("text").alias("length"),
        F.length(F.translate("text", UPPER, "")).alias("other"),
        F.col("text").rlike("[#$%&*|]").alias("marked"),
    )
    count, distinct = F.size("words").cast("long"), F.size(F.array_distinct("words")).cast("long")
    tests = [
        count < 200,
        100 * distinct < 50 * count,
        100 * (F.col("length") - F.col("other")).cast("long") > 2 * F.col("length").cast("long"),
        F.col("marked"),
    ]
    mask = sum((test.cast("int") * (1 << i) for i, test in enumerate(tests)), F.lit(0))
    alike = sizes.select("digest", "doc_id", "part", mask.alias("mask"))
    rows = stored(alike.groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n")), "filter-audit")
    first = rows.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    # Joined by ID too, so that the copies of a frequent text are spread.
    found = rows.join(first.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left")
    repeat = F.col("doc_id").isNotNull() & F.col("first").isNull()
    found = found.withColumn("mask", F.col("mask") + repeat.cast("int") * 16)
    return found.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def audit(rows: DataFrame, labels: DataFrame, names: Sequence[str] = NAMES) -> DataFrame:
    """One row per part, order of the filters and step.

    *rows* has ``doc_id``, ``part``, ``mask`` (bit i: filter i of *names* is failed) and ``n``.  A document is
    good if any row of ``labels(doc_id, quality, toxic)`` says so, and likewise toxic; without
    a label it is neither.  An empty table gives no rows.  All orders are listed, so their
    number grows as the factorial of the filters.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
    known = known.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    marked = rows.join(known, "doc_id", "left")
    good, bad = (F.coalesce(c, F.lit(False)).cast("int") for c in ("good", "bad"))
    cell = F.col("mask") * 4 + good * 2 + bad
    counted = marked.groupBy("part", cell.alias("cell")).agg(F.sum("n").alias("n"))
    # At most four cells a mask.
    parts = counted.groupBy("part").agg(F.collect_list("cell").alias("cells"), F.collect_list("n").alias("counts"))
    filters, names = len(names), list(names)

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        orders = removal_steps(filters)[0]
        letters = ["".join(names[i] for i in order) for order in orders]
        for frame in frames:
            for start in range(0, len(frame), 64):
                some = frame.iloc[start : start + 64]
                tallies = np.zeros((len(some), 4 << filters), np.int64)
                for row, (cells, counts) in enumerate(zip(some["cells"], some["counts"], strict=True)):
                    np.add.at(tallies[row], np.asarray(cells), np.asarray(counts))
                found = interactions(tallies.reshape(len(some), 1 << filters, 2, 2), filters)
                each = len(orders) * filters
                yield pd.DataFrame(
                    {
                        "part": np.repeat(some["part"].to_numpy(), each),
                        "filter_order": np.tile(np.repeat(letters, filters), len(some)),
                        "step": np.tile(np.arange(1, filters + 1, dtype=np.int32), len(some) * len(orders)),
                    }
                    | {name: found[name].ravel() for name in COUNTS}
                )

    return parts.mapInPandas(spread, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))
