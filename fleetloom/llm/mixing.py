"""Mixing sources to target weights in a domain, language, source tree.

A token budget goes down the tree: at each node the children share it by weight,
and what a child cannot supply is shared among its siblings.  A child's supply is
that of its whole subtree, so a shortage reaches the siblings of an ancestor only
when all leaves below that ancestor are used up.  A leaf's budget is a prefix of its
tokens in seeded epochs: whole passes over its documents, then the documents that
come first in the hash order of the next epoch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetloom.llm.shared import WHITE_SPACE, fits_broadcast, stored

#: Leading hex digits of the hash order that cut a leaf into even slices.
SLICE_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of words between white space; none for a null."""
    plain = F.btrim(F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, " " * len(WHITE_SPACE)))
    return F.when(plain == "", F.lit(0)).otherwise(F.size(F.split(plain, " +"))).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in an epoch: the order of hexadecimal hashes."""
    name = F.concat_ws("/", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.md5(name)


def share(children: DataFrame, parents: Sequence[str], child: str) -> DataFrame:
    """Budgets of ``children(*parents, child, weight, supply)`` from their parent's ``budget``.

    Every child gets the same multiple of its weight, or its supply if that is
    less, in whole tokens that add up to the parent's budget.
    """
    keys = list(parents) or [F.lit(0)]
    by_level = W.partitionBy(*keys).orderBy("ratio", child)
    earlier = by_level.rowsBetween(W.unboundedPreceding, -1)
    later = by_level.rowsBetween(0, W.unboundedFollowing)
    family = W.partitionBy(*keys)
    filled = F.col("filled")
    whole = F.floor("wanted")
    return (
        children.withColumn("ratio", F.when(F.col("weight") > 0, F.col("supply") / F.col("weight")).otherwise(0.0))
        .withColumn("before", F.coalesce(F.sum("supply").over(earlier), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(later))
        .withColumn("filled", F.col("before") + F.col("ratio") * F.col("rest") <= F.col("budget"))
        .withColumn("used", F.sum(F.when(filled, F.col("supply")).otherwise(0)).over(family))
        .withColumn("open", F.sum(F.when(filled, F.lit(0.0)).otherwise(F.col("weight"))).over(family))
        .withColumn(
            "wanted",
            F.when(filled, F.col("supply").cast("double")).otherwise(
                (F.col("budget") - F.col("used")) * F.col("weight") / F.col("open")
            ),
        )
        .withColumn("left", F.col("budget") - F.sum(whole).over(family))
        .withColumn("turn", F.row_number().over(W.partitionBy(*keys).orderBy(filled, (whole - F.col("wanted")), child)))
        .withColumn("share", F.least("supply", whole + (~filled & (F.col("turn") <= F.col("left"))).cast("int")))
        .select(*parents, child, "supply", F.col("share").cast("long").alias("budget"))
    )


def budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Sequence[Column], target: Column, max_epochs: int
) -> DataFrame:
    """``budget`` of each leaf of ``leaves(*levels, tokens)``; *weights* has one column for each level.

    The whole budget is *target*, an expression of the corpus's ``tokens``, or all
    that can be supplied in *max_epochs* passes if that is less.  A weight of 0 gives
    nothing.  Weights see levels as :func:`level_is` compares them.
    """
    supply = F.col("tokens") * max_epochs
    nodes = leaves.withColumn("supply", supply)
    for weight in weights:
        nodes = nodes.withColumn("supply", F.when(weight > 0, F.col("supply")).otherwise(0))
    total = nodes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("supply"), F.lit(0)).alias("_all"))
    budget = total.select(F.least(F.floor(target).cast("long"), F.col("_all"))).first()[0]
    above = None
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        parents = path[:-1]
        family = nodes.groupBy(*path).agg(F.sum("supply").alias("supply")).withColumn("weight", weights[depth].cast("double"))
        family = family.withColumn("weight", F.greatest("weight", F.lit(0.0)))
        if above is None:
            family = family.withColumn("budget", F.lit(budget))
        else:
            family = family.join(above.select(*parents, "budget"), parents)
        above = share(family, parents, level)
    return leaves.join(above.select(*levels, "budget"), list(levels))


def _level(name: str) -> Column:
    """A level's value as a text that is never null: null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("")).alias(name)


def level_is(name: str, value: str | None) -> Column:
    """Whether a tree level has this value, for use in weights."""
    return F.col(name) == ("" if value is None else f"={value}")


def plan(
    docs: DataFrame, levels: Sequence[str], weights: Sequence[Column], target: Column, max_epochs: int, seed: int
) -> tuple[DataFrame, DataFrame]:
    """Token counts of the documents, and each leaf's budget, whole epochs and cut.

    A document is in the last, partial epoch if its :func:`order_key` is not
    beyond ``cut``; the one at the cut gives only ``cut_tokens``.
    """
    counted = docs.select("doc_id", *[_level(name) for name in levels], word_count(F.col("text")).alias("n_tokens"))
    counted = stored(counted, "token-counts")
    leaves = counted.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    leaves = budgets(leaves, levels, weights, target, max_epochs)
    used = F.greatest("tokens", F.lit(1))
    leaves = leaves.withColumn("epochs", F.floor(F.col("budget") / used)).withColumn("part", F.col("budget") % used)
    leaves = stored(leaves, "leaf-budgets")
    small = F.broadcast(leaves) if fits_broadcast(leaves.count(), 256) else leaves
    ordered = counted.join(small.where("part > 0"), list(levels)).withColumn(
        "place", order_key(seed, F.col("epochs"), F.col("doc_id"))
    )
    piece = F.substring("place", 1, SLICE_DIGITS).alias("slice")
    ordered = ordered.select(*levels, "part", "place", "n_tokens", piece)
    earlier = W.partitionBy(*levels).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    cut_slice = (
        ordered.groupBy(*levels, "slice").agg(F.sum("n_tokens").alias("tokens"), F.first("part").alias("part"))
        .withColumn("before", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))
        .where((F.col("before") < F.col("part")) & (F.col("part") <= F.col("before") + F.col("tokens")))
        .select(*levels, "slice", "before")
    )
    inside = W.partitionBy(*levels).orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    cuts = (
        ordered.join(cut_slice, [*levels, "slice"])
        .groupBy(*levels, "place", "part", "before").agg(F.sum("n_tokens").alias("tokens"))
        .withColumn("before", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .where((F.col("before") < F.col("part")) & (F.col("part") <= F.col("before") + F.col("tokens")))
        .select(*levels, F.col("place").alias("cut"), (F.col("part") - F.col("before")).alias("cut_tokens"))
    )
    return counted, stored(leaves.join(cuts, list(levels), "left"), "leaf-cuts")


def mix(
    docs: DataFrame, levels: Sequence[str], weights: Sequence[Column], target: Column, max_epochs: int = 4, seed: int = 1
) -> DataFrame:
    """What of each row is taken: ``whole_epochs`` passes and ``part_tokens`` of one more.

    Rows without words are never taken.  Null levels are values of their own, null IDs
    have one place in the order.  Rows that repeat an ID share a place: at the cut they
    take the leaf's last tokens together, and each shows at most its own.
    """
    counted, leaves = plan(docs, levels, weights, target, max_epochs, seed)
    if fits_broadcast(leaves.count(), 256):
        leaves = F.broadcast(leaves)
    place = order_key(seed, F.col("epochs"), F.col("doc_id"))
    last = (
        F.when(place < F.col("cut"), F.col("n_tokens"))
        .when(place == F.col("cut"), F.least("cut_tokens", "n_tokens"))
        .otherwise(F.lit(0))
    )
    bare = [F.when(F.col(name) != "", F.substring(name, 2, 1 << 30)).alias(name) for name in levels]
    return counted.join(leaves, list(levels)).select(
        "doc_id", *bare, "n_tokens", F.col("budget").alias("leaf_budget"),
        F.col("epochs").cast("int").alias("whole_epochs"), last.cast("long").alias("part_tokens"),
    )


def keep_mixed(docs: DataFrame, levels: Sequence[str], weights: Sequence[Column], target: Column, seed: int = 1) -> DataFrame:
    """Rows of *docs*, with all their columns, that one seeded pass takes, in whole or in part.

    The decision is a comparison with the leaf's cut, so texts are not shuffled.
    Rows without words have nothing to take and go.
    """
    _, leaves = plan(docs, levels, weights, target, 1, seed)
    names = {name: f"_leaf_{i}_{name}" for i, name in enumerate(levels)}
    cuts = leaves.select(
        *[F.col(name).alias(inner) for name, inner in names.items()],
        F.col("epochs").alias("_leaf_epochs"), F.col("cut").alias("_leaf_cut"),
    )
    cuts = F.broadcast(cuts) if fits_broadcast(cuts.count(), 256) else cuts
    same = [_level_of(docs[name]) == cuts[inner] for name, inner in names.items()]
    condition = same[0]
    for other in same[1:]:
        condition = condition & other
    place = order_key(seed, F.col("_leaf_epochs"), docs["doc_id"])
    taken = (F.col("_leaf_epochs") > 0) | (place <= F.col("_leaf_cut"))
    taken = taken & (word_count(docs["text"]) > 0)
    return docs.join(cuts, condition).where(taken).select(*[docs[c] for c in docs.columns])


def _level_of(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))
