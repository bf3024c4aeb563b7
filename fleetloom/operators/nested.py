"""Nested documents held as VARIANT: leaves, paths and paired extraction."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetloom.functions.columns import REF_PATTERN

# Keys of a merge directive inside a layer document.
DELETE_KEY = "$patch"
DELETE_VALUE = "delete"


def _kind(value: str) -> Column:
    """map, empty, list, null, string or scalar; the schema text is computed once."""
    return F.expr(
        f"transform(array(schema_of_variant({value})), s -> case when s = 'STRING' then 'string'"
        " when s = 'OBJECT<>' then 'empty' when startswith(s, 'OBJECT') then 'map' when startswith(s, 'ARRAY')"
        " then 'list' when s = 'VOID' then 'null' else 'scalar' end)[0]"
    )


# Expressions over the document column ``_v``, as text.
_IS_DELETE = (
    f"coalesce(try_variant_get(_v, \"$['{DELETE_KEY}']\", 'string') = '{DELETE_VALUE}', false)"
)
_HAS_ITEMS = "(try_variant_get(_v, '$[0]', 'variant') is not null)"
_HAS_KEYS = "coalesce(size(try_variant_get(_v, '$', 'map<string,variant>')) > 0, false)"
#: Keys that a path text may hold between quotes; the path parser skips white space and stops at these marks.
_PLAIN_KEY = r"^[^'?\s][^'?]*$"


def _opened(state: DataFrame, keep: Sequence[str], walk_lists: bool, directives: bool) -> DataFrame:
    """Each container gives way to its children; leaves and empty containers stay."""
    closed = [*([] if walk_lists else [_HAS_ITEMS]), *([_IS_DELETE] if directives else [])]
    opened = F.expr(f"if({' or '.join(closed)}, null, _v)") if closed else F.col("_v")
    children = state.sparkSession.tvf.variant_explode_outer(F.col("_open").outer()).toDF("_pos", "_key", "_child")
    # The path as a text too; null where a key cannot be written into one.
    place = F.when(F.isnull("_key"), F.concat(F.lit("["), "_pos", F.lit("]"))).when(
        F.col("_key").rlike(_PLAIN_KEY), F.concat(F.lit("['"), "_key", F.lit("']"))
    )
    leaf, step = F.isnull("_child"), F.coalesce("_key", F.col("_pos").cast("string"))
    return state.withColumn("_open", opened).lateralJoin(children).select(
        *keep,
        F.when(leaf, F.col("path")).otherwise(F.concat("path", F.array(step))).alias("path"),
        F.when(leaf, F.col("_at")).otherwise(F.concat("_at", place)).alias("_at"),
        F.coalesce("_child", "_v").alias("_v"),
    )


def _leaves(
    df: DataFrame, variant_col: str, max_depth: int, walk_lists: bool, directives: bool, mark_deep: bool
) -> DataFrame:
    """The rows of :func:`flatten_leaves`, and their path as a text ``_at`` for ``try_variant_get``."""
    keep = [c for c in df.columns if c != variant_col]
    state = df.select(
        *keep,
        F.array().cast("array<string>").alias("path"),
        F.lit("$").alias("_at"),
        F.col(variant_col).alias("_v"),
    )
    for _ in range(max_depth):
        state = _opened(state, keep, walk_lists, directives)
    deeper = F.expr(f"{_HAS_KEYS} and not {_IS_DELETE}" if directives else _HAS_KEYS)
    if walk_lists:
        deeper = deeper | F.expr(_HAS_ITEMS)
    # As a filter, the check runs whichever columns are read later.
    failed = F.raise_error(F.lit(f"document deeper than {max_depth}")).cast("boolean")
    whole = F.lit(True) if mark_deep else F.when(deeper, failed).otherwise(F.lit(True))
    named = state.where(F.col("_v").isNotNull() & whole).withColumn("_k", _kind("_v"))
    kind = F.when(F.col("_k").isin("string", "scalar", "null"), F.col("_k"))
    if mark_deep:
        kind = kind.when(deeper, F.lit("deep"))
    if directives:
        kind = kind.when((F.col("_k") == "map") & F.expr(_IS_DELETE), F.lit("delete"))
    kind = kind.when(F.col("_k") == "empty", F.lit("empty")).otherwise(F.lit("list"))
    return named.select(
        *keep,
        "path",
        kind.alias("kind"),
        F.when(F.col("_k") == "string", F.try_variant_get("_v", "$", "string"))
        .when((F.col("_k") == "null") | (F.lit(directives) & F.expr(_IS_DELETE)), F.lit(None))
        .otherwise(F.to_json("_v"))
        .alias("value"),
        "_at",
    )


def flatten_leaves(
    df: DataFrame,
    variant_col: str,
    max_depth: int = 16,
    walk_lists: bool = True,
    directives: bool = False,
    mark_deep: bool = False,
) -> DataFrame:
    """One row per leaf of a nested document: ``path ARRAY<STRING>, kind, value``.

    Each level is one generator over the rows above it, so the table is read
    once and nothing is shuffled; rows that are leaves pass further levels as they are.
    ``kind`` is string, scalar, null, and for
    containers kept whole ``empty`` (an empty map) or ``list``.  With
    *walk_lists* list items become leaves with their index in the path;
    otherwise a list is one leaf.  With *directives* a map that holds
    ``$patch: delete`` becomes a leaf of kind ``delete``.  Documents deeper than
    *max_depth* stop the job rather than lose leaves; with *mark_deep* what lies
    deeper is one leaf of kind ``deep`` instead.
    """
    return _leaves(df, variant_col, max_depth, walk_lists, directives, mark_deep).drop("_at")


def string_leaves(
    leaves: DataFrame, predicate: Callable[[Column], Column] | None = None
) -> DataFrame:
    """String leaves, optionally only those whose value satisfies *predicate*."""
    strings = leaves.where(F.col("kind") == "string")
    return strings if predicate is None else strings.where(predicate(F.col("value")))


def variant_path(path: Sequence[str | int]) -> str:
    steps = []
    for part in path:
        if isinstance(part, int):
            steps.append(f"[{part}]")
        elif "'" in part:
            raise ValueError(f"key with a quote needs a path join: {part!r}")
        else:
            steps.append(f"['{part}']")
    return "$" + "".join(steps)


def value_at(
    df: DataFrame, variant_col: str, path: Sequence[str | int], out: str = "value"
) -> DataFrame:
    """Add ``found`` and the value at one fixed path as text.

    A missing key, an index out of range or the wrong kind of container is
    "not found"; a JSON null that is there is found.
    """
    held = df.withColumn("_at", F.try_variant_get(variant_col, variant_path(path), "variant"))
    text = F.coalesce(
        F.when(_kind("_at") == "string", F.try_variant_get("_at", "$", "string")),
        F.when(~F.is_variant_null("_at"), F.to_json("_at")),
    )
    return held.withColumns({"found": F.col("_at").isNotNull(), out: text}).drop("_at")


def values_at(leaves: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Look up per-row paths ``(keys, path)`` in a leaf table."""
    on = [*keys, "path"]
    side = leaves.select(F.struct(*on).alias("_key"), "value", F.lit(True).alias("_hit"))
    keyed = wanted.withColumn("_key", F.struct(*on))
    return keyed.join(side, "_key", "left").select(
        *wanted.columns, F.coalesce("_hit", F.lit(False)).alias("found"), "value"
    )


def values_at_paths(
    df: DataFrame, variant_col: str, path_col: str, max_depth: int = 16, out: str = "value"
) -> DataFrame:
    """Add ``found`` and the value at each row's own path, an array of keys and indices as text.

    Only the containers on the path are opened, row by row in the JVM; nothing is
    exploded or joined.  Missing keys, indices out of range, containers of the wrong kind and
    paths longer than *max_depth* are "not found".
    """
    held = df.withColumn("_v", F.col(variant_col))
    for depth in range(max_depth):
        step = F.get(path_col, F.lit(depth))
        number = step.try_cast("int")
        index = F.when((number >= 0) & (number.cast("string") == step), number)
        inner = F.coalesce(
            F.try_element_at(F.try_variant_get("_v", "$", "map<string,variant>"), step),
            F.get(F.try_variant_get("_v", "$", "array<variant>"), index),
        )
        held = held.withColumn("_v", F.when(F.size(path_col) > depth, inner).otherwise(F.col("_v")))
    held = held.withColumn("_v", F.when(F.size(path_col) <= max_depth, F.col("_v")))
    text = F.coalesce(
        F.when(_kind("_v") == "string", F.try_variant_get("_v", "$", "string")),
        F.when(~F.is_variant_null("_v"), F.to_json("_v")),
    )
    return held.withColumns({"found": F.col("_v").isNotNull(), out: text}).drop("_v")


# Values of ``doc`` at the places in ``_asked``; a path that is no text is walked key by key.
_STEP = """coalesce(try_element_at(try_variant_get(v, '$', 'map<string,variant>'), step),
    get(try_variant_get(v, '$', 'array<variant>'), if(step rlike '^(0|[1-9][0-9]*)$', try_cast(step as int), null)))"""
_FOUND = f"""transform(_asked, a -> struct(a.path as path, if(a.at is not null,
    try_variant_get(doc, a.at, 'variant'), aggregate(a.path, doc, (v, step) -> {_STEP})) as found))"""


def extract_changed(
    before: DataFrame,
    after: DataFrame,
    predicate: Callable[[Column], Column],
    max_depth: int = 16,
) -> DataFrame:
    """After-values at the paths whose before-value matched *predicate*.

    Both sides are ``(file, doc_index, doc VARIANT)``; a null ``doc`` could not be
    decoded and ends its file there.  Only non-empty strings are returned and
    duplicates stay.  Only *before* is flattened: the matching paths of a document
    meet its other form once and are looked up there.
    """
    broken = (
        before.where(F.col("doc").isNull())
        .select("file", "doc_index")
        .unionByName(after.where(F.col("doc").isNull()).select("file", "doc_index"))
        .groupBy("file")
        .agg(F.min("doc_index").alias("_stop"))
    )
    on = ["file", "doc_index"]
    leaves = _leaves(before.select(*on, "doc"), "doc", max_depth, walk_lists=True, directives=False, mark_deep=False)
    # At most as many paths as the document has leaves.
    asked = F.collect_list(F.struct("path", F.col("_at").alias("at"))).alias("_asked")
    marked = string_leaves(leaves, predicate).groupBy(*on).agg(asked)
    found = marked.join(after.select(*on, "doc"), on).select(*on, F.expr(f"inline({_FOUND})"))
    plain = found.where(F.schema_of_variant("found") == "STRING")
    return (
        plain.select(*on, "path", F.try_variant_get("found", "$", "string").alias("secret"))
        .where(F.col("secret") != "")
        .join(broken, "file", "left")
        .where(F.col("_stop").isNull() | (F.col("doc_index") < F.col("_stop")))
        .select(*on, "path", "secret")
    )


def docs_with_refs(leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the documents that hold at least one external reference."""
    return string_leaves(leaves, lambda v: v.rlike(REF_PATTERN)).select(*keys).distinct()
