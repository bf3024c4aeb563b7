"""Placeholder filling in layer templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FIELD = r"^\.[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z0-9_-]+)*$"


def _action(chunk: Column) -> Column:
    """Text between the braces; null when they are never closed."""
    return F.when(F.contains(chunk, F.lit("}}")), F.trim(F.substring_index(chunk, "}}", 1)))


def _rest(chunk: Column) -> Column:
    return F.substring(chunk, F.instr(chunk, "}}") + 2, F.length(chunk))


def fill_templates(
    df: DataFrame, template_col: str, context_col: str, where: Column | None = None
) -> DataFrame:
    """Fill ``{{ .Dotted.Key }}`` from a map column; add ``text`` and ``error``.

    A key the map lacks, or anything between the braces that is not a dotted
    key, is an error and leaves ``text`` null.  Rows that do not satisfy *where*
    are no templates and keep their text.  One row in, one row out: no join.
    """
    chunks = F.split(F.col(template_col), r"\{\{")
    if where is not None:
        chunks = F.when(F.coalesce(where, F.lit(False)), chunks).otherwise(F.array(template_col))
    holes = F.slice(chunks, 2, F.greatest(F.size(chunks) - 1, F.lit(0)))
    parts = F.transform(
        holes,
        lambda c: F.struct(
            _action(c).alias("action"),
            F.try_element_at(F.col(context_col), F.substring(_action(c), F.lit(2), F.length(c))).alias("value"),
            _rest(c).alias("rest"),
        ),
    )
    staged = df.withColumn("_head", F.element_at(chunks, 1)).withColumn("_parts", parts)
    unsupported = F.filter(
        "_parts", lambda p: ~F.coalesce(p["action"].rlike(FIELD), F.lit(False))
    )
    missing = F.filter(
        "_parts", lambda p: p["action"].rlike(FIELD) & p["value"].isNull()
    )
    filled = F.concat(
        F.col("_head"),
        F.array_join(F.transform("_parts", lambda p: F.concat(p["value"], p["rest"])), ""),
    )
    return (
        staged.withColumn(
            "error",
            F.when(F.size(unsupported) > 0, F.lit("unsupported template action")).when(
                F.size(missing) > 0,
                F.concat(
                    F.lit("missing key: "),
                    F.substring(F.element_at(missing, 1)["action"], F.lit(2), F.lit(1 << 20)),
                ),
            ),
        )
        .withColumn("text", F.when(F.col("error").isNull(), filled))
        .drop("_head", "_parts")
    )
