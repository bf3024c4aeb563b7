"""Where the layers and the secrets of each cluster lie, as its own document tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetloom.functions.columns import ROLES, col_of
from fleetloom.sources.documents import classify_layer_paths, yaml_to_json

# Keys of a cluster document, and the name of its secrets beside it.
LAYER_FOLDER = "patchesDir"
SECRETS_FILE = "secretsPath"
DEFAULT_SECRETS = "secrets.yaml"

#: File system of a path: a scheme, and a host or bucket behind two slashes.
_SYSTEM = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/]*)?"


def clean_path(path: Column | str) -> Column:
    """*path* without empty, ``.`` and ``..`` parts; ``file:/x`` and ``file:///x`` become the same."""
    path = col_of(path)
    system, steps = F.regexp_extract(path, _SYSTEM, 0), F.split(F.regexp_replace(path, _SYSTEM, ""), "/")
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    walked = F.aggregate(
        F.filter(steps, lambda step: ~step.isin("", ".")),
        F.array().cast("array<string>"),
        lambda done, step: F.when(step == "..", up(done)).otherwise(F.concat(done, F.array(step))),
    )
    slashes = F.when(F.endswith(system, F.lit(":")), F.lit("//")).otherwise(F.lit(""))
    return F.concat(system, slashes, F.lit("/"), F.array_join(walked, "/"))


def path_from(folder: Column | str, given: Column | str) -> Column:
    """*given* as seen from *folder*; an absolute path without a scheme stays on the folder's file system."""
    folder, given = col_of(folder), col_of(given)
    system = F.regexp_extract(folder, _SYSTEM, 0)
    return clean_path(
        F.when(given.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), given)
        .when(F.startswith(given, F.lit("/")), F.concat(system, given))
        .otherwise(F.concat(folder, F.lit("/"), given))
    )


def cluster_places(texts: DataFrame, encoding: str = "yaml") -> DataFrame:
    """``(cluster_name, layer_root, secrets_file)`` from a table of documents ``(file, text)``.

    Without a setting of its own, layers lie in the folder of the document and secrets in
    ``secrets.yaml`` beside it, wherever the layers are.  Relative paths start at
    that folder.  Of several documents of a cluster one may give a place; two different
    ones are an error, and if none does, the first by file name counts.  Documents that are
    no cluster are left to :func:`fleetloom.sources.documents.parse_clusters`.
    """
    if encoding not in ("yaml", "json"):
        raise ValueError(f"encoding must be 'yaml' or 'json': {encoding!r}")
    documents = yaml_to_json(texts, "text") if encoding == "yaml" else texts.withColumnRenamed("text", "json")
    fields = F.from_json("json", f"clusterName string, {LAYER_FOLDER} string, {SECRETS_FILE} string").alias("c")
    folder = F.regexp_replace("file", "/[^/]*$", "")
    given = lambda key: F.when(F.col(f"c.{key}") != "", path_from(folder, F.col(f"c.{key}")))
    told = documents.select("file", fields).select(
        F.col("c.clusterName").alias("cluster_name"), given(LAYER_FOLDER).alias("root"), given(SECRETS_FILE).alias("secrets"),
        F.struct("file", clean_path(folder).alias("folder")).alias("at"),
    )
    ends = [end(c).alias(f"{c}_{end.__name__}") for c in ("root", "secrets") for end in (F.min, F.max)]
    found = told.where("cluster_name IS NOT NULL").groupBy("cluster_name").agg(F.min("at").alias("at"), *ends)
    differ = (F.col("root_min") < F.col("root_max")) | (F.col("secrets_min") < F.col("secrets_max"))
    failed = F.raise_error(F.concat("cluster_name", F.lit(": documents disagree on places"))).cast("boolean")
    # As a filter, the check runs whichever columns are read later.
    return found.where(F.when(differ, failed).otherwise(F.lit(True))).select(
        "cluster_name",
        F.coalesce("root_min", "at.folder").alias("layer_root"),
        F.coalesce("secrets_min", path_from("at.folder", F.lit(DEFAULT_SECRETS))).alias("secrets_file"),
    )


def layers_of_clusters(files: DataFrame, places: DataFrame) -> DataFrame:
    """Layer files of each cluster, from a table of *files* and the ``layer_root`` of each cluster.

    Replaces ``file`` by cluster_name, scope, scope_value and layer_path.  A folder may serve
    several clusters.  Each place where a path could leave a root is tried by one equi-join,
    so the roots need not be known to the driver; files elsewhere are left out.
    """
    others = [c for c in files.columns if c != "file"]
    steps = files.select(*others, F.split(clean_path("file"), "/").alias("_steps"))
    scopes = F.get("_steps", F.col("_at")).isin("all", "node", *ROLES)
    tried = steps.select("*", F.explode(F.sequence(F.lit(1), F.size("_steps") - 1)).alias("_at")).where(scopes)
    whole = F.array_join(F.slice("_steps", F.lit(1), F.col("_at")), "/")
    rest = F.array_join(F.slice("_steps", F.col("_at") + 1, F.size("_steps")), "/")
    cut = tried.select(*others, clean_path(whole).alias("_root"), F.concat(F.lit("_/"), rest).alias("_rest"))
    # Only the scope is read off the path; the name of the cluster comes from its document.
    scoped = classify_layer_paths(cut, "_rest").drop("cluster_name")
    roots = places.select("cluster_name", F.col("layer_root").alias("_root"))
    return scoped.join(roots, "_root").select("cluster_name", "scope", "scope_value", "layer_path", *others)
