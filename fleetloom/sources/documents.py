"""Cluster documents, layer files and multi-document texts as tables."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fleetloom.functions.columns import ROLES
from fleetloom.operators.nodes import rejection_reasons
from fleetloom.session import cut_lineage, listing_in_few_tasks, task_count

# File name pattern of a layer and key names of a cluster document.
LAYER_FILE_PATTERN = r".*\.ya?ml(\.tpl)?"
DEPRECATED_FIELD = "configDir"

_SETTINGS = {
    "talosVersion": "talos_version",
    "schematicId": "schematic_id",
    "factory": "factory",
    "platform": "platform",
}


def _text_fields(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


_SHARED = [
    *_text_fields(*_SETTINGS),
    T.StructField("secureboot", T.BooleanType()),
    T.StructField("data", T.VariantType()),
]
_NODE = T.StructType([*_text_fields("host", "ip", "role"), *_SHARED])
_CLUSTER = T.StructType(
    [
        *_text_fields("clusterName", "clusterEndpoint", "kubernetesVersion", DEPRECATED_FIELD),
        *_SHARED,
        T.StructField("nodes", T.ArrayType(_NODE)),
    ]
)
_DECODED = T.ArrayType(T.StructType(_text_fields("json", "error")))


def _yaml_loader():
    """Loader for the core scalars; numbers with a fraction and dates stay text."""
    try:
        import yaml
    except ImportError as missing:  # JSON input never gets here
        raise RuntimeError("YAML input needs the PyYAML package; JSON input does not") from missing

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        pass

    Loader.yaml_implicit_resolvers = {}
    Loader.add_implicit_resolver(
        "tag:yaml.org,2002:null", re.compile(r"^(?:~|null|Null|NULL|)$"), ["~", "n", "N", ""]
    )
    Loader.add_implicit_resolver(
        "tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF")
    )
    Loader.add_implicit_resolver(
        "tag:yaml.org,2002:int", re.compile(r"^[-+]?(?:0|[1-9][0-9]*)$"), list("-+0123456789")
    )
    Loader.add_implicit_resolver("tag:yaml.org,2002:merge", re.compile(r"^(?:<<)$"), ["<"])
    return yaml, Loader


def _decode(text: str | None) -> list[dict[str, str | None]]:
    """JSON text or error of each document of one YAML text, in order."""
    yaml, loader = _yaml_loader()
    found: list[dict[str, str | None]] = []
    try:
        for document in yaml.load_all(text or "", Loader=loader):
            found.append({"json": json.dumps(document, ensure_ascii=False), "error": None})
    except (yaml.YAMLError, TypeError, ValueError) as problem:
        found.append({"json": None, "error": f"undecodable: {str(problem).splitlines()[0]}"})
    return found


@F.pandas_udf(_DECODED)
def _decoded_yaml(texts: pd.Series) -> pd.Series:
    return texts.map(_decode)


def yaml_to_json(df: DataFrame, text_col: str) -> DataFrame:
    """One row per YAML document: ``position, json, error`` instead of *text_col*.

    The only step that leaves the JVM; Spark hands it Arrow batches of texts.
    """
    keep = [c for c in df.columns if c != text_col]
    return df.select(*keep, F.posexplode(_decoded_yaml(text_col)).alias("position", "_d")).select(
        *keep, "position", F.col("_d.json").alias("json"), F.col("_d.error").alias("error")
    )


def read_texts(spark: SparkSession, path: str, layout: str = "file") -> DataFrame:
    """Texts below *path* with their origin: one per file, or one per line."""
    if layout not in ("file", "line"):
        raise ValueError(f"layout must be 'file' or 'line': {layout!r}")
    with listing_in_few_tasks(spark):
        texts = spark.read.text(path, wholetext=layout == "file", recursiveFileLookup=True)
    return texts.select(_decoded_path().alias("file"), F.col("value").alias("text"))


def _decoded_path() -> Column:
    """File path of the row with its percent escapes resolved."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _wrong(value: str, fields: list[T.StructField], prefix: str) -> str:
    """Expression: names of the fields of a VARIANT object that do not have their type."""
    checks = []
    for field in fields:
        kind = f"coalesce(schema_of_variant(try_variant_get({value}, '$.{field.name}', 'variant')), 'VOID')"
        if isinstance(field.dataType, T.BooleanType):
            fits = f"{kind} in ('BOOLEAN', 'VOID')"
        elif isinstance(field.dataType, T.StringType):
            fits = f"not startswith({kind}, 'OBJECT') and not startswith({kind}, 'ARRAY')"
        else:
            start = "ARRAY" if isinstance(field.dataType, T.ArrayType) else "OBJECT"
            fits = f"(startswith({kind}, '{start}') or {kind} = 'VOID')"
        checks.append(f"if({fits}, null, '{prefix}{field.name}')")
    return f"array_compact(array({', '.join(checks)}))"


def _mistyped() -> Column:
    node = _wrong("n", _NODE.fields, "nodes.")
    is_object = "startswith(schema_of_variant(n), 'OBJECT')"
    nodes = f"transform(try_variant_get(_v, '$.nodes', 'array<variant>'), n -> if({is_object}, {node}, array('nodes')))"
    return F.expr(f"array_distinct(concat({_wrong('_v', _CLUSTER.fields, '')}, coalesce(flatten({nodes}), array())))")


def _bad_nodes() -> Column:
    reasons = lambda n: F.array_join(rejection_reasons(n["role"], n["host"]), ", ")
    found = F.filter(F.transform("c.nodes", reasons), lambda text: text != "")
    return F.coalesce(found, F.array().cast("array<string>"))


def _listed(label: str, found: Column, between: str) -> Column:
    """Label and entries of a list that is computed once; null if it is empty."""
    text = lambda names: F.when(F.size(names) > 0, F.concat(F.lit(label), F.array_join(names, between)))
    return F.get(F.transform(F.array(found), text), F.lit(0))


def _given(variant: str) -> Column:
    """The VARIANT column, where a JSON null is no value."""
    return F.when(~F.is_variant_null(variant), F.col(variant))


def _one_per_name(given: DataFrame) -> DataFrame:
    """Settings of each cluster: the one value of each column; two different ones are an error."""
    names = [c for c in given.columns if c != "cluster_name"]
    # A VARIANT has no order; objects hold their keys sorted, so equal ones have equal text.
    plain = {c: F.to_json(c) if c == "data" else F.col(c) for c in names}
    ends = [F.struct(F.min(plain[c]).alias("low"), F.max(plain[c]).alias("high")).alias(f"_{c}") for c in names]
    found = given.groupBy("cluster_name").agg(*[F.first(c, ignorenulls=True).alias(c) for c in names], *ends)
    differing = F.array_compact(F.array(*[F.when(F.col(f"_{c}.low") < F.col(f"_{c}.high"), F.lit(c)) for c in names]))
    failed = F.raise_error(F.concat("cluster_name", F.lit(": documents disagree on "), F.array_join(differing, ", ")))
    # As a filter, the check runs whichever columns are read later.
    fine = F.when(F.size(differing) == 0, F.lit(True)).otherwise(failed.cast("boolean"))
    return found.where(fine).select("cluster_name", *names)


def parse_clusters(texts: DataFrame, encoding: str = "yaml") -> tuple[DataFrame, DataFrame]:
    """(clusters, nodes) from a table of documents ``(file, text)``.

    Schemas are fixed; ``data`` stays a VARIANT.  A document that cannot be
    read, has a field of the wrong type or a node without host or valid role, or uses a
    deprecated field stops the load.  Unknown fields are ignored.  A cluster may be
    spread over several documents of the same name; each setting is the one value that
    they give.  Documents that give two values of one setting stop the load of clusters.
    """
    if encoding == "yaml":
        documents = yaml_to_json(texts, "text").where(F.col("json").isNull() | (F.col("json") != "null"))
    elif encoding == "json":
        documents = texts.select("file", F.col("text").alias("json"), F.lit(None).cast("string").alias("error"))
    else:
        raise ValueError(f"encoding must be 'yaml' or 'json': {encoding!r}")
    decoded = F.struct(parse_whole("json").alias("_v"), F.from_json("json", _CLUSTER, {"mode": "PERMISSIVE"}).alias("c"))
    # A generator, because a filter is not moved below it: the checks see decoded fields, not texts to decode again.
    parsed = documents.select("file", "error", F.inline(F.array(decoded)))
    problem = F.coalesce(
        F.col("error"),
        F.when(F.col("_v").isNull(), F.lit("not one document")),
        _listed("wrong type of ", _mistyped(), ", "),
        _listed("bad node: ", _bad_nodes(), "; "),
        F.when(F.col("c").isNull() | F.col("c.clusterName").isNull(), F.lit("not a cluster document")),
        F.when(F.coalesce(F.col(f"c.{DEPRECATED_FIELD}"), F.lit("")) != "", F.lit(f"deprecated field {DEPRECATED_FIELD}")),
    )
    failed = F.raise_error(F.concat(F.col("file"), F.lit(": "), problem))
    # As a filter, the check runs whichever columns are read later.
    fine = F.when(problem.isNull(), F.lit(True)).otherwise(failed.cast("boolean"))
    checked = parsed.where(fine).select(F.col("c.clusterName").alias("cluster_name"), "c")
    columns = {"clusterEndpoint": "cluster_endpoint", "kubernetesVersion": "kubernetes_version"} | _SETTINGS
    settings = [F.col(f"c.{key}").alias(column) for key, column in columns.items()]
    given = checked.select("cluster_name", *settings, "c.secureboot", _given("c.data").alias("data"))
    clusters = _one_per_name(given).withColumn("secureboot", F.coalesce("secureboot", F.lit(False)))
    node = checked.select("cluster_name", F.explode("c.nodes").alias("n"))
    nodes = node.select(
        "cluster_name",
        *[F.col(f"n.{field}").alias(field) for field in ("host", "ip", "role")],
        *[F.col(f"n.{key}").alias(column) for key, column in _SETTINGS.items()],
        F.coalesce("n.secureboot", F.lit(False)).alias("secureboot"),
        F.col("n.data").alias("data"),
    )
    return clusters, nodes


def load_clusters(
    spark: SparkSession, path: str, encoding: str = "yaml", layout: str = "file"
) -> tuple[DataFrame, DataFrame]:
    """Read cluster documents; *layout* ``line`` holds one JSON document per line."""
    return parse_clusters(read_texts(spark, path, layout), encoding)


def classify_layer_paths(files: DataFrame, path_col: str) -> DataFrame:
    """Scope of layer files from ``<cluster>/(all|<role>|node/<host>)/...`` paths.

    Replaces *path_col* by cluster_name, scope, scope_value and layer_path, and
    leaves out files elsewhere or with another kind of name.
    """
    roles = "|".join(ROLES)
    pattern = rf"^([^/]+)/(?:(all)|({roles})|node/([^/]+))/(.+)$"
    part = [F.nullif(F.regexp_extract(path_col, pattern, i), F.lit("")) for i in range(1, 6)]
    found = files.select(
        *[c for c in files.columns if c != path_col],
        part[0].alias("cluster_name"),
        F.when(part[1].isNotNull(), F.lit("all"))
        .when(part[2].isNotNull(), F.lit("role"))
        .otherwise(F.lit("node"))
        .alias("scope"),
        F.coalesce(part[2], part[3]).alias("scope_value"),
        part[4].alias("layer_path"),
    )
    file_name = F.element_at(F.split("layer_path", "/"), -1)
    return found.where(F.col("layer_path").isNotNull() & file_name.rlike(LAYER_FILE_PATTERN))


def discover_layers(spark: SparkSession, root: str) -> DataFrame:
    """Layer files below *root* with their scope and text; no folder, no layers, and an empty file is none."""
    base = root.rstrip("/")
    try:
        texts = read_texts(spark, base, "file")
    except AnalysisException as absent:
        if "PATH_NOT_FOUND" not in str(absent):
            raise
        texts = spark.createDataFrame([], "file string, text string")
    return classify_layer_paths(texts.withColumn("file", _below(F.col("file"), root)), "file")


def _below(path: Column, root: str) -> Column:
    folder = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return F.regexp_replace(path, f"^.*?{re.escape(folder)}/", "")


def _inside(root: str) -> Column:
    """Path below *root* of the file that a row was read from."""
    return _below(_decoded_path(), root)


def _layer_texts(files: DataFrame, text_col: str, root: str) -> DataFrame:
    return classify_layer_paths(files.select(_inside(root).alias("file"), F.col(text_col).cast("string").alias("text")), "file")


#: So many changed files are read by their names; of more, all files are read and the changed ones kept.
NAMED_FILES = 10_000
_LAYER = ["cluster_name", "scope", "scope_value", "layer_path"]
_STATE = [*_LAYER, "modified", "size"]


def _files_below(spark: SparkSession, root: str) -> DataFrame | None:
    """All files below *root*, listed once; one is opened only where its ``content`` is read."""
    try:
        with listing_in_few_tasks(spark):
            return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root.rstrip("/"))
    except AnalysisException as absent:
        if "PATH_NOT_FOUND" not in str(absent):
            raise
        return None


def list_layers(spark: SparkSession, root: str) -> DataFrame:
    """Layer files below *root* with scope, time of change, size and ``source``; no file is opened."""
    return _listing_of(spark, _files_below(spark, root), root)


def _listing_of(spark: SparkSession, files: DataFrame | None, root: str) -> DataFrame:
    if files is None:
        return spark.createDataFrame([], _LISTING)
    listed = files.select(
        _inside(root).alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.col("path").alias("source")
    )
    return classify_layer_paths(listed, "file").select(*_STATE, "source").coalesce(task_count(spark))


_LISTING = "cluster_name string, scope string, scope_value string, layer_path string, modified timestamp, size long, source string"


def discover_changes(spark: SparkSession, root: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(listing, changes) of the layer files below *root* since the listing *known*.

    Changes are ``(cluster_name, scope, scope_value, layer_path, change, text)``; ``change`` is new,
    changed or gone, and the text of a file that is gone is null.  A file has changed when its time or
    size has; only such files are opened.  An empty file sets nothing and counts as none.  One that changes while this runs is found again by the next call.
    Keep the listing for that call once the changes have been worked in: then none is lost.
    """
    files = _files_below(spark, root)
    listing = cut_lineage(_listing_of(spark, files, root))
    known = spark.createDataFrame([], _LISTING) if known is None else known
    # As structs of keys, nulls equal each other.
    key, state = F.struct(*_LAYER).alias("_key"), F.struct(*_STATE).alias("_state")
    before = known.select(key, state)
    moved = listing.select("*", key, state).join(before.select("_state"), "_state", "left_anti")
    moved = moved.join(before.select("_key", F.lit("changed").alias("change")), "_key", "left")
    moved = cut_lineage(moved.select(*_LAYER, F.coalesce("change", F.lit("new")).alias("change"), "source"))
    names = [row["source"] for row in moved.select("source").limit(NAMED_FILES + 1).collect()]
    if len(names) > NAMED_FILES:
        texts = _layer_texts(files, "content", root).coalesce(task_count(spark))
    elif names:
        escaped = [re.sub(r"([\\{}\[\]*?])", r"\\\1", name) for name in names]
        with listing_in_few_tasks(spark):
            texts = _layer_texts(spark.read.text(escaped, wholetext=True), "value", root)
    else:
        texts = spark.createDataFrame([], _LISTING).select(*_LAYER, F.lit("").alias("text"))
    texts = texts.select(key, "text")
    found = moved.select("*", key).join(texts, "_key", "left").select(*_LAYER, "change", "text")
    gone = known.select("*", key).join(listing.select(key), "_key", "left_anti")
    gone = gone.select(*_LAYER, F.lit("gone").alias("change"), F.lit(None).cast("string").alias("text"))
    return listing, found.unionByName(gone)


#: Lines between documents: ``---`` or ``...``, with blanks or a comment behind it.
SEPARATOR = r"(?m)^(?:---|\.\.\.)(?:[ \t]+#.*|[ \t]*)$"


def _whole(body: str) -> str:
    """Expression of the VARIANT of a JSON text; null if anything follows its first value.

    The parser stops behind one value.  Here the text is followed by its own hash
    inside a list, and only a text that is one value leaves that hash in second place.
    """
    held = f"try_parse_json(concat('[', {body}, ',\"', md5({body}), '\"]'))"
    return (
        f"transform(array({held}), v -> if(try_variant_get(v, '$[1]', 'string') = md5({body}),"
        " try_variant_get(v, '$[0]', 'variant'), null))[0]"
    )


def parse_whole(text_col: str) -> Column:
    """VARIANT of a text column that holds exactly one JSON value; null for any other text."""
    return F.expr(_whole(f"`{text_col}`"))


def _judged(bodies: str) -> Column:
    """Array of ``(kind, body)`` for the array *bodies* of JSON document texts.

    Blank and comment lines before and behind a document do not belong to it.
    """
    lines = r"'^(?:[ \t]*(?:#.*)?(?:\r?\n|$))+|(?:\r?\n[ \t]*(?:#.*)?)+$'"
    trimmed = f"transform({bodies}, body -> regexp_replace(body, r{lines}, ''))"
    opened = (
        rf"transform({trimmed}, body -> struct(body, regexp_replace(body, r'\s+', '') as bare,"
        f" coalesce(schema_of_variant({_whole('body')}), '') as type))"
    )
    kind = """case when d.bare in ('', 'null', '{}') then 'skip'
        when d.type = '' then 'undecodable'
        when d.type = 'VOID' then 'skip'
        when startswith(d.type, 'ARRAY') then 'list of operations is not supported'
        when not startswith(d.type, 'OBJECT') then 'expected a mapping'
        else 'keep' end"""
    return F.expr(f"transform({opened}, d -> struct({kind} as kind, d.body as body))")


def _numbered(df: DataFrame, documents: Column, keep: list[str]) -> DataFrame:
    """Number the kept documents of each row; the first bad one fails the whole row."""
    staged = df.withColumn("_docs", F.filter(documents, lambda d: d["kind"] != "skip")).withColumn(
        "_bad", F.expr("cast(array_position(transform(_docs, d -> d.kind <> 'keep'), true) as int)")
    )
    rows = """if(_bad > 0,
        array(struct(_bad - 1 as doc_index, cast(null as string) as body, _docs[_bad - 1].kind as error)),
        transform(_docs, (d, i) -> struct(i as doc_index, d.body as body, cast(null as string) as error)))"""
    return staged.select(*keep, F.expr(f"inline({rows})"))


def split_documents(df: DataFrame, text_col: str) -> DataFrame:
    """Mapping documents of multi-document JSON texts: ``doc_index, body, error``.

    Documents are separated by ``---`` or ``...`` lines, which may end in a comment.
    Blank, comment-only and empty ones are skipped and not counted.  A text with a
    list, a scalar or an unreadable document, or with anything behind a document,
    gives one error row and none of its documents.  Row by row, in the JVM.
    """
    keep = [c for c in df.columns if c != text_col]
    parts = df.withColumn("_parts", F.split(text_col, SEPARATOR))
    return _numbered(parts, _judged("_parts"), keep)


def split_yaml_documents(df: DataFrame, text_col: str) -> DataFrame:
    """The same for YAML texts, decoded by Arrow batches."""
    keep = [c for c in df.columns if c != text_col]
    decoded = df.select(*keep, _decoded_yaml(text_col).alias("_decoded"))
    return _numbered(decoded, _judged("transform(_decoded, d -> coalesce(d.json, '?'))"), keep)
