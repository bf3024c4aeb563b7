import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fleetloom.functions.columns import is_encrypted
from fleetloom.operators import nested, templates

DOC = """{"outer": {"inner": "found", "void": null}, "items": ["one", {"name": "two"}, []],
          "plain": "ENC", "sealed": "ENC[a]", "deep": {"x": ["p", {"y": "ENC[b]"}]}, "n": 7, "none": "", "gap": {}}"""


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, DOC)], "id int, t string").select("id", F.parse_json("t").alias("doc"))


@pytest.mark.parametrize(
    "path, found, value",
    [
        (["outer", "inner"], True, "found"),
        (["plain"], True, "ENC"),
        (["items", 0], True, "one"),
        (["items", 1, "name"], True, "two"),
        (["n"], True, "7"),
        (["outer", "void"], True, None),
        (["gone"], False, None),
        (["outer", 0], False, None),
        (["items", "name"], False, None),
        (["items", 9], False, None),
        (["plain", "x"], False, None),
    ],
)
def test_value_at(docs, path, found, value):
    row = nested.value_at(docs, "doc", path).first()
    assert (row.found, row.value) == (found, value)


def test_string_leaves_by_predicate(docs):
    leaves = nested.flatten_leaves(docs, "doc", 6)
    sealed = nested.string_leaves(leaves, is_encrypted)
    assert {".".join(r.path) for r in sealed.collect()} == {"sealed", "deep.x.1.y"}
    kinds = {".".join(r.path): (r.kind, r.value) for r in leaves.collect()}
    assert kinds["gap"] == ("empty", "{}")
    assert kinds["items.2"] == ("list", "[]")
    assert kinds["outer.void"] == ("null", None)
    assert kinds["n"] == ("scalar", "7")
    assert kinds["none"] == ("string", "")


def test_too_deep_is_an_error_not_a_loss(docs):
    with pytest.raises(PySparkException):
        nested.flatten_leaves(docs, "doc", 2).collect()
    assert nested.flatten_leaves(docs, "doc", 4).count() == nested.flatten_leaves(docs, "doc", 9).count()


def test_per_row_paths(spark, docs):
    wanted = spark.createDataFrame([(1, ["items", "0"]), (1, ["items", "x"])], "id int, path array<string>")
    found = nested.values_at(nested.flatten_leaves(docs, "doc", 6), wanted, ["id"])
    assert {(r.path[1], r.found, r.value) for r in found.collect()} == {("0", True, "one"), ("x", False, None)}


def pairs(spark, rows):
    return spark.createDataFrame(rows, "file string, doc_index int, t string").select(
        "file", "doc_index", F.try_parse_json("t").alias("doc")
    )


def test_extract_changed(spark):
    before = pairs(
        spark,
        [
            ("a", 0, '{"k": "ENC[1]", "p": "plain", "l": [{"s": "ENC[2]"}], "e": "ENC[3]", "n": "ENC[4]"}'),
            ("a", 1, '{"k": "ENC[5]"}'),
            ("a", 2, '{"k": "ENC[6]"}'),
            ("b", 0, '{"k": "ENC[7]"}'),
            ("b", 1, "{broken"),
            ("b", 2, '{"k": "ENC[8]"}'),
        ],
    )
    after = pairs(
        spark,
        [
            ("a", 0, '{"k": "same", "p": "plain", "l": [{"s": "same"}], "e": "", "n": 4}'),
            ("a", 1, '{"k": "second"}'),
            ("b", 0, '{"k": "third"}'),
            ("b", 1, '{"k": "x"}'),
            ("b", 2, '{"k": "late"}'),
        ],
    )
    got = sorted(r.secret for r in nested.extract_changed(before, after, is_encrypted).collect())
    assert got == ["same", "same", "second", "third"]


def test_extract_changed_at_odd_keys(spark):
    keys = ["it's", 'a "b"', "q?", " lead", "", "a.b[0]", "0", "x]['y", "tail \n", "\u00e9", "two'\"marks"]
    sealed = json.dumps({key: {"in": ["ENC[1]", {key: "ENC[2]"}]} for key in keys})
    plain = json.dumps({key: {"in": [f"first {i}", {key: f"second {i}"}]} for i, key in enumerate(keys)})
    before, after = (pairs(spark, [("f", 0, text)]) for text in (sealed, plain))
    got = {tuple(r.path): r.secret for r in nested.extract_changed(before, after, is_encrypted).collect()}
    assert got == {(key, "in", "0"): f"first {i}" for i, key in enumerate(keys)} | {
        (key, "in", "1", key): f"second {i}" for i, key in enumerate(keys)
    }


def test_one_flatten_per_extraction_and_one_generator_per_level(spark):
    rows = pairs(spark, [("a", 0, '{"k": "ENC[1]"}')])
    plan = nested.extract_changed(rows, rows, is_encrypted, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate variant_explode") == 3
    assert "Join LeftOuter" in plan and "LateralJoin" not in plan


def test_columns_named_like_those_of_the_generator(spark):
    docs = spark.createDataFrame([(1, 2, 3, '{"a": {"b": 1}}')], "key int, value int, pos int, t string")
    leaves = nested.flatten_leaves(docs.select("key", F.col("value").alias("val"), "pos", F.parse_json("t").alias("doc")), "doc")
    assert [tuple(r) for r in leaves.collect()] == [(1, 2, 3, ["a", "b"], "scalar", "1")]


def test_docs_with_refs(spark):
    rows = [
        (1, '{"a": ["x", {"b": "ref+vault://p#/k"}]}'),
        (2, '{"a": "see ref+vault://p"}'),
        (3, '{"ref+vault://k": "v"}'),
        (4, '["ref+s3://b", "ref+s3://c"]'),
    ]
    docs = spark.createDataFrame(rows, "id int, t string").select("id", F.parse_json("t").alias("doc"))
    found = nested.docs_with_refs(nested.flatten_leaves(docs, "doc", 4), ["id"])
    assert sorted(r.id for r in found.collect()) == [1, 4]


@pytest.mark.parametrize(
    "template, text, failed",
    [
        ("", "", False),
        ("no holes }} here", "no holes }} here", False),
        ("{{ .A }}{{.B.c}}!", "1two!", False),
        ("line\n{{ .A }}\nend", "line\n1\nend", False),
        ("{{ .Missing }}", None, True),
        ("{{ .A | upper }}", None, True),
        ("{{ .A", None, True),
        ("$1 \\ {{ .D }}", "$1 \\ a$1\\b", False),
    ],
)
def test_fill_templates(spark, template, text, failed):
    context = {"A": "1", "B.c": "two", "D": "a$1\\b"}
    df = spark.createDataFrame([(template, context)], "t string, c map<string,string>")
    row = templates.fill_templates(df, "t", "c").first()
    assert (row.text, row.error is not None) == (text, failed)


def test_values_at_own_paths(spark):
    doc = '{"a": {"1": "key", "b": [10, {"c": null}], "e": {}}, "s": "text"}'
    wanted = {
        ("a", "1"): (True, "key"),
        ("a", "b", "0"): (True, "10"),
        ("a", "b", "00"): (False, None),
        ("a", "b", "1", "c"): (True, None),
        ("a", "b", "2"): (False, None),
        ("a", "b", "x"): (False, None),
        ("s",): (True, "text"),
        ("s", "x"): (False, None),
        ("a", "e"): (True, "{}"),
        ("gone",): (False, None),
    }
    rows = spark.createDataFrame([(doc, list(path)) for path in wanted], "t string, path array<string>")
    docs = rows.select("path", F.parse_json("t").alias("doc"))
    found = nested.values_at_paths(docs, "doc", "path", 5).collect()
    assert {tuple(r.path): (r.found, r.value) for r in found} == wanted
    assert not any(r.found for r in nested.values_at_paths(docs, "doc", "path", 1).collect() if len(r.path) > 1)
