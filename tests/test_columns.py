from pyspark.sql import functions as F
import pytest

from fleetloom.functions import columns as c


def values(df):
    return [row[0] for row in df.collect()]


@pytest.mark.parametrize(
    "version, expected",
    [
        ("1.13.0", True),
        ("v1.13", True),
        (" 1.14 ", True),
        ("2", True),
        ("1.13.0+build.5", True),
        ("1.12.99", False),
        ("1.13.0-alpha.1", False),
        ("1.13.1-alpha.1", True),
        ("", True),
        (None, True),
        ("latest", True),
        ("1.2.3.4", True),
        ("1.13-rc.1", True),
        ("1.13.0-01", True),
        ("1.99999999999999999999.0", True),
    ],
)
def test_version_gate(spark, version, expected):
    df = spark.createDataFrame([(version,)], "v string")
    assert values(df.select(c.version_gte("v", "1.13.0"))) == [expected]


def test_version_bound_must_be_released():
    with pytest.raises(ValueError):
        c.version_gte("v", "1.13.0-rc.1")


@pytest.mark.parametrize(
    "spec, total, expected",
    [
        ("1", 10, 1),
        ("5", 3, 3),
        ("5", 0, 5),
        ("+2", 9, 2),
        ("25%", 10, 3),
        ("25 %", 10, 3),
        ("1%", 5, 1),
        ("100%", 7, 7),
        ("50%", 0, 1),
        ("  4 ", 9, 4),
        ("0", 5, None),
        ("-1", 5, None),
        ("0%", 5, None),
        ("101%", 5, None),
        ("", 5, None),
        ("%", 5, None),
        ("half", 5, None),
    ],
)
def test_effective_parallel(spark, spec, total, expected):
    df = spark.createDataFrame([(spec, total)], "s string, n int")
    assert values(df.select(c.effective_parallel("n", "s"))) == [expected]


def test_references(spark):
    df = spark.createDataFrame(
        [("reg/metal-installer/abc:v1.2.3",), ("x/y:1",), ("abc:v1",), ("reg/a-b:v1",), (None,)],
        "r string",
    )
    rows = df.select(c.parse_ref("r").alias("p")).select("p.*").collect()
    assert [(r.schematic, r.version, r.error is None) for r in rows] == [
        ("abc", "1.2.3", True),
        ("y", "1", True),
        (None, None, False),
        (None, None, False),
        (None, None, False),
    ]


def test_predicates_and_display(spark):
    df = spark.createDataFrame(
        [("ENC[x]", "ref+vault://a"), ("x ENC[", " ref+vault://a"), ("", "ref+://a")], "a string, b string"
    )
    assert values(df.select(c.is_encrypted("a"))) == [True, False, False]
    assert values(df.select(c.is_ref("b"))) == [True, False, False]
    ids = spark.createDataFrame([("12345678",), ("123456789",)], "i string")
    assert values(ids.select(c.shorten("i"))) == ["12345678", "12345678..."]


def test_path_key_walks_directories(spark):
    df = spark.createDataFrame([("a.yaml",), ("a/b.yaml",), ("a/a/c.yaml",)], "p string")
    assert values(df.orderBy(c.path_key("p"))) == ["a/a/c.yaml", "a/b.yaml", "a.yaml"]


def test_url_part_of_bad_url_is_null(spark):
    df = spark.createDataFrame([("https://h:6443/x",), ("https://bad host/",)], "u string")
    assert values(df.select(c.url_part("u", "HOST"))) == ["h", None]


def test_installer_secure_boot_is_either_side(spark):
    df = spark.createDataFrame([(True, False), (False, True), (False, None)], "a boolean, b boolean")
    ref = c.installer_ref(*map(F.lit, ("f", "metal", "id", "v1.2.3")), "a", "b")
    assert values(df.select(ref)) == [
        "f/metal-installer-secureboot/id:v1.2.3",
        "f/metal-installer-secureboot/id:v1.2.3",
        "f/metal-installer/id:v1.2.3",
    ]
