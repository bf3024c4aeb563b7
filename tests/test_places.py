import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fleetloom.sources import documents, places


@pytest.mark.parametrize(
    "folder, given, wanted",
    [
        ("file:///conf/east", "layers", "file:///conf/east/layers"),
        ("file:/conf/east", "./a//b/", "file:///conf/east/a/b"),
        ("s3a://bucket/conf", "../../..", "s3a://bucket/"),
        ("s3a://bucket/conf", "/other", "s3a://bucket/other"),
        ("s3a://bucket/conf", "file:/local/x", "file:///local/x"),
        ("/conf/east", "../west", "/conf/west"),
        ("/conf/east", "...", "/conf/east/..."),
    ],
)
def test_path_from(spark, folder, given, wanted):
    row = spark.createDataFrame([(folder, given)], "f string, g string")
    assert row.select(places.path_from("f", "g")).first()[0] == wanted


def texts(spark, rows):
    return spark.createDataFrame(rows, "file string, text string")


def test_places_of_documents(spark):
    rows = [
        ("/c/b.json", '{"clusterName": "two", "secretsPath": ""}'),
        ("/a/a.json", '{"clusterName": "two", "patchesDir": "x"}'),
        ("/z/z.json", '{"clusterName": "plain", "patchesDir": null}'),
        ("/z/y.json", '{"other": 1}'),
        ("/z/x.json", None),
    ]
    found = {tuple(r) for r in places.cluster_places(texts(spark, rows), "json").collect()}
    assert found == {("two", "/a/x", "/a/secrets.yaml"), ("plain", "/z", "/z/secrets.yaml")}
    assert places.cluster_places(texts(spark, []), "json").count() == 0


def test_two_places_stop_the_load(spark):
    rows = [(f"/c/{n}.json", f'{{"clusterName": "east", "patchesDir": "{n}"}}') for n in "ab"]
    with pytest.raises(PySparkException, match="east: documents disagree on places"):
        places.cluster_places(texts(spark, rows), "json").collect()
    with pytest.raises(ValueError, match="encoding"):
        places.cluster_places(texts(spark, rows), "xml")


def test_layers_of_real_files(spark, tmp_path):
    held = {
        "east/cluster.json": '{"clusterName": "east"}',
        "west/cluster.json": '{"clusterName": "west", "patchesDir": "../east"}',
        "north/cluster.json": '{"clusterName": "north", "patchesDir": "all"}',
        "east/all/a.yaml": "e",
        "east/node/e 1/all/b.yml.tpl": "n",
        "north/all/worker/c.yaml": "w",
        "north/worker/d.yaml": "outside",
        "east/all/readme.md": "no layer",
    }
    for name, text in held.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    read = documents.read_texts(spark, str(tmp_path)).cache()
    found = places.cluster_places(read.where(F.endswith("file", F.lit(".json"))), "json")
    layers = places.layers_of_clusters(read, found)
    wanted = {("north", "role", "worker", "c.yaml", "w")}
    for name in ("east", "west"):
        wanted |= {(name, "all", None, "a.yaml", "e"), (name, "node", "e 1", "all/b.yml.tpl", "n")}
    assert {tuple(r) for r in layers.collect()} == wanted
    assert layers.count() == len(wanted)
