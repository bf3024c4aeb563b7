"""Drift from digests against the join of all leaves."""

import random

import pytest

from fleetloom.plans import drift

SCHEMA = "cluster string, host string, path array<string>, value string"


def leaves(spark, documents):
    rows = [(*key, list(path), value) for key, doc in documents.items() for path, value in doc.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "host")


def random_documents(rng, count=400):
    return {(f"c{i % 7}" if i % 50 else None, f"h{i}"): {(a, b): rng.choice(["1", "2", None]) for a in "uvw" for b in "xy"} for i in range(count)}


def changed(documents, rng, share):
    found = {}
    for key, doc in documents.items():
        doc = dict(doc)
        if rng.random() < share:
            act = rng.randrange(4)
            if act == 0:
                continue
            if act == 1:
                doc["u", "x"] = "9"
            elif act == 2:
                doc.pop(("v", "y"))
            else:
                doc["w", "new"] = None
        found[key] = doc
    return found | {("c1", "extra"): {("a",): "1"}}


def rows_of(df):
    return sorted((tuple(map(str, row)) for row in df.select("cluster", "host", "path", "desired", "current", "change").collect()), key=repr)


@pytest.mark.parametrize("sent", [100_000, 0])
@pytest.mark.parametrize("share", [0.02, 0.9])
def test_drift_is_that_of_all_leaves(spark, monkeypatch, sent, share):
    monkeypatch.setattr(drift, "SENT_KEYS", sent)
    rng = random.Random(5)
    documents = random_documents(rng)
    left, right = leaves(spark, documents), leaves(spark, changed(documents, rng, share))
    keys = ["cluster", "host"]
    wanted = drift.config_drift(left, right, keys).where("change <> 'same'")
    assert rows_of(drift.drift_by_digest(left, right, keys)) == rows_of(wanted)
    kept = drift.document_digests(left, keys).collect()
    given = spark.createDataFrame(kept, drift.document_digests(left, keys).schema)
    assert rows_of(drift.drift_by_digest(left, right, keys, desired_digests=given)) == rows_of(wanted)


def test_equal_documents_send_no_leaves(spark, monkeypatch):
    documents = random_documents(random.Random(1), 2000)
    some = {key: dict(doc) for key, doc in documents.items()}
    for i, key in enumerate(some):
        if i % 100 == 0:
            some[key]["u", "x"] = "changed"
    left, right = leaves(spark, documents), leaves(spark, some)
    kept, plain = [], drift.cut_lineage
    monkeypatch.setattr(drift, "cut_lineage", lambda df: kept.append((df, plain(df))) or kept[-1][1])
    assert drift.drift_by_digest(left, right, ["cluster", "host"]).count() == 20
    # One per cent of the documents differ, in one part of three; whole ones are what the first level passes on.
    (_, differing), (left_plan, left_rows), (_, right_rows) = kept
    assert differing.count() == 20
    assert left_rows.count() == right_rows.count() == 120 <= 0.02 * left.count()
    # They are picked where they are read, before any shuffle.
    assert "Exchange hashpartitioning" not in left_plan.where("true")._jdf.queryExecution().executedPlan().toString().split("BroadcastHashJoin")[0]


def test_bitmap_keeps_all_wanted_keys(spark, monkeypatch):
    monkeypatch.setattr(drift, "SENT_KEYS", 0)
    rows = spark.range(3000).selectExpr("CAST(id AS string) AS cluster", "'h' AS host", "array('a') AS path", "'v' AS value")
    wanted = rows.where("cluster % 3 = 0").selectExpr("struct(cluster, host) AS _key")
    assert drift._only(rows, ["cluster", "host"], wanted, 1000).count() == 1000


def test_empty_sides(spark):
    documents = random_documents(random.Random(2), 20)
    all_rows = leaves(spark, documents)
    keys = ["cluster", "host"]
    assert drift.drift_by_digest(all_rows, all_rows, keys).count() == 0
    assert drift.drift_by_digest(all_rows, all_rows.limit(0), keys).where("change = 'added'").count() == 120
    assert drift.drift_by_digest(all_rows.limit(0), all_rows, keys).where("change = 'removed'").count() == 120
    assert drift.drift_by_digest(all_rows.limit(0), all_rows.limit(0), keys).count() == 0
