import random
import zlib

import numpy as np
import pyarrow as pa

from fleetloom.llm import quality, queries

from .helpers import corpus, frame


def test_features_are_those_of_each_text_alone():
    texts = [t.encode() if t is not None else None for _, t in corpus()]
    text, bucket, value = quality.features(pa.array(texts, pa.binary()))
    for i in (0, 3, 9, 20):
        alone = quality.features(pa.array([texts[i]], pa.binary()))
        mine = text == i
        assert sorted(zip(bucket[mine], value[mine], strict=True)) == sorted(zip(alone[1], alone[2], strict=True))


def test_learns_a_difference():
    draw = random.Random(3)
    texts = [" ".join(draw.choice("abcdef") + ("!!" if i % 3 == 0 else "") for _ in range(30)) for i in range(300)]
    text, bucket, value = quality.features(pa.array([t.encode() for t in texts], pa.binary()))
    rows = [(int(i % 3 != 0), bucket[text == i], value[text == i]) for i in range(300)]
    w = quality.follow_leader(rows[:200], quality.BUCKET_BITS, 4)
    assert all((w[at] @ v > 0) == bool(y) for y, at, v in rows[200:])


def test_awkward_tables(spark):
    rows = corpus()
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(0, 1), (3, 0), (None, 1), (6, None), (6, 1), (6, 0), (999, 0)], "doc_id long, quality int")
    found = quality.quality_scores(docs, labels).collect()
    assert len(found) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in found)
    assert quality.quality_scores(docs, labels.limit(0)).where("score = 0.5").count() == len(rows)
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels, 0.0).columns == docs.columns
    assert quality.keep_good(docs, labels, 0.0).count() == len(rows)


def test_an_id_on_many_rows_teaches_once(spark):
    texts = [(i, f"word{i % 5} other{i % 3} words") for i in range(1, 40)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int")
    hot = next(i for i, _ in texts if zlib.crc32(str(i).encode()) % 4 != 2)
    once = quality.train(frame(spark, texts), labels)
    many = quality.train(frame(spark, texts + [texts[hot - 1]] * 500), labels)
    assert np.array_equal(once, many)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    scored = queries.op8_quality(spark, folder).where("held_out")
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("score", "predicted", "quality").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.97
    good, bad = rows.score[rows.quality == 1].to_numpy(), rows.score[rows.quality == 0].to_numpy()
    assert np.mean(good[:, None] > bad[None, :]) > 0.98
