import random
import zlib

import numpy as np
import pyarrow as pa

from fleetloom.llm import queries, toxicity as X

from .helpers import corpus, frame


def slow_segments(scores):
    """Maximal segments by definition: the best one, then those of what is left on both sides."""
    best, at = 0, None
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            # Of equal sums the one that begins last, and no longer than needed.
            if total > best or (at and total == best and i > at[0]):
                best, at = total, (i, j + 1)
    if at is None:
        return []
    i, j = at
    left = slow_segments(scores[:i])
    right = [(a + j, b + j, s) for a, b, s in slow_segments(scores[j:])]
    return [*left, (i, j, best), *right]


def test_segments_are_all_maximal_ones():
    draw = random.Random(2)
    for _ in range(400):
        # Scores that are powers of different sizes have no ties between sums.
        scores = [draw.choice([-1, 1]) * draw.randint(1, 10**9) for _ in range(draw.randint(0, 25))]
        found = X.maximal_segments(np.array(scores, np.int64))
        assert found == slow_segments(scores)


def test_segments_with_ties_and_zeros():
    draw = random.Random(5)
    for _ in range(300):
        scores = [draw.randint(-2, 2) for _ in range(draw.randint(0, 20))]
        found = X.maximal_segments(np.array(scores, np.int64))
        assert sorted(s for _, _, s in found) == sorted(s for _, _, s in slow_segments(scores))
        assert all(s == sum(scores[a:b]) > 0 for a, b, s in found)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))


def test_best_segment_of_many_texts():
    draw = random.Random(3)
    texts = [[draw.randint(-50, 40) for _ in range(draw.randint(0, 30))] for _ in range(200)]
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    scores = np.array([s for t in texts for s in t], np.int64)
    found = X.best_segment(text, scores, len(texts))
    assert found.tolist() == [max([0, *[s for _, _, s in slow_segments(t)]]) for t in texts]
    assert X.best_segment(text[:0], scores[:0], 2).tolist() == [0, 0]


def test_law_is_recovered():
    draw = np.random.default_rng(4)
    words = draw.integers(20, 2000, 20000)
    rate, chance = 0.9, 0.02
    best = (np.log(chance * words) - np.log(draw.exponential(size=len(words)))) / rate
    best = np.maximum(np.rint(best * X.UNIT), 0).astype(np.int64)
    found_rate, found_chance = X.fit_law(best, words)
    assert abs(found_rate * X.UNIT / rate - 1) < 0.03 and abs(found_chance / chance - 1) < 0.1
    assert X.fit_law(best * 0, words)[0] > 0


def test_scores_leave_out_the_own_document():
    texts = pa.array([b"common words Badword", b"common words"], pa.binary())
    words, units = X.word_units(texts)
    toxic, total = np.zeros(1 << X.BUCKET_BITS, np.int32), np.zeros(1 << X.BUCKET_BITS, np.int32)
    text, unit = X.held_units(np.broadcast_to(words.text, units.shape), units)
    np.add.at(total, unit, 1)
    np.add.at(toxic, unit[text == 0], 1)
    model = X.Model(toxic, total, 0.2)
    label = np.array([1, 0])
    own = X.word_scores(model, units, label[words.text])
    # Seen in no other document: only the drift is left.
    assert own[2] == round(-X.DRIFT * X.UNIT) and X.word_scores(model, units)[2] > own[2]


def test_does_not_depend_on_the_batch():
    texts = [(t or "").encode() for _, t in corpus()]
    draw = np.random.default_rng(1)
    total = draw.integers(0, 5, 1 << X.BUCKET_BITS).astype(np.int32)
    model = X.Model(draw.integers(0, total + 1).astype(np.int32), total, 0.3, rate=0.01, chance=1e-3, slope=1, offset=-2)
    evidence, passages = X.judge(model, pa.array(texts, pa.binary()))
    alone = [X.judge(model, pa.array([t], pa.binary())) for t in texts]
    assert evidence.tolist() == [float(e[0]) for e, _ in alone] and passages == [p[0] for _, p in alone]
    assert any(passages)


def test_awkward_tables(spark):
    rows = corpus()
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(0, 1), (3, 0), (None, 1), (6, None), (6, 1), (6, 0), (8, 1), (999, 0)], "doc_id long, toxic int")
    found = X.toxicity_scores(docs, labels).collect()
    assert len(found) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in found)
    assert X.toxicity_scores(docs, labels.limit(0)).where("score = 0 AND size(passages) = 0").count() == len(rows)
    assert X.toxicity_scores(docs.limit(0), labels).count() == 0
    for some in (labels.where("toxic = 1"), labels.where("toxic = 0")):
        assert X.toxicity_scores(docs, some).where("score BETWEEN 0 AND 1").count() == len(rows)


def test_passages_are_found_in_place(spark):
    draw = random.Random(9)
    bag = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(300)]
    insults = ["grumbo", "grumfik", "Grumlet"]
    rows, spans = [], {}
    for i in range(1500):
        body = [draw.choice(bag) for _ in range(draw.randint(0, 120))]
        toxic = i % 8 == 0
        if toxic:
            body += ["é."] + [draw.choice(insults) for _ in range(3)] + ["."] + [draw.choice(bag) for _ in range(20)]
        text = " ".join(body)
        if toxic:
            spans[i] = (min(text.index(w) for w in insults if w in text), len(text.encode()))
        rows.append((i, text, int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    found = X.toxicity_scores(docs, labels).collect()
    assert all(bool(r.predicted) == (r.doc_id in spans) for r in found)
    texts = {i: text.encode() for i, text, _ in rows}
    for r in found:
        if r.doc_id in spans:
            assert r.passages
            for p in r.passages:
                assert b"grum" in texts[r.doc_id][p["first"] : p["after"]].lower() and p["expected"] < X.EXPECTED


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    scored = queries.op12_toxicity(spark, folder).where("held_out")
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("score", "predicted", "toxic").toPandas()
    assert rows.predicted[rows.toxic == 1].mean() > 0.9
    assert rows.predicted[rows.toxic == 0].mean() < 0.01
