import math
import random

import numpy as np
import pytest

from fleetloom.llm import queries, whitening as W


def exact(vectors, size):
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors], dtype=object).reshape(-1, size)
    n, sums = len(x), x.sum(axis=0)
    away = ((n * x - sums) / n).astype(float)
    covariance = away.T @ away / n
    deviation = [int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True))) for row in x]
    return away, covariance, deviation


def check(found, rows, size, components=8):
    """*found* against all of linear algebra done at once; rows are (vec_id, vector)."""
    ids = [i for i, _ in rows]
    away, covariance, deviation = exact([v for _, v in rows], size)
    values = np.linalg.eigvalsh(covariance)[::-1][:components]
    assert len(found) == len(rows) * len(values)
    by_id = {(r.vec_id, r.component): r for r in found}
    scale = values.max()
    whitened = np.zeros((len(rows), len(values)))
    for row, i in enumerate(ids):
        for k, value in enumerate(values):
            r = by_id[i, k + 1]
            assert r.n == len(rows) and r.deviation == deviation[row]
            assert r.explained == pytest.approx(max(value, 0) / np.trace(covariance), rel=1e-9, abs=1e-12)
            assert r.identity_error < 1e-9
            whitened[row, k] = np.nan if r.whitened is None else r.whitened
            assert (r.whitened is None) == (value <= 1e-11 * scale)
    real = values > 1e-11 * scale
    whitened = whitened[:, real]
    assert np.abs(whitened.T @ whitened / len(rows) - np.eye(real.sum())).max() < 1e-9
    # Unit eigenvectors, recovered from the places along them.
    vectors = np.linalg.lstsq(away, whitened * np.sqrt(values[real]), rcond=None)[0]
    assert np.abs(covariance @ vectors - vectors * values[real]).max() < 1e-7 * scale


def vectors(count, size, seed=0):
    draw = np.random.default_rng(seed)
    return [(i, [float(c) for c in draw.normal(size=size) * np.linspace(0.05, 1, size)]) for i in range(count)]


def frame(spark, rows, parts=3, kind="float"):
    full = [(i, v, 1, "x", "y") for i, v in rows]
    return spark.createDataFrame(full, f"vec_id long, embedding array<{kind}>, label int, n string, place string").repartition(parts)


def test_rank_one_updates_are_eigendecompositions():
    draw = np.random.default_rng(7)
    for _ in range(200):
        size = int(draw.integers(1, 9))
        values = np.sort(np.round(draw.uniform(0, 4, size) * draw.choice([1, 1e6])) * draw.choice([1, 1e-3]))
        basis = np.linalg.qr(draw.normal(size=(size, size)))[0]
        vector = np.round(draw.normal(size=size) * 3) * draw.choice([0, 1, 1e-4, 1e3])
        found, turned = W.rank_one(values, basis, vector, 0.7)
        whole = basis @ np.diag(values) @ basis.T + 0.7 * np.outer(vector, vector)
        scale = max(np.abs(whole).max(), 1e-300)
        assert np.abs(found - np.linalg.eigvalsh(whole)).max() < 1e-12 * scale
        assert np.abs(turned.T @ turned - np.eye(size)).max() < 1e-12
        assert np.abs(whole @ turned - turned * found).max() < 1e-11 * scale


def test_close_poles_and_tiny_weights():
    poles = np.array([0.0, 1.0, 1.0 + 1e-9, 2.0])
    for weights in ([1e-18, 1.0, 1e-12, 3.0], [5.0, 1e-14, 1e-14, 1e-14]):
        origin, offset = W.secular_roots(poles, np.array(weights))
        roots = poles[origin] + offset
        assert (roots >= poles).all() and (roots[:-1] <= poles[1:]).all()
        assert roots.sum() == pytest.approx(poles.sum() + sum(weights), rel=1e-13)


def test_spectra_are_combined():
    rows = np.array([v for _, v in vectors(90, 6)])
    one, two, none = W.Spectrum.empty(6), W.Spectrum.empty(6), W.Spectrum.empty(6)
    for v in rows[:30]:
        one.add(v)
    for v in rows[30:60]:
        two.add(v)
    two.add(rows[60], 30)
    one.combine(two)
    one.combine(none)
    none.combine(one)
    whole = np.r_[rows[:60], np.repeat(rows[60:61], 30, axis=0)]
    scatter = np.cov(whole.T, bias=True) * 90
    for found in (one, none):
        assert found.count == 90 and np.allclose(found.mean, whole.mean(axis=0))
        assert np.allclose(found.basis * found.values @ found.basis.T, scatter, atol=1e-9)


@pytest.mark.parametrize(("count", "size"), [(300, 12), (40, 3), (6, 10)])
def test_whole_results(spark, count, size):
    rows = vectors(count, size)
    check(W.whiten(frame(spark, rows, parts=11 if count > 100 else 3)).collect(), rows, size)


def test_awkward_rows(spark):
    good = vectors(120, 5)
    same = [(1000 + i, good[0][1]) for i in range(60)]  # one vector on a third of the rows
    bad = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 1.0, 1.0, 1.0]), (5, [float("nan")] * 5), (6, [1.0, float("-inf"), 0.0, 0.0, 0.0])]
    rows = good + same
    check(W.whiten(frame(spark, rows + [(2000 + i, v) for i, v in bad])).collect(), rows, 5)


def test_repeated_rows_and_null_ids(spark):
    rows = vectors(30, 4)
    found = W.whiten(frame(spark, [*rows, rows[0], (None, rows[1][1])]), components=3).collect()
    assert len(found) == 32 * 3 and sum(r.vec_id is None for r in found) == 3
    assert len([r for r in found if r.vec_id == 0]) == 6


def test_no_variance(spark):
    for rows in ([(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(5)]):
        found = W.whiten(frame(spark, rows)).collect()
        assert len(found) == 2 * len(rows)
        assert all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in found)
    assert W.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    assert W.whiten(frame(spark, [(1, [1.0])]).limit(0)).count() == 0


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [random.Random(i).uniform(-1, 1) * 1e12, 1.0]) for i in range(50)]
    found = W.whiten(frame(spark, rows, kind="double")).collect()
    assert len(found) == 100 and all(r.deviation is None for r in found if r.component == 1)
    near = [(0, [0.0]), (1, [2.9e6])]
    assert {r.deviation for r in W.whiten(frame(spark, near, kind="double")).collect()} == {exact([v for _, v in near], 1)[2][0]}
    far = [(0, [0.0]), (1, [1e300])]
    assert W.whiten(frame(spark, far, kind="double")).count() == 2


def test_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(queries.op13_whitening(spark, folder).collect(), rows, len(rows[0][1]))
