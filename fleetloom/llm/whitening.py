"""Whitening of embeddings by an eigendecomposition that grows vector by vector.

Each partition keeps the spectrum of what it has seen: count, mean, eigenvalues and
eigenvectors of the scatter matrix.  A vector changes it by a centred rank-one update, whose
eigenvalues are the roots of a secular equation; components without a part in
the update, and all but one of equal eigenvalues, are deflated first.  Spectra of
partitions are combined in a tree, again by rank-one updates, one per eigenpair of the other and one for the distance
of the means.  The basis found is refined by one distributed Rayleigh-Ritz step:
the covariance, projected on the basis, is summed over all rows and diagonalised.

Entries c become integers floor(1024 c) + 100000, so that count, sums and deviations are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetloom.llm.shared import stored
from fleetloom.session import spread

COMPONENTS = 8
#: Spectra that one task combines at a time.
FAN_IN = 8
#: Whole numbers beyond this are set to it; no real embedding comes near.
LARGEST = 1 << 53
#: Eigenvalues below this share of the greatest one count as zero.
NOTHING = 1e-12
_EPS = float(np.finfo(float).eps)


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(weights / (poles - root)) = 0, as (nearest pole, offset from it).

    Poles ascend and differ, weights are positive.  Root j lies between pole j and the next one, the last
    one less than the sum of the weights beyond the last pole.  Each is measured from its
    nearer pole, and found by fitting both sides of the sum with one pole each, within a bracket.
    """
    size = len(poles)
    if size == 1:
        return np.zeros(1, int), weights
    gaps = np.diff(poles, append=poles[-1] + weights.sum())
    to_left = poles[:, None] - poles
    middle = gaps / 2
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        value = 1 + (weights[:, None] / (to_left - middle)).sum(axis=0)
    upper = (value < 0) & (np.arange(size) < size - 1)
    origin = np.arange(size) + upper
    # Bracket and start, measured from the origin.
    low = np.where(upper, -middle, 0.0)
    high = np.where(upper, 0.0, middle)
    last = size - 1
    low[last], high[last] = (middle[last], gaps[last]) if value[last] < 0 else (0.0, middle[last])
    from_origin = poles[:, None] - poles[origin]
    left = np.tri(size).T  # 1 where a pole is at or left of the interval
    here, after = -gaps * upper, gaps * ~upper
    after[last] = np.inf
    root = (low + high) / 2
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for _ in range(100):
            apart = from_origin - root
            share = weights[:, None] / apart
            both, below = share.sum(axis=0), np.einsum("ij,ij->j", share, left)
            value, above = 1 + both, both - below
            done = np.abs(value) <= 4 * _EPS * size * (1 + np.abs(below) + above)
            done |= high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high))
            if done.all():
                break
            low, high = np.where(value < 0, root, low), np.where(value < 0, high, root)
            # below ~ a + b / (here - root), above ~ c + e / (after - root)
            rise = share / apart
            slope_below = np.einsum("ij,ij->j", rise, left)
            slope_above = rise.sum(axis=0) - slope_below
            to_here, to_after = here - root, np.where(np.isinf(after), 0.0, after - root)
            b, e = slope_below * to_here**2, slope_above * to_after**2
            flat = 1 + below - slope_below * to_here + above - slope_above * to_after
            # flat + b / (to_here - step) + e / (to_after - step) = 0
            linear = -(flat * (to_here + to_after) + b + e)
            rest = flat * to_here * to_after + b * to_after + e * to_here
            spare = np.sqrt(np.maximum(linear**2 - 4 * flat * rest, 0.0))
            step = np.where(linear <= 0, 2 * rest / (-linear + spare), (-linear - spare) / (2 * flat))
            step[last] = to_here[last] + b[last] / flat[last]
            next_root = root + step
            inside = (next_root > low) & (next_root < high)
            root = np.where(done, root, np.where(inside, next_root, (low + high) / 2))
    return origin, root


def rank_one(values: np.ndarray, basis: np.ndarray, vector: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and eigenvectors of basis diag(values) basis' + weight vector vector'.

    *values* ascend, *weight* is not negative.
    """
    along = basis.T @ vector
    total = weight * float(along @ along)
    if not total > 0:
        return values, basis
    limit = 8 * _EPS * max(float(np.abs(values).max()), total)
    # One of each group of equal values takes the whole part of its group.
    edges = np.flatnonzero(np.r_[True, np.diff(values) > limit, True])
    if len(edges) <= len(values):
        basis, along = basis.copy(), along.copy()
        for first, after in zip(edges[:-1], edges[1:], strict=True):
            part = along[first:after]
            length = float(np.sqrt(part @ part))
            if after - first == 1 or length == 0.0:
                continue
            length = float(np.copysign(length, part[-1]))
            mirror = part.copy()
            mirror[-1] += length
            mirror /= np.sqrt(mirror @ mirror)
            block = basis[:, first:after]
            basis[:, first:after] = block - 2 * np.outer(block @ mirror, mirror)
            along[first:after] = 0.0
            along[after - 1] = -length
    active = weight * along**2 > limit * _EPS
    active &= np.sqrt(weight) * np.abs(along) > np.sqrt(limit) * _EPS
    if not active.any():
        return values, basis
    poles, part = values[active], along[active]
    origin, root = secular_roots(poles, weight * part**2)
    found = poles[origin] + root
    # The part that has exactly these roots makes the vectors orthogonal.
    beyond = (poles[origin] - poles[:, None]) + root  # root j less pole i
    apart = poles - poles[:, None]
    np.fill_diagonal(apart, 1.0)
    ratio = beyond / apart
    exact = np.copysign(np.sqrt(np.maximum(ratio.prod(axis=1), 0.0)), part)
    vectors = exact[:, None] / -beyond
    vectors /= np.sqrt((vectors**2).sum(axis=0))
    values, basis = values.copy(), basis.copy()
    values[active] = found
    basis[:, active] = basis[:, active] @ vectors
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


@dataclass
class Spectrum:
    """Count, mean, and eigenvalues and eigenvectors of the scatter matrix of some vectors."""

    count: int
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @staticmethod
    def empty(size: int) -> Spectrum:
        return Spectrum(0, np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, vector: np.ndarray, times: int = 1) -> None:
        """Take in a vector that occurs *times* times."""
        away, count = vector - self.mean, self.count + times
        if self.count:
            self.values, self.basis = rank_one(self.values, self.basis, away, self.count * times / count)
        self.mean = self.mean + away * (times / count)
        self.count = count

    def combine(self, other: Spectrum) -> None:
        """Take in all vectors of another spectrum."""
        if not other.count:
            return
        away, count = other.mean - self.mean, self.count + other.count
        for value, vector in zip(other.values, other.basis.T, strict=True):
            if value > 0:
                self.values, self.basis = rank_one(self.values, self.basis, vector, float(value))
        if self.count:
            self.values, self.basis = rank_one(self.values, self.basis, away, self.count * other.count / count)
        self.mean = self.mean + away * (other.count / count)
        self.count = count

    def row(self, place: int) -> dict:
        parts = {"mean": self.mean, "spectrum": self.values, "basis": self.basis}
        return {"place": place, "count": self.count} | {k: np.ascontiguousarray(v).tobytes() for k, v in parts.items()}

    @staticmethod
    def of(row) -> Spectrum:
        mean, values, basis = (np.frombuffer(row[k]) for k in ("mean", "spectrum", "basis"))
        return Spectrum(int(row["count"]), mean, values, basis.reshape(len(mean), len(mean)))


SPECTRUM = "place bigint, count bigint, mean binary, spectrum binary, basis binary"


@dataclass
class Whitening:
    """Exact count and sums of the vectors, principal components and their eigenvalues, greatest first."""

    count: int
    sums: list[int]
    components: np.ndarray  # one column each
    values: np.ndarray
    trace: float
    identity_error: float | None = None


def whole_numbers(vectors: pa.Array, size: int) -> np.ndarray:
    """Rows of integers floor(1024 c) + 100000."""
    entries = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return np.clip(np.floor(entries * 1024.0), -LARGEST, LARGEST).astype(np.int64) + 100000


def centred(rows: np.ndarray, count: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row less the mean: nearest integers to the mean, what is left of the sums, rows less those integers."""
    near = [(2 * s + count) // (2 * count) for s in sums]
    rest = [s - count * m for s, m in zip(sums, near, strict=True)]
    return rows - np.array(near, np.int64), np.array(rest, np.int64), np.array(near, np.int64)


def deviations(rows: np.ndarray, count: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (count x - sum)^2, exact; None beyond the range of a long."""
    away, rest, _ = centred(rows, count, sums)
    if not rows.size:
        return []
    rough = ((away.astype(np.float64) * count - rest) ** 2).sum(axis=1)
    small = rough < 2.0**62
    found: list[int | None] = [None] * len(rows)
    squares = ((away[small] * count - rest) ** 2).sum(axis=1)
    for row, value in zip(np.flatnonzero(small), squares.tolist(), strict=True):
        found[row] = value
    for row in np.flatnonzero(~small & (rough < 2.0**64)):
        exact = sum((int(a) * count - int(r)) ** 2 for a, r in zip(away[row], rest, strict=True))
        found[row] = exact if exact < 1 << 63 else None
    return found


def usable(embeddings: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """Rows whose vector has only finite entries and the most frequent length (of several, the greatest), and that length.

    Null vectors and empty ones are left out.
    """
    entries = F.col(vector).cast("array<double>")
    real = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = embeddings.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & real)
    lengths = kept.groupBy(F.size(vector).alias("length")).agg(F.count(F.lit(1)).alias("rows"))
    row = lengths.orderBy(F.desc("rows"), F.desc("length")).first()
    if row is None:
        return kept, 0
    return kept.where(F.size(vector) == row["length"]), row["length"]


def exact_sums(rows: DataFrame, size: int, vector: str) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            whole = whole_numbers(batch.column(0), size)
            count += len(whole)
            high += (whole >> 27).sum(axis=0)
            low += (whole & ((1 << 27) - 1)).sum(axis=0)
        columns = [np.arange(size), np.full(size, count), high, low]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["dim", "n", "high", "low"])

    parts = rows.select(vector).mapInArrow(add, "dim bigint, n bigint, high bigint, low bigint")
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    by_dim = {row["dim"]: row for row in found.collect()}
    if not by_dim:
        return 0, [0] * size
    return by_dim[0]["n"], [(by_dim[i]["high"] << 27) + by_dim[i]["low"] for i in range(size)]


def spectrum(rows: DataFrame, count: int, sums: list[int], vector: str) -> Spectrum:
    """Spectrum of all rows, less their mean: one of each partition, combined in a tree."""
    size = len(sums)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = Spectrum.empty(size)
        for batch in batches:
            whole = whole_numbers(batch.column(0), size)
            for start in range(0, len(whole), 4096):
                distinct, times = np.unique(whole[start : start + 4096], axis=0, return_counts=True)
                away, rest, _ = centred(distinct, count, sums)
                for row, n in zip(away - rest / count, times.tolist(), strict=True):
                    found.add(row, n)
        if found.count:
            yield pa.RecordBatch.from_pylist([found.row(TaskContext.get().partitionId())], _arrow(SPECTRUM))

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = [Spectrum.of(row) for row in frame.sort_values("place").to_dict("records")]
        for other in ordered[1:]:
            ordered[0].combine(other)
        return pd.DataFrame([ordered[0].row(int(frame["place"].min()) // FAN_IN)])

    spread_rows = spread(rows.select(vector))
    found = stored(spread_rows.mapInArrow(grow, SPECTRUM), "spectra")
    while found.count() > 1:
        found = stored(found.groupBy(F.expr(f"place div {FAN_IN}")).applyInPandas(merge, SPECTRUM), "spectra")
    return Spectrum.of(found.first())


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split(" ") for field in schema.split(", "))])


def products(rows: DataFrame, count: int, sums: list[int], matrix: np.ndarray, vector: str) -> np.ndarray:
    """Mean over all rows of the products of the centred vector's places along the columns of *matrix*."""
    size, width = matrix.shape
    shared = rows.sparkSession.sparkContext.broadcast(matrix)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            whole = whole_numbers(batch.column(0), size)
            away, rest, _ = centred(whole, count, sums)
            places = (away - rest / count) @ shared.value
            total += places.T @ places
        cells = pa.array(np.arange(width * width), pa.int32())
        yield pa.RecordBatch.from_arrays([cells, pa.array(total.ravel())], ["cell", "total"])

    parts = rows.select(vector).mapInArrow(add, "cell int, total double")
    found = parts.groupBy("cell").agg(F.sum("total").alias("total")).toPandas()
    mean = np.zeros(width * width)
    mean[found["cell"].to_numpy()] = found["total"].to_numpy() / count
    return mean.reshape(width, width)


def fit(rows: DataFrame, size: int, components: int = COMPONENTS, vector: str = "embedding") -> Whitening | None:
    """Whitening learnt from all *rows*, which have vectors of *size* finite entries; None without rows."""
    count, sums = exact_sums(rows, size, vector) if size else (0, [])
    if not count:
        return None
    basis = np.linalg.qr(spectrum(rows, count, sums, vector).basis[:, ::-1])[0]
    projected = products(rows, count, sums, basis, vector)
    values, turns = np.linalg.eigh((projected + projected.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    found = Whitening(count, sums, basis @ turns[:, order], np.maximum(values[order], 0.0), float(values.sum()))
    real = found.values > NOTHING * max(found.values[0], 0.0)
    if real.any():
        scaled = found.components[:, real] / np.sqrt(found.values[real])
        found.identity_error = float(np.abs(products(rows, count, sums, scaled, vector) - np.eye(real.sum())).max())
    return found


def whiten(embeddings: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector and principal component, greatest eigenvalue first.

    ``whitened`` is the place along the component in standard deviations; ``explained`` the share of
    the variance, ``identity_error`` how far the covariance of the whitened vectors is from the
    identity at most.  Components without variance have a null ``whitened`` and do not count for the error; a
    single vector, or equal ones, have no variance at all and a null ``explained``.
    Rows of equal ID are kept apart.  Without usable rows the result is empty.
    """
    rows, size = usable(embeddings, vector)
    model = fit(rows, size, components, vector)
    id_type = embeddings.schema[vec_id].dataType.simpleString()
    schema = f"{vec_id} {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    width = len(model.values)
    real = model.values > NOTHING * max(model.values[0], 0.0)
    scale = np.where(real, np.sqrt(np.where(real, model.values, 1.0)), np.nan)
    explained = model.values / model.trace if model.trace > 0 and real.any() else np.full(width, np.nan)
    shared = embeddings.sparkSession.sparkContext.broadcast((model.components / scale, explained))
    count, sums, error = model.count, model.sums, model.identity_error

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, part = shared.value
        for batch in batches:
            whole = whole_numbers(batch.column(1), size)
            away, rest, _ = centred(whole, count, sums)
            places = (away - rest / count) @ matrix
            each, total = len(whole), len(whole) * width
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(each), width))),
                pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), each)),
                pa.array(np.full(total, count, np.int64)),
                pa.array(deviations(whole, count, sums), pa.int64()).take(pa.array(np.repeat(np.arange(each), width))),
                pa.array(places.ravel(), from_pandas=True),
                pa.array(np.tile(part, each), from_pandas=True),
                pa.array([error] * total, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [vec_id, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(vec_id, vector).mapInArrow(apply, schema)
