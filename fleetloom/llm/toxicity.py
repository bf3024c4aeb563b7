"""Toxic passages: maximum-scoring segments of token log-odds.

Every word has a log-odds of being toxic.  It is learnt from the labelled
documents that hold the word: the split into toxic and other documents has a Dirichlet prior
whose mean is the split of the word's prefix, whose prior is the split of a shorter prefix,
and so on up to the split of all documents.  A rare word is thus judged by its stem.
Scores, less a constant drift, are rounded to integers, so that sums do not depend on
how texts are batched.

A linear scan finds all maximal scoring segments of a document.  The best segments of clean
documents follow an extreme-value law, whose two parameters are fitted; it turns a
segment's score and the document's length into the number of such segments expected
by chance.  Segments expected less than ``EXPECTED`` times are passages; the joint tail
probability of the passages of a document, calibrated by a logistic curve, is its score.

Labels are used for learning only, from a bounded sample; what a document's words score while the law and
the curve are fitted leaves out the document itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetloom.llm import text as T
from fleetloom.llm.quality import id_remainder
from fleetloom.llm.shared import stored

#: At most so many labelled documents are learnt from, those with the least hash of their ID.
SAMPLE_ROWS = 32768
#: Words and prefixes are counted in this many buckets (a power of two).
BUCKET_BITS = 21
#: Bytes of the prefixes that a word's prior is taken from, shortest first.
PREFIXES = (3, 4, 5, 6)
#: Weight of a prior, in documents.
STRENGTH = 3.0
#: Score units in one unit of log-odds, and what each word loses.
UNIT = 64
DRIFT = 2.5
#: Segments expected less often than this in a clean document are passages.
EXPECTED = 0.05
THRESHOLD = 0.3
#: Evidence beyond this makes no difference to a score.
MOST_EVIDENCE = 60.0


@dataclass
class Model:
    """What tasks need to score texts; its size is bounded by ``BUCKET_BITS``."""

    toxic: np.ndarray  # toxic documents by bucket
    total: np.ndarray  # labelled documents by bucket
    base: float  # share of toxic documents
    rate: float = 1.0  # of the extreme-value law, by score unit
    chance: float = 1.0  # of a segment of score 0, by word
    slope: float = 0.0  # of the curve from evidence to score
    offset: float = 0.0

    def parts(self) -> tuple:
        """The fields, as plain values that any worker can read."""
        return self.toxic, self.total, self.base, self.rate, self.chance, self.slope, self.offset


def word_units(texts: pa.Array, bits: int = BUCKET_BITS) -> tuple[T.Spans, np.ndarray]:
    """The words of each text and, level by level, the bucket of each word's prefixes and of itself.

    Words are runs of letters, digits and bytes beyond ASCII, with A to Z lower-cased.
    """
    letters = np.zeros(256, bool)
    letters[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    words = T.words(texts, ~letters, T.lower_table())
    found = np.empty((len(PREFIXES) + 1, len(words.starts)), np.int32)
    for level, size in enumerate((*PREFIXES, None)):
        lengths = words.lengths if size is None else np.minimum(words.lengths, size)
        part = T.Spans(words.data, words.bounds, words.starts, lengths, words.text)
        hashed = T.scramble(T.hashes(part, 0) + np.uint64(level), 0)
        found[level] = (hashed >> np.uint64(64 - bits)).astype(np.int32)
    return words, found


def held_units(text: np.ndarray, units: np.ndarray, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each distinct pair of the two."""
    pairs, _ = T.distinct(((text.astype(np.int64) << bits) | units).ravel())
    return pairs >> bits, (pairs & ((1 << bits) - 1)).astype(np.int32)


def word_scores(model: Model, units: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Integer score of each word.

    *own* is the label of the document of each word, if that document was counted; it
    is then taken out of the counts again.
    """
    share = np.full(units.shape[1], model.base)
    for level in units:
        toxic, total = model.toxic[level].astype(np.float64), model.total[level].astype(np.float64)
        if own is not None:
            toxic, total = toxic - own, total - 1.0
        share = (toxic + STRENGTH * share) / (total + STRENGTH)
    odds = np.log(share / (1.0 - share)) - np.log(model.base / (1.0 - model.base))
    return np.rint(UNIT * (odds - DRIFT)).astype(np.int64)


def best_segment(text: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
    """Greatest sum of consecutive scores in each of *count* texts, 0 if none is positive."""
    best = np.zeros(count, np.int64)
    if not len(scores):
        return best
    sums = np.cumsum(scores)
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    before = np.r_[0, sums[:-1]]
    # Each text is lowered by more than any sum can span, so that its minimum begins anew.
    step = int(sums.max()) - min(int(sums.min()), 0) + 1
    rank = np.cumsum(np.r_[False, text[1:] != text[:-1]])
    lowest = np.minimum.accumulate(before - rank * step) + rank * step
    best[text[first]] = np.maximum(np.maximum.reduceat(sums - lowest, first), 0)
    return best


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, int]]:
    """All maximal scoring segments, as (first, after last, score), in order.

    One pass over the runs of positive and of other scores.  A list holds segments found so far with
    the running sums at both ends; a new run is appended, or swallows the segments back to the
    last one that began at a lower sum and ended at a lower one.
    """
    if not len(scores):
        return []
    edges = np.flatnonzero(np.r_[True, (scores[1:] > 0) != (scores[:-1] > 0)])
    sums = np.add.reduceat(scores, edges).tolist()
    ends = [*edges[1:].tolist(), len(scores)]
    kept: list[tuple[int, int, int, int, int]] = []  # first, after last, sum before, sum after, last lower one
    level = 0
    for first, after, total in zip(edges.tolist(), ends, sums, strict=True):
        low, level = level, level + total
        if total <= 0:
            continue
        high = level
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append((first, after, low, high, j))
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(first, after, high - low) for first, after, low, high, _ in kept]


def joint_evidence(model: Model, words: int, segments: list[int]) -> float:
    """Minus the logarithm of the joint tail probability of the best of these segment scores.

    The sum of r normalised scores, x, is reached by chance with about exp(-x) x^(r-1) / (r! (r-1)!).
    """
    found, total = 0.0, 0.0
    for r, score in enumerate(sorted(segments, reverse=True), 1):
        part = model.rate * score - np.log(model.chance * words)
        if r == 1:
            found = part if part > 30 else -np.log(-np.expm1(-np.exp(-max(part, -5.0))))
        total += part
        if part <= 0 or total >= 2 * MOST_EVIDENCE:
            found = max(found, total - (r - 1) * np.log(total) + lgamma(r + 1) + lgamma(r)) if total > r > 1 else found
            break
        if r > 1 and total > r:
            found = max(found, total - (r - 1) * np.log(total) + lgamma(r + 1) + lgamma(r))
    return float(min(max(found, 0.0), MOST_EVIDENCE))


def judge(model: Model, texts: pa.Array, own: np.ndarray | None = None) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Evidence of each text, and its passages as (first byte, after last byte, times expected by chance)."""
    words, units = word_units(texts)
    scores = word_scores(model, units, None if own is None else own[words.text])
    count = len(texts)
    best, lengths = best_segment(words.text, scores, count), words.per_text
    evidence = np.zeros(count)
    passages: list[list[tuple[int, int, float]]] = [[] for _ in range(count)]
    bounds = np.r_[0, np.cumsum(lengths)]
    for i in np.flatnonzero(best > 0):
        size = int(lengths[i])
        if model.rate * best[i] <= np.log(model.chance * size / EXPECTED):
            evidence[i] = joint_evidence(model, size, [int(best[i])])
            continue
        at = int(bounds[i])
        found = maximal_segments(scores[at : at + size])
        evidence[i] = joint_evidence(model, size, [score for _, _, score in found])
        for first, after, score in found:
            expected = model.chance * size * float(np.exp(-model.rate * score))
            if expected < EXPECTED:
                begin, end = words.starts[at + first], words.starts[at + after - 1] + words.lengths[at + after - 1]
                passages[i].append((int(begin - words.bounds[i]), int(end - words.bounds[i]), expected))
    return evidence, passages


def fit_law(best: np.ndarray, words: np.ndarray) -> tuple[float, float]:
    """Rate and chance of the extreme-value law of best segments of *words* words by chance.

    Most likely values; a best score of 0 says only that no segment is positive.
    """
    some = best > 0
    if not some.any() or not words.sum():
        return 1.0 / UNIT, 1e-6
    scale, weight = best / UNIT, words.astype(np.float64)

    def slope(rate: float) -> float:
        tail = weight * np.exp(-rate * scale)
        return some.sum() / rate - scale.sum() + some.sum() * (tail * scale).sum() / tail.sum()

    low, high = 1e-3, 50.0
    for _ in range(80):
        middle = (low * high) ** 0.5
        low, high = (middle, high) if slope(middle) > 0 else (low, middle)
    return low / UNIT, float(some.sum() / (weight * np.exp(-low * scale)).sum())


def fit_curve(evidence: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of *label* over *evidence*, by Newton steps with a slight pull to zero."""
    x = np.stack([evidence, np.ones(len(evidence))], 1)
    found = np.zeros(2)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ found, -35.0, 35.0)))
        pull = np.array([1e-3, 1e-3])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (label - p) - pull * found)
        found += np.clip(step, -2.0, 2.0)
        if np.abs(step).max() < 1e-9:
            break
    return float(found[0]), float(found[1])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Model learnt from ``labels(doc_id, toxic)`` outside the held-out fold; None without labelled rows.

    Rows with a null ID or label teach nothing; an ID with several labels counts as its
    highest, an ID with several rows as the one with the least text hash.  The sample's texts
    stay in Spark; the driver gets counts by bucket and three numbers a sampled row.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.where(id_remainder(F.col("doc_id"), 4) != 2)
    chosen = known.groupBy("doc_id").agg((F.max("toxic") == 1).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("body"), F.xxhash64("text").alias("text_hash"))
    rows = texts.join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("body", F.struct("text_hash", "body")).alias("body"))
    sample = stored(rows.select("label", "body"), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BUCKET_BITS), np.int32)
        for batch in batches:
            for piece in T.pieces(batch, "body"):
                words, units = word_units(piece.column("body"))
                text, unit = held_units(np.broadcast_to(words.text, units.shape), units)
                label = piece.column("label").to_numpy(zero_copy_only=False)
                sums[0] += np.bincount(unit[label[text] == 1], minlength=1 << BUCKET_BITS).astype(np.int32)
                sums[1] += np.bincount(unit, minlength=1 << BUCKET_BITS).astype(np.int32)
        some = np.flatnonzero(sums[1])
        columns = [pa.array(some, pa.int32()), pa.array(sums[0, some], pa.int32()), pa.array(sums[1, some], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["unit", "toxic", "total"])

    split = sample.agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("toxic")).first()
    if not split["rows"]:
        return None
    counted = sample.mapInArrow(count, "unit int, toxic int, total int").groupBy("unit")
    found = counted.agg(F.sum("toxic").cast("int").alias("toxic"), F.sum("total").cast("int").alias("total")).toArrow()
    toxic, total = np.zeros(1 << BUCKET_BITS, np.int32), np.zeros(1 << BUCKET_BITS, np.int32)
    toxic[found["unit"].to_numpy()] = found["toxic"].to_numpy()
    total[found["unit"].to_numpy()] = found["total"].to_numpy()
    model = Model(toxic, total, (split["toxic"] + 1.0) / (split["rows"] + 4.0))

    def over(kind: str, shared) -> pa.Table:
        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            learnt = Model(*shared.value)
            for batch in batches:
                for piece in T.pieces(batch, "body"):
                    label = piece.column("label").to_numpy(zero_copy_only=False)
                    body = piece.column("body")
                    if kind == "best":
                        words, units = word_units(body)
                        scores = word_scores(learnt, units, label[words.text])
                        value, size = best_segment(words.text, scores, len(label)), words.per_text
                    else:
                        value, size = judge(learnt, body, label)[0], np.zeros(len(label), np.int64)
                    columns = [pa.array(label, pa.int32()), pa.array(value.astype(np.float64)), pa.array(size.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["label", "value", "size"])

        return sample.mapInArrow(measure, "label int, value double, size bigint").toArrow()

    context = docs.sparkSession.sparkContext
    seen = over("best", context.broadcast(model.parts()))
    clean = seen["label"].to_numpy() == 0
    model.rate, model.chance = fit_law(seen["value"].to_numpy()[clean], seen["size"].to_numpy()[clean])
    seen = over("evidence", context.broadcast(model.parts()))
    model.slope, model.offset = fit_curve(seen["value"].to_numpy(), seen["label"].to_numpy())
    return model


def find_passages(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``score`` and ``passages`` of every row of *docs*, from its text alone.

    A passage is given by its first byte, the byte after its last one and the number of such segments expected in a
    clean document of that length.  A null text is scored as the empty one.  Without a model
    every score is 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model and model.parts())
    marked = docs.select("doc_id", F.col("text").cast("binary").alias("body"))
    kind = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64()), ("expected", pa.float64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = shared.value and Model(*shared.value)
        for batch in batches:
            for piece in T.pieces(batch, "body"):
                if learnt is None:
                    score, passages = np.zeros(piece.num_rows), [[]] * piece.num_rows
                else:
                    evidence, passages = judge(learnt, piece.column("body"))
                    score = 1.0 / (1.0 + np.exp(-np.clip(learnt.slope * evidence + learnt.offset, -35.0, 35.0)))
                spans = [[{"first": a, "after": b, "expected": e} for a, b, e in found] for found in passages]
                columns = [piece.column("doc_id"), pa.array(score), pa.array(spans, kind)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "passages"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<first: bigint, after: bigint, expected: double>>"
    return marked.mapInArrow(apply, f"doc_id {id_type}, score double, passages {spans}")


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` and ``passages`` of every row of *docs*."""
    found = find_passages(docs, train(docs, labels))
    return found.select(
        "doc_id",
        (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "passages",
    )
