"""Quality classifier: logistic regression over hashed word n-grams.

Features are words, runs of symbols, word pairs and one feature for a word that
follows itself; each is hashed into a bounded number of buckets.  Weights are
learnt by follow-the-regularised-leader updates on a bounded sample of labelled
rows; a score is the sparse dot product of a text's features with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetloom.llm import text as T

BUCKET_BITS = 18
#: At most so many labelled rows are learnt from, those with the least hash of their ID.
SAMPLE_ROWS = 8192
EPOCHS = 4
THRESHOLD = 0.7


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """CRC-32 of the ID as text modulo *divisor*; a null ID counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def features(texts: pa.Array, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, bucket and value of each feature; values of a text have length one.

    Every text, empty ones too, has a feature for the intercept in bucket 0.
    """
    letters = np.zeros(256, bool)
    letters[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    mark = np.uint64(1)
    spans = T.words(texts, ~letters)
    word = T.hashes(spans, 0)
    symbols = T.words(texts, letters | T.white_space())
    pair = T.runs(word, 2, 1)
    together = spans.text[1:] == spans.text[:-1]
    again = np.where(word[1:] == word[:-1], mark, pair)
    count = len(texts)
    text = np.concatenate([spans.text, symbols.text, spans.text[1:][together]])
    hashed = np.concatenate([word, T.hashes(symbols, 1), again[together] if len(pair) else pair])
    bucket = (T.scramble(hashed, 0) >> np.uint64(64 - bits)).astype(np.int64)
    found, times = T.distinct((text.astype(np.int64) << bits) | bucket)
    text, bucket = found >> bits, found & ((1 << bits) - 1)
    value = 1.0 + np.log(times)
    norm = np.sqrt(np.bincount(text, value * value, count))
    value = value / norm[text]
    return (
        np.concatenate([text, np.arange(count)]),
        np.concatenate([bucket, np.zeros(count, np.int64)]),
        np.concatenate([value, np.full(count, 0.5)]),
    )


def follow_leader(
    rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int, epochs: int,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0, l2: float = 0.01,
) -> np.ndarray:
    """Weights after *epochs* passes of per-coordinate updates over (label, buckets, values)."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(at) -> np.ndarray:
        pull = np.sign(z[at]) * l1 - z[at]
        return np.where(np.abs(z[at]) <= l1, 0.0, pull / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for label, at, value in rows:
            w = weights(at)
            score = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -35.0, 35.0)))
            gradient = (score - label) * value
            sigma = (np.sqrt(n[at] + gradient * gradient) - np.sqrt(n[at])) / alpha
            z[at] += gradient - sigma * w
            n[at] += gradient * gradient
    return weights(slice(None))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights learnt from ``labels(doc_id, quality)`` outside the held-out fold.

    Rows with a null ID or label teach nothing; an ID with several labels counts
    as its highest, an ID on several rows as the one with the least text hash.  Without any label all weights are zero.  Only the sample's
    features meet in one task, and only the weights reach the driver; both are bounded
    by *sample_rows* and ``BUCKET_BITS``.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.where(id_remainder(F.col("doc_id"), 4) != 2)
    sample = known.groupBy("doc_id").agg(F.max("quality").alias("label"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    marked = docs.select("doc_id", F.col("text").cast("binary").alias("body"), F.xxhash64("text").alias("text_hash"))
    rows = marked.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label")
    texts = rows.agg(F.min_by("body", F.struct("text_hash", "body")).alias("body"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch, "body"):
                text, bucket, value = features(piece.column("body"))
                order = np.argsort(text, kind="stable")
                ends = np.cumsum(np.bincount(text, minlength=piece.num_rows))
                bounds = pa.array(np.r_[0, ends], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        piece.column("label"),
                        pa.ListArray.from_arrays(bounds, pa.array(bucket[order], pa.int32())),
                        pa.ListArray.from_arrays(bounds, pa.array(value[order], pa.float32())),
                    ],
                    ["doc_id", "label", "buckets", "values"],
                )

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [row for frame in frames for row in zip(frame["label"], frame["buckets"], frame["values"], strict=True)]
        found = follow_leader(rows, BUCKET_BITS, epochs)
        yield pd.DataFrame({"weights": [found.astype(np.float32).tobytes()]})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    extracted = texts.mapInArrow(extract, f"doc_id {id_type}, label int, buckets array<int>, values array<float>")
    ordered = extracted.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", F.xxhash64("buckets"))
    row = ordered.mapInPandas(learn, "weights binary").first()
    if row is None:
        return np.zeros(1 << BUCKET_BITS, np.float32)
    return np.frombuffer(row["weights"], np.float32)


def score(docs: DataFrame, weights: np.ndarray, out: str = "score") -> DataFrame:
    """``doc_id``, text hash and score of each row, from its text alone.

    A null text is scored as the empty one, by the intercept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float32))
    marked = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("body"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = shared.value.astype(np.float64)
        for batch in batches:
            for piece in T.pieces(batch, "body"):
                text, bucket, value = features(piece.column("body"))
                total = np.bincount(text, value * learnt[bucket], piece.num_rows)
                found = pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35.0, 35.0))), pa.float64())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_hash"), found], ["doc_id", "text_hash", out])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(apply, f"doc_id {id_type}, text_hash bigint, {out} double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row of *docs*."""
    scored = score(docs, train(docs, labels))
    return scored.select(
        "doc_id",
        (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of *docs*, with all their columns, whose text scores *threshold* or more."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("double")
    def score_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        learnt = weights.value.astype(np.float64)
        for series in batches:
            batch = pa.RecordBatch.from_arrays([pa.array(series, pa.binary())], ["body"])
            parts = []
            for piece in T.pieces(batch, "body"):
                text, bucket, value = features(piece.column("body"))
                parts.append(np.bincount(text, value * learnt[bucket], piece.num_rows))
            total = np.concatenate(parts) if parts else np.zeros(0)
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(total, -35.0, 35.0))))

    return docs.where(score_of(F.col("text").cast("binary")) >= threshold)
