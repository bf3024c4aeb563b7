"""Token counts of whole documents, with huge ones encoded as overlapping chunks.

A document longer than a chunk is cut into chunks that share an overlap, so that
its parts are encoded by different tasks.  Neighbours are spliced where both
encodings have a token border at the same *stable* place of the overlap: before a
space that follows another character.  No piece of the vocabulary holds a space
mark behind another character (this is verified on the vocabulary), so no merge
can cross such a place and both sides are encoded as in the whole text.  A
document with an overlap that has no such place, or on which the encodings
disagree, is tried again with a wider overlap, at last as one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetloom.llm.shared import stored

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 256
_SPACE_MARK = "▁"
_PROCESSORS: dict[str, object] = {}


def _processor(path: str):
    if path not in _PROCESSORS:
        import sentencepiece

        _PROCESSORS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _PROCESSORS[path]


def stable_spaces(processor) -> bool:
    """Whether no piece crosses from another character into a space."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    return not any(_SPACE_MARK in piece.lstrip(_SPACE_MARK) for piece in pieces)


def splice_place(text: str, start: int, stop: int) -> int:
    """First stable place in ``text[start:stop]``, or -1.

    The characters around it are plain ASCII, so normalising the text joins or
    moves nothing there.
    """
    place = text.find(" ", start + 1, stop)
    while place >= 0:
        before = text[place - 1]
        after = text[place + 1 : place + 2]
        if before.isascii() and before.isalnum() and after.isascii() and after.isalnum():
            return place
        place = text.find(" ", place + 1, stop)
    return -1


def cut(text: str, chunk: int, overlap: int) -> list[tuple[str, int, int]] | None:
    """Chunks as (text, from, to): the tokens of places from..to count; None if a splice fails."""
    if len(text) <= chunk:
        return [(text, 0, len(text))]
    found, begin, left = [], 0, 0
    while begin + chunk < len(text):
        end = begin + chunk
        place = splice_place(text, end - overlap // 2, end - overlap // 4)
        if place < 0:
            return None
        found.append((text[begin:end], left - begin, place - begin))
        begin, left = end - overlap, place
    found.append((text[begin:], left - begin, len(text) - begin))
    return found


def count_span(processor, text: str, start: int, stop: int) -> int:
    """Tokens of ``text`` in the span, or -1 if a token crosses one of its ends."""
    if start == 0 and stop == len(text):
        return len(processor.encode(text, num_threads=1))
    count, borders = 0, {0, len(text)}
    for begin, end in processor.encode(text, return_type="offset_mapping")["offsets"]:
        borders |= {begin, end}
        count += start <= begin < stop
    return count if start in borders and stop in borders else -1


def count_tokens(
    docs: DataFrame,
    model: str = "piece_bpe_32k.model",
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` of each row, as the library encodes the whole text.

    Null and empty texts have no bytes and no tokens.  Rows that repeat an ID stay
    apart; a null ID is a result row like any other.  Other columns are not read.
    *model* is the name of a vocabulary file, found on each executor.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long").alias("n_bytes")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        processor = _processor(public_tokenizers.path(model))
        for batch in batches:
            texts, counts = batch.column("text").to_pylist(), []
            for first in range(0, len(texts), 64):
                counts += map(len, processor.encode(texts[first : first + 64], num_threads=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {id_type}, n_bytes bigint, n_tokens bigint"
    short = rows.where(F.length("text") <= chunk_chars).select("doc_id", size, "text").mapInArrow(whole, result)
    todo = rows.where(F.length("text") > chunk_chars).select("doc_id", size, "text", F.xxhash64("text").alias("key"))
    return short.unionByName(_huge(todo, model, chunk_chars, overlap_chars))


def _huge(todo: DataFrame, model: str, chunk: int, overlap: int) -> DataFrame:
    """Counts of documents longer than a chunk; equal rows are encoded once."""
    todo = todo.groupBy("doc_id", "key", "n_bytes", "text").agg(F.count("*").alias("times"))
    todo = stored(todo, "huge-texts")
    done = None
    while done is None or not todo.isEmpty():
        counted = stored(_spliced(todo, model, chunk, overlap), "spliced")
        good = counted.where("n_tokens >= 0")
        done = good if done is None else done.unionByName(good)
        bad = counted.where("n_tokens < 0").select("doc_id", "key")
        same = todo["doc_id"].eqNullSafe(bad["doc_id"]) & (todo["key"] == bad["key"])
        todo = stored(todo.join(bad, same, "left_semi"), "huge-texts")
        overlap *= 8
        chunk = max(chunk, 4 * overlap)
    return done.select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1), "times"))).drop("col")


def _spliced(todo: DataFrame, model: str, chunk: int, overlap: int) -> DataFrame:
    id_type = todo.schema["doc_id"].dataType.simpleString()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                parts = cut(text, chunk, overlap) or [("", -1, -1)]
                for first in range(0, len(parts), 32):
                    some = parts[first : first + 32]
                    one = batch.slice(i, 1).select(["doc_id", "key", "n_bytes", "times"])
                    table = pa.Table.from_batches([one] * len(some)).combine_chunks()
                    for name, kind, at in (("part", pa.string(), 0), ("start", pa.int64(), 1), ("stop", pa.int64(), 2)):
                        table = table.append_column(name, pa.array([x[at] for x in some], kind))
                    yield from table.to_batches()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        processor = _processor(public_tokenizers.path(model))
        assert stable_spaces(processor), "this vocabulary has pieces that cross into a space"
        for batch in batches:
            spans = zip(*(batch.column(c).to_pylist() for c in ("part", "start", "stop")), strict=True)
            counts = [-1 if start < 0 else count_span(processor, part, start, stop) for part, start, stop in spans]
            kept = batch.select(["doc_id", "key", "n_bytes", "times"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(counts, pa.int64())], [*kept.schema.names, "tokens"])

    keys = f"doc_id {id_type}, key bigint, n_bytes bigint, times bigint"
    parts = todo.mapInArrow(chunks, f"{keys}, part string, start bigint, stop bigint")
    spread = parts.repartition(int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "start", F.xxhash64("part"))
    counted = spread.mapInArrow(encode, f"{keys}, tokens bigint")
    failed = F.min("tokens") < 0
    return counted.groupBy("doc_id", "key", "n_bytes", "times").agg(
        F.when(failed, F.lit(-1)).otherwise(F.sum("tokens")).alias("n_tokens")
    )
