"""Removal of repeated word windows, found through a count-min prefilter.

Every block of documents sketches the hashes of its windows: a row of the sketch
is cut into shards, a block sends the sorted cells it touches as a delta code of
about two bytes a window, and a shard's cells from all blocks are merged by
adding.  Counts are never too low, so a window in a cell counted once is unique;
only windows whose cell was counted more often go on.  Their full 96-bit hashes
are grouped exactly, and the place of the first of each group returns to its
block.  Sketch and corpus grow together: the number of cells follows the size
of the corpus, and no task holds more than a shard or a block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetloom.llm import text as T
from fleetloom.llm.shared import in_blocks, in_order, total_bytes

WINDOW = 20
BLOCK_BYTES = 8 << 20
#: Cells of the sketch for each word expected in the corpus.
CELLS_PER_WORD = 32
SHARD_BITS = 24
_BYTES_PER_WORD = 5


def encode_cells(cells: np.ndarray) -> bytes:
    """Ascending numbers as differences: a low byte each, and high parts with 255 as carry."""
    steps = np.diff(cells, prepend=0)
    high = steps >> 8
    length = high // 255 + 1
    stream = np.full(int(length.sum()), 255, np.uint8)
    stream[np.cumsum(length) - 1] = high % 255
    return np.uint32(len(cells)).tobytes() + (steps & 255).astype(np.uint8).tobytes() + stream.tobytes()


def decode_cells(code: bytes) -> np.ndarray:
    count = int(np.frombuffer(code, np.uint32, 1)[0])
    low = np.frombuffer(code, np.uint8, count, 4)
    stream = np.frombuffer(code, np.uint8, offset=4 + count)
    high = np.cumsum(stream, dtype=np.int64)[stream != 255]
    return high * 256 + np.cumsum(low, dtype=np.int64)


def _windows(piece: pa.RecordBatch, size: int):
    """Words of a piece, and first word and hash of each window."""
    spans = T.words(piece.column("body"), T.white_space())
    count = max(len(spans.text) - size + 1, 0)
    whole = np.flatnonzero(spans.text[:count] == spans.text[size - 1 :][:count])
    return spans, whole, T.runs(T.hashes(spans, 0), size, 0)[whole]


def _cell(first: np.ndarray, bits: int) -> np.ndarray:
    return (first >> np.uint64(64 - bits)).astype(np.int64)


def sketch(table: pa.Table, size: int, bits: int, shard_bits: int) -> pa.Table:
    """Sorted cells of a block for each shard; a cell met more than once comes twice."""
    found = [np.zeros(0, np.int64)]
    for batch in table.to_batches():
        for piece in T.pieces(batch, "body"):
            found.append(_cell(_windows(piece, size)[2], bits))
    cells, times = T.distinct(np.concatenate(found))
    cells = np.repeat(cells, np.minimum(times, 2))
    block = table.column("block")[0].as_py()
    return _by_shard(cells, shard_bits, block)


def _by_shard(cells: np.ndarray, shard_bits: int, block: int) -> pa.Table:
    shard = cells >> shard_bits
    starts = np.flatnonzero(np.r_[len(cells) > 0, shard[1:] != shard[:-1]])[: len(cells)]
    mask = (1 << shard_bits) - 1
    codes = [encode_cells(part & mask) for part in np.split(cells, starts[1:])] if len(cells) else []
    return pa.table(
        {
            "block": pa.array(np.full(len(starts), block), pa.int32()),
            "shard": pa.array(shard[starts], pa.int64()),
            "cells": pa.array(codes, pa.binary()),
        }
    )


def merge(table: pa.Table) -> pa.Table:
    """Of a shard's sketches, the cells that are counted more than once in all, for each block."""
    parts = [decode_cells(code) for code in table.column("cells").to_pylist()]
    cells = np.sort(np.concatenate(parts))
    often = T.distinct(cells[1:][cells[1:] == cells[:-1]])[0]
    blocks, codes = [], []
    for block, part in zip(table.column("block").to_pylist(), parts, strict=True):
        mine = T.distinct(part[_contains(often, part)])[0]
        if len(mine):
            blocks.append(block)
            codes.append(encode_cells(mine))
    shard = table.column("shard")[0].as_py()
    return pa.table(
        {
            "block": pa.array(blocks, pa.int32()),
            "shard": pa.array([shard] * len(blocks), pa.int64()),
            "cells": pa.array(codes, pa.binary()),
        }
    )


def _often(flags: pa.Table, shard_bits: int) -> np.ndarray:
    parts = [
        (shard << shard_bits) + decode_cells(code)
        for shard, code in zip(flags.column("shard").to_pylist(), flags.column("cells").to_pylist(), strict=True)
    ]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def _contains(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return sorted_values[at] == wanted


def _candidates(table: pa.Table, often: np.ndarray, size: int, bits: int):
    """Per piece: documents, words, and first word, place and hash of the windows whose cell was counted often.

    A place is the document's number in the block and the word's number in the document.
    """
    row = 0
    for batch in table.to_batches():
        for piece in T.pieces(batch, "body"):
            spans, at, first = _windows(piece, size)
            chosen = np.flatnonzero(_contains(often, _cell(first, bits)))
            at = at[chosen]
            begins = np.cumsum(spans.per_text) - spans.per_text
            text = spans.text[at]
            yield piece, spans, at, ((text + row) << 32) | (at - begins[text]), first[chosen]
            row += piece.num_rows


def repeated(table: pa.Table, flags: pa.Table, size: int, bits: int, shard_bits: int) -> pa.Table:
    """Windows of a block that may be repeated; of equal ones in the block, only the first."""
    table = in_order(table)
    often = _often(flags, shard_bits)
    none = np.zeros(0, np.int64)
    places, first, second = [none], [none.view(np.uint64)], [none.view(np.uint32)]
    for _, spans, at, place, hashed in _candidates(table, often, size, bits):
        places.append(place)
        first.append(hashed)
        second.append(T.runs(T.hashes(spans, 1), size, 1)[at].astype(np.uint32))
    place, one, two = np.concatenate(places), np.concatenate(first), np.concatenate(second)
    # Places ascend, so the first of each group is the earliest.
    order = np.argsort(one)
    new = np.r_[len(one) > 0, one[order][1:] != one[order][:-1]][: len(one)]
    if (~new[1:] & (two[order][1:] != two[order][:-1])).any():
        order = np.lexsort((two, one))
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    starts = np.flatnonzero(new)
    keep = np.sort(np.minimum.reduceat(order, starts)) if len(starts) else starts
    place = place[keep]
    # A null ID comes after all others.
    ids = table.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
    return pa.table(
        {
            "h1": one[keep].view(np.int64),
            "h2": two[keep].view(np.int32),
            "doc_id": ids[place >> 32],
            "block": pa.array(np.full(len(place), table.column("block")[0].as_py()), pa.int32()),
            "place": place,
        }
    )


def earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, document, block and place, the first of each hash."""
    one = two = None
    for batch in batches:
        h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[:1] = one is None or (h1[0], h2[0]) != (one, two)
        if len(h1):
            one, two = h1[-1], h2[-1]
        yield batch.select(["block", "place"]).filter(pa.array(new))


def remaining(table: pa.Table, told: pa.Table, size: int, bits: int, shard_bits: int, with_text: bool) -> pa.Table:
    """Each document of a block without the words of windows that began earlier."""
    table = in_order(table)
    is_flag = told.column("cells").is_valid()
    often = _often(told.filter(is_flag), shard_bits)
    stays = np.sort(told.column("place").drop_null().to_numpy())
    totals, removed, digests, kept = [], [], [], []
    for piece, spans, at, place, _ in _candidates(table, often, size, bits):
        again = at[~_contains(stays, place)]
        steps = np.zeros(len(spans.text) + 1, np.int64)
        steps[again] += 1
        np.add.at(steps, again + size, -1)
        gone = np.cumsum(steps)[:-1] > 0
        per_text = spans.per_text
        ends = np.cumsum(per_text)
        lost = np.bincount(spans.text, gone, len(per_text)).astype(np.int64)
        totals.append(per_text)
        removed.append(lost)
        for i, body in enumerate(piece.column("body").to_pylist()):
            parts = (body or b"").split()
            if lost[i]:
                parts = compress(parts, (~gone[ends[i] - per_text[i] : ends[i]]).tolist())
            body = b" ".join(parts)
            digests.append(hashlib.sha256(body).hexdigest())
            if with_text:
                kept.append(body)
    found = {
        "doc_id": table.column("doc_id"),
        "text_hash": table.column("text_hash"),
        "n_words": np.concatenate(totals),
        "n_removed": np.concatenate(removed),
        "kept_sha256": digests,
    }
    return pa.table(found | ({"kept": pa.array(kept, pa.binary()).cast(pa.string())} if with_text else {}))


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
    cells_per_word: int = CELLS_PER_WORD, shard_bits: int = SHARD_BITS, with_text: bool = True,
) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: words, removed words, checksum of what is left and, if asked for, it.

    A window that also starts in a smaller ID, or earlier in the same text, is
    removed.  Null IDs come after all others.  Rows with the same ID have a fixed
    order by their texts, so of repeated rows one keeps its words.  A null text has no words.
    Other columns are not read.
    """
    total = total_bytes(docs)
    bits = max(8, math.ceil(math.log2(cells_per_word * max(total / _BYTES_PER_WORD, 1))))
    texts = in_blocks(docs, total, block_bytes)
    shard = min(shard_bits, bits)
    coded = "block int, shard long, cells binary"
    cells = texts.groupBy("block").applyInArrow(lambda table: sketch(table, window, bits, shard), coded)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flags = cells.groupBy("shard").applyInArrow(merge, coded).repartition(parts, "block")
    candidates = (
        texts.groupBy("block")
        .cogroup(flags.groupBy("block"))
        .applyInArrow(
            lambda table, told: repeated(table, told, window, bits, shard),
            "h1 long, h2 int, doc_id long, block int, place long",
        )
    )
    grouped = candidates.repartition(parts, "h1", "h2").sortWithinPartitions("h1", "h2", "doc_id", "block", "place")
    firsts = grouped.mapInArrow(earliest, "block int, place long")
    told = flags.unionByName(firsts, allowMissingColumns=True)
    result = "doc_id long, text_hash long, n_words long, n_removed long, kept_sha256 string"
    return (
        texts.groupBy("block")
        .cogroup(told.groupBy("block"))
        .applyInArrow(
            lambda table, known: remaining(table, known, window, bits, shard, with_text),
            result + (", kept string" if with_text else ""),
        )
    )
