"""Removal of lines that an earlier document holds, reported as keep bitmaps.

Documents are dealt into blocks.  A block sends each distinct line once, as a
128-bit hash with its smallest document, so a line that a third of all documents
share costs one row per block.  Hashes go to ranges, sorted by document inside
them; one pass over a range finds first occurrences.  Verdicts return to the
blocks, which turn them into one compressed bitmap per document; no text leaves
its block.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetloom.llm import text as T
from fleetloom.llm.shared import in_blocks, in_order, rank_by, total_bytes

BLOCK_BYTES = 8 << 20
MIN_CHARS = 10


def lines(texts: pa.Array) -> tuple[T.Spans, T.Spans, np.ndarray]:
    """Raw lines, their keys (stripped, A-Z lowered) and the code points of each key."""
    data, bounds = T.text_bytes(texts)
    size = int(bounds[-1])
    breaks = np.flatnonzero(data[:size] == 10)
    text = np.r_[np.arange(len(bounds) - 1), np.searchsorted(bounds, breaks, "right") - 1]
    starts = np.r_[bounds[:-1], breaks + 1]
    order = np.lexsort((starts, text))
    text, starts = text[order], starts[order]
    ends = np.r_[starts[1:] - 1, 0]
    last = np.r_[text[1:] != text[:-1], True]
    ends[last] = bounds[1:][text[last]]
    solid = np.flatnonzero(~T.white_space()[data[:size]])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    filled = np.flatnonzero(high > low)
    key_starts, key_ends = starts.copy(), starts.copy()
    key_starts[filled] = solid[low[filled]]
    key_ends[filled] = solid[high[filled] - 1] + 1
    points = np.r_[0, np.cumsum((data[:size] & 0xC0) != 0x80)]
    keys = T.Spans(T.lower_table()[data], bounds, key_starts, key_ends - key_starts, text)
    return T.Spans(data, bounds, starts, ends - starts, text), keys, points[key_ends] - points[key_starts]


def _hashed(table: pa.Table, min_chars: int):
    """Pieces of the block with their lines; then, for all lines long enough, number, hashes and document."""
    found, numbers, first, second, docs, count, doc = [], [], [], [], [], 0, 0
    for batch in table.to_batches():
        for piece in T.pieces(batch, "body"):
            raw, keys, points = lines(piece.column("body"))
            long = np.flatnonzero(points >= min_chars)
            some = T.Spans(keys.data, keys.bounds, keys.starts[long], keys.lengths[long], keys.text[long])
            numbers.append(long + count)
            first.append(T.hashes(some, 0).view(np.int64))
            second.append(T.hashes(some, 1).view(np.int64))
            docs.append(some.text + doc)
            found.append((piece, raw))
            count += len(raw.starts)
            doc += piece.num_rows
    ids = table.column("doc_id")
    doc = np.concatenate(docs)
    missing = ids.is_null().to_numpy(zero_copy_only=False)[doc]
    number = ids.fill_null(0).to_numpy(zero_copy_only=False)[doc]
    return found, count, np.concatenate(numbers), np.concatenate(first), np.concatenate(second), missing, number


def _nullable(values: np.ndarray, missing: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=missing)


def firsts(table: pa.Table, min_chars: int) -> pa.Table:
    """Each distinct line of a block with its smallest document and whether several hold it."""
    table = in_order(table)
    _, _, _, first, second, missing, number = _hashed(table, min_chars)
    order = np.lexsort((number, missing, second, first))
    first, second, missing, number = first[order], second[order], missing[order], number[order]
    starts = np.flatnonzero(np.r_[len(first) > 0, (first[1:] != first[:-1]) | (second[1:] != second[:-1])])[: len(first)]
    ends = np.r_[starts[1:], len(first)][: len(starts)] - 1
    several = (missing[starts] != missing[ends]) | (number[starts] != number[ends])
    block = table.column("block")[0].as_py()
    return pa.table(
        {
            "block": pa.array(np.full(len(starts), block), pa.int32()),
            "h1": first[starts],
            "h2": second[starts],
            "doc_id": _nullable(number[starts], missing[starts]),
            "several": several,
        }
    )


def first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows, those of lines that several documents hold, and whether theirs is the first."""
    waiting = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if waiting is None else pa.concat_tables([waiting, table])
        first = table.column("h1").to_numpy()
        second = table.column("h2").to_numpy()
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        last = int(np.flatnonzero(new)[-1])
        waiting = table.slice(last)
        yield from _verdicts(table.slice(0, last), new[:last])
    if waiting is not None:
        yield from _verdicts(waiting, np.arange(waiting.num_rows) == 0)


def _verdicts(table: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    starts = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    ids = table.column("doc_id")
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    number = ids.fill_null(0).to_numpy(zero_copy_only=False)
    wins = (missing == missing[starts][run]) & (number == number[starts][run])
    several = np.bincount(run, table.column("several").to_numpy(zero_copy_only=False) | ~wins) > 0
    shared = table.select(["block", "h1", "h2"]).append_column("wins", pa.array(wins)).filter(pa.array(several[run]))
    yield from shared.combine_chunks().to_batches()


def bitmaps(table: pa.Table, verdicts: pa.Table, min_chars: int) -> pa.Table:
    """Keep bitmap, counts and checksum of the kept text of each document of a block."""
    table = in_order(table)
    found, count, line, first, second, missing, number = _hashed(table, min_chars)
    told = verdicts.num_rows
    order, group = rank_by(np.r_[verdicts.column("h1").to_numpy(), first], np.r_[verdicts.column("h2").to_numpy(), second])
    groups = int(group.max()) + 1 if len(group) else 0
    state = np.full(groups, -1)
    state[group[:told]] = verdicts.column("wins").to_numpy(zero_copy_only=False)
    group = group[told:]
    order = np.lexsort((number, missing, group))[::-1]
    least = np.zeros(groups, np.int64)
    least[group[order]] = order  # the last written is the smallest document
    holder = least[group]
    stays = (state[group] == 1) & (missing == missing[holder]) & (number == number[holder])
    keep = np.ones(count, bool)
    keep[line[(state[group] >= 0) & ~stays]] = False
    totals, dropped, bits, digests, at = [], [], [], [], 0
    for piece, raw in found:
        mine = keep[at : at + len(raw.starts)]
        at += len(raw.starts)
        per_text = raw.per_text
        ends = np.cumsum(per_text)
        gone = np.bincount(raw.text, ~mine, len(per_text)).astype(np.int64)
        totals.append(per_text)
        dropped.append(gone)
        for i, body in enumerate(piece.column("body").to_pylist()):
            mask = mine[ends[i] - per_text[i] : ends[i]]
            bits.append(zlib.compress(np.packbits(mask).tobytes()))
            body = body or b""
            if gone[i]:
                body = b"\n".join(x for x, stay in zip(body.split(b"\n"), mask.tolist(), strict=True) if stay)
            digests.append(hashlib.sha256(body).hexdigest())
    return pa.table(
        {
            "doc_id": table.column("doc_id"),
            "text_hash": table.column("text_hash"),
            "n_lines": np.concatenate(totals),
            "n_dropped": np.concatenate(dropped),
            "keep_bits": pa.array(bits, pa.binary()),
            "kept_sha256": digests,
        }
    )


def apply_bitmap(text: str | None, keep_bits: bytes) -> str:
    """The kept lines of a text, joined."""
    parts = (text or "").split("\n")
    mask = np.unpackbits(np.frombuffer(zlib.decompress(keep_bits), np.uint8))[: len(parts)]
    return "\n".join(part for part, stay in zip(parts, mask, strict=True) if stay)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: lines, dropped lines, bitmap and checksum of what stays.

    A null or empty text is one empty line.  Rows with the same ID are one document;
    a null ID is a document of its own that comes after all others.  Rows that repeat
    stay apart and get the same bitmap.  Other columns are not read.
    """
    spark = docs.sparkSession
    texts = in_blocks(docs, total_bytes(docs), block_bytes)
    found = texts.groupBy("block").applyInArrow(
        lambda table: firsts(table, min_chars), "block int, h1 long, h2 long, doc_id long, several boolean"
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Hashes are even, so their ranges need no sampling pass.
    part = F.least(F.floor((F.col("h1") / 2.0**64 + 0.5) * parts), F.lit(parts - 1)).cast("int")
    ranges = found.repartitionById(parts, part).sortWithinPartitions("h1", "h2", F.col("doc_id").asc_nulls_last(), "block")
    verdicts = ranges.mapInArrow(first_occurrences, "block int, h1 long, h2 long, wins boolean")
    return (
        texts.groupBy("block")
        .cogroup(verdicts.groupBy("block"))
        .applyInArrow(
            lambda table, told: bitmaps(table, told, min_chars),
            "doc_id long, text_hash long, n_lines long, n_dropped long, keep_bits binary, kept_sha256 string",
        )
    )
