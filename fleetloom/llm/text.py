"""Words and 64-bit hashes of whole batches of texts, computed on byte arrays.

Arrow hands a task the bytes of many texts in one buffer.  Words are found and
hashed there with array operations, so no Python object is made per word.  A
null text is handled as an empty one by all functions of this module.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that a task works on at a time; one longer text is taken alone.
PIECE_BYTES = 1 << 20

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SHIFT = np.uint64(29)
_LONG_WORD = 4096


def white_space() -> np.ndarray:
    """Which bytes separate words: 0x20 and 0x09 to 0x0D."""
    found = np.zeros(256, bool)
    found[[0x20, *range(0x09, 0x0E)]] = True
    return found


def lower_table() -> np.ndarray:
    """Byte table that lower-cases A to Z and nothing else."""
    found = np.arange(256, dtype=np.uint8)
    found[65:91] += 32
    return found


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of *batch* whose texts have about *limit* bytes, in order."""
    ends = text_offsets(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def text_offsets(texts: pa.Array) -> np.ndarray:
    """Where each text begins in the buffer, and where the last one ends."""
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    buffer = texts.buffers()[1]
    if buffer is None or len(texts) == 0:
        return np.zeros(len(texts) + 1, np.int64)
    found = np.frombuffer(buffer, kind)[texts.offset : texts.offset + len(texts) + 1]
    return found.astype(np.int64)


@dataclass
class Spans:
    """Words or lines of some texts: places in *data*, and the text each is from."""

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    text: np.ndarray

    @property
    def per_text(self) -> np.ndarray:
        return np.bincount(self.text, minlength=len(self.bounds) - 1)


def text_bytes(texts: pa.Array, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts on end, with eight spare ones, and their bounds."""
    bounds = text_offsets(texts)
    size = int(bounds[-1] - bounds[0])
    data = np.zeros(size + 8, np.uint8)
    if size:
        source = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        data[:size] = source if table is None else table[source]
    return data, bounds - bounds[0]


def words(texts: pa.Array, space: np.ndarray, table: np.ndarray | None = None) -> Spans:
    """Runs of bytes outside *space*, never across two texts."""
    data, bounds = text_bytes(texts, table)
    size = int(bounds[-1])
    inside = np.zeros(size + 1, bool)
    inside[:size] = ~space[data[:size]]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = bounds[:-1]
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = edge[np.diff(bounds) > 0]
    last = last[last > 0] - 1
    closes[last] |= inside[last]
    if size:
        closes[size - 1] = inside[size - 1]
    ends = np.flatnonzero(closes) + 1
    text = np.searchsorted(bounds, starts, "right") - 1
    return Spans(data, bounds, starts, ends - starts, text)


def _mix(hashes: np.ndarray, odd: np.uint64) -> np.ndarray:
    hashes *= odd
    hashes ^= hashes >> _SHIFT
    return hashes


def hashes(spans: Spans, seed: int) -> np.ndarray:
    """64-bit hash of the bytes of each span; *seed* 0 and 1 give independent ones."""
    odd = _ODD[seed]
    found = _mix(spans.lengths.astype(np.uint64) + odd, odd)
    lanes = np.ndarray((len(spans.data) - 7,), "<u8", spans.data, 0, (1,))
    active = np.flatnonzero((spans.lengths > 0) & (spans.lengths <= _LONG_WORD))
    done = 0
    while len(active):
        left = spans.lengths[active] - done
        lane = lanes[spans.starts[active] + done]
        short = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        keep = np.where(short == 64, ~np.uint64(0), (np.uint64(1) << (short & np.uint64(63))) - np.uint64(1))
        found[active] = _mix(found[active] ^ (lane & keep), odd)
        done += 8
        active = active[left > 8]
    for i in np.flatnonzero(spans.lengths > _LONG_WORD):
        start = int(spans.starts[i])
        body = spans.data[start : start + int(spans.lengths[i])].tobytes()
        digest = hashlib.blake2b(body, digest_size=16).digest()
        found[i] = np.frombuffer(digest, "<u8")[seed]
    return _mix(found, odd)


def runs(values: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hash of each *length* consecutive hashes; there are ``length - 1`` fewer."""
    count = max(len(values) - length + 1, 0)
    odd = _ODD[seed]
    found = np.full(count, np.uint64(length), np.uint64)
    for i in range(length):
        found *= odd
        found += values[i : i + count]
        found ^= found >> _SHIFT
    return _mix(found, odd)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    values = np.sort(values)
    starts = np.flatnonzero(np.r_[len(values) > 0, values[1:] != values[:-1]][: len(values)])
    return values[starts], np.diff(np.r_[starts, len(values)])


def fold(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sum modulo 2**64 of *values* for each of *groups*; *group* is ascending."""
    total = np.zeros(groups, np.uint64)
    if len(values):
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        total[group[first]] = np.add.reduceat(values, first)
    return total


def scramble(values: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of hashes, for sums and partitions that must not be related."""
    return _mix(_mix(values ^ _ODD[1 - seed], _ODD[seed]), _ODD[seed])
