import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetloom.llm import substring_dedup

from .helpers import corpus, frame, words


def brute(rows, size=20):
    """Rows in order of ID; of rows with one ID, those with a greater text hash come later."""
    seen, found = set(), []
    for i, text in rows:
        parts = words(text)
        gone = [False] * len(parts)
        for at in range(len(parts) - size + 1):
            window = tuple(parts[at : at + size])
            if window in seen:
                gone[at : at + size] = [True] * size
            seen.add(window)
        kept = " ".join(p for p, lost in zip(parts, gone, strict=True) if not lost)
        found.append((i, len(parts), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(found, key=repr)


def ordered(docs):
    sort = docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").orderBy(F.asc_nulls_last("doc_id"), "h")
    return [(r.doc_id, r.text) for r in sort.collect()]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize(("block_bytes", "cells", "shard_bits"), [(3000, 1, 4), (3000, 32, 24), (8 << 20, 32, 10)])
def test_same_as_brute_force(spark, seed, block_bytes, cells, shard_bits):
    docs = frame(spark, corpus(seed))
    wanted = brute(ordered(docs))
    assert sum(row[2] for row in wanted) > 300
    found = substring_dedup.remove_repeats(docs, block_bytes=block_bytes, cells_per_word=cells, shard_bits=shard_bits).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=repr) == wanted
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in found)


def test_cell_code():
    for cells in ([], [0], [0, 0, 5, 5, 255, 256, 70_000, 70_000, 9_000_000, 2**24 - 1]):
        values = np.array(cells, np.int64)
        assert substring_dedup.decode_cells(substring_dedup.encode_cells(values)).tolist() == cells


def test_empty_and_documents(spark, tables):
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    found = substring_dedup.remove_repeats(docs, block_bytes=100_000, with_text=False).collect()
    assert sorted(map(tuple, (r[0:1] + r[2:] for r in found)), key=repr) == brute(ordered(docs))
