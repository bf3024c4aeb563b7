import hashlib

import pytest

from fleetloom.llm import line_dedup

from .helpers import corpus, frame, lower, result


def key(line):
    return lower(line.strip("\x20\t\n\x0b\x0c\r"))


def brute(rows, least=10):
    """What each row keeps; null IDs are one document after all others."""
    rank = lambda i: (i is None, i or 0)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(rank(i))
    found = []
    for i, text in rows:
        parts = (text or "").split("\n")
        kept = [p for p in parts if len(holders.get(key(p), "1")) < 2 or min(holders[key(p)]) == rank(i)]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        found.append((i, len(parts), len(parts) - len(kept), digest))
    return sorted(found, key=repr)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block_bytes", [3000, 8 << 20])
def test_same_as_brute_force(spark, seed, block_bytes):
    rows = corpus(seed)
    found = line_dedup.keep_bitmaps(frame(spark, rows), block_bytes=block_bytes)
    wanted = brute(rows)
    assert sum(row[2] for row in wanted) > 20
    assert result(found, "doc_id", "n_lines", "n_dropped", "kept_sha256") == wanted


def test_bitmaps_rebuild_the_text(spark):
    docs = frame(spark, corpus(4))
    texts = {(r.doc_id, r.h): r.text for r in docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()}
    for row in line_dedup.keep_bitmaps(docs).collect():
        kept = line_dedup.apply_bitmap(texts[row.doc_id, row.text_hash], row.keep_bits)
        assert hashlib.sha256(kept.encode()).hexdigest() == row.kept_sha256


def test_empty_and_same_as_brute_force_on_documents(spark, tables):
    assert line_dedup.keep_bitmaps(frame(spark, [])).count() == 0
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = line_dedup.keep_bitmaps(docs, block_bytes=100_000)
    assert result(found, "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute(rows)
