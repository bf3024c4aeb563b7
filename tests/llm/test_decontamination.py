import hashlib
import re

import pytest

from fleetloom.llm import decontamination

from .helpers import corpus, frame, lower, result

PATTERN = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def words(text):
    return re.findall(PATTERN, lower(text or ""))


def brute(rows, items, size=10):
    windows = {}
    for item, text in items:
        parts = words(text)
        for at in range(max(len(parts) - size, 0) + 1 if parts else 0):
            windows.setdefault(tuple(parts[at : at + size]), set()).add(item)
    lengths = {len(w) for w in windows}
    found = []
    for i, text in rows:
        parts, hit, held = words(text), set(), set()
        for n in lengths:
            for at in range(len(parts) - n + 1):
                if (window := tuple(parts[at : at + n])) in windows:
                    hit |= set(range(at, at + n))
                    held |= windows[window] - {None}
        names = ",".join(sorted(map(str, held)))
        found.append((i, len(parts), len(hit), len(held), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(found, key=repr)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("seed", range(2))
def test_same_as_brute_force(spark, seed):
    rows = corpus(seed, vocabulary=12)
    texts = [t for _, t in rows if t and len(t) > 100]
    items = [(i, " ".join(texts[i].split()[3 : 8 + 4 * i])) for i in range(8)]
    items += [(8, "Abc"), (9, None), (10, ""), (11, items[3][1].upper()), (2, items[5][1]), (None, items[6][1]), (12, "x"), (13, "absent words here")]
    benchmark = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, term string, row string")
    wanted = brute(rows, items)
    assert sum(row[5] for row in wanted) > 5
    found = decontamination.decontamination_report(frame(spark, rows), benchmark)
    assert result(found, *COLUMNS) == wanted
    # The other way of joining, for tables that are too large to send around.
    small = decontamination.fits_broadcast
    decontamination.fits_broadcast = lambda *_: False
    try:
        assert result(decontamination.decontamination_report(frame(spark, rows), benchmark), *COLUMNS) == wanted
    finally:
        decontamination.fits_broadcast = small


def test_proximity(spark):
    docs = frame(spark, [(1, "a b x c d"), (2, "a b c d"), (3, "d c b a"), (4, "a q q q b q q q c q q d"), (5, "b c d")])
    wanted = decontamination.phrases(spark.createDataFrame([(1, "a b c d")], "item_id long, text string"))
    index = decontamination.build_index(docs)
    rows = {r.row: r.doc_id for r in index.where("term = ''").collect()}
    near = {slop: {rows[r.row] for r in decontamination.find_phrases(index, wanted, slop).collect()} for slop in (0, 1, 6)}
    assert near == {0: {2}, 1: {1, 2}, 6: {1, 2, 3}}


def test_empty_tables(spark, tables):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = corpus(1)
    found = decontamination.decontamination_report(frame(spark, rows), none)
    assert result(found, *COLUMNS) == brute(rows, [])
    one = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert decontamination.decontamination_report(frame(spark, []), one).count() == 0


def test_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    found = decontamination.decontamination_report(docs, items)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    wanted = brute(rows, [tuple(r) for r in items.select("item_id", "text").collect()])
    assert any(row[5] for row in wanted)
    assert result(found, *COLUMNS) == wanted
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
