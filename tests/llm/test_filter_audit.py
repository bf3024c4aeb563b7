import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pandas as pd

from fleetloom.llm import filter_audit, queries

from .helpers import corpus, result, words

COLUMNS = ["part", "filter_order", "step", *filter_audit.COUNTS]


def brute(rows, labels):
    """Counts by applying the filters one after the other; rows are (doc_id, text, source)."""
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    bad = {i for i, _, toxic in labels if toxic == 1 and i is not None}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    docs = []
    for i, text, source in rows:
        text = text or ""
        found = words(text)
        fails = set()
        if len(found) < 200:
            fails.add("A")
        if 100 * len(set(found)) < 50 * len(found):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            fails.add("C")
        if re.search("[#$%&*|]", text):
            fails.add("D")
        if i is not None and first[text] < i:
            fails.add("E")
        docs.append((source or "", fails, i in good, i in bad))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        lost = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                redundant = sum(f in d[1] for d in mine) - len(gone)
                left = [d for d in left if f not in d[1]]
                lost[f] += len(gone)
                alone = sum(d[1] == {f} for d in mine)
                out[part, order, step] = [len(left), len(gone), redundant, alone, sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(lost[order[step - 1]])
    return sorted(((*key, *row) for key, row in out.items()), key=repr)


def awkward():
    draw = random.Random(4)
    rows = [(i, t, draw.choice(["a", "b", "", None])) for i, t in corpus()]
    rows += [(500 + i, " ".join(draw.choice("abcdefgh") + str(draw.randint(0, 300)) for _ in range(260)), "a") for i in range(20)]
    rows += [(600, rows[-1][1], "b"), (600, rows[-1][1], "b"), (None, rows[-1][1], "b"), (601, "X# " * 300, None), (602, "x y " * 400, "a")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1])) for i, _, _ in rows[::2]]
    return rows, labels + labels[:5] + [(None, 1, 1), (3, 1, 1), (3, 0, 0), (99999, 1, 1)]


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "doc_id long, text string, source string, part string, mask int, good boolean")
    return docs.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_counts_are_those_of_filtering(spark):
    rows, labels = awkward()
    docs, known = frames(spark, rows, labels)
    found = filter_audit.audit(filter_audit.failures(docs), known)
    assert result(found, *COLUMNS) == brute(rows, labels)


def test_sql_gives_the_same(spark):
    rows, labels = awkward()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    labels_frame = pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64")
    with duckdb.connect() as db:
        db.register("documents", documents)
        db.register("labels", labels_frame)
        found = db.sql(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLES['op11_filter_audit']})").fetchall()
    assert sorted(found, key=repr) == brute(rows, labels)


def test_removal_steps_are_the_first_failed_filter():
    orders, steps = filter_audit.removal_steps(3)
    for mask in range(8):
        for order, step in zip(orders, steps[mask], strict=True):
            at = [i for i, f in enumerate(order, 1) if mask >> f & 1]
            assert step == (at[0] if at else 4)


def test_removed_counts_add_up():
    tallies = np.random.default_rng(1).integers(0, 9, (3, 16, 2, 2))
    found = filter_audit.interactions(tallies, 4)
    total = tallies.sum(axis=(1, 2, 3))
    assert (found["kept"][:, :, -1] == tallies.sum(axis=(2, 3))[:, :1]).all()
    assert (found["removed"].sum(axis=2) + found["kept"][:, :, -1] == total[:, None]).all()
    # Over all orders, what the filters remove adds up to what any order removes.
    orders = filter_audit.removal_steps(4)[0]
    assert (found["shapley"][:, 0, :].sum(axis=1) == (total - found["kept"][:, 0, -1]) * len(orders)).all()


def test_empty_tables(spark):
    rows, labels = awkward()
    docs, known = frames(spark, rows, labels)
    assert filter_audit.audit(filter_audit.failures(docs.limit(0)), known).count() == 0
    found = filter_audit.audit(filter_audit.failures(docs), known.limit(0))
    assert result(found, *COLUMNS) == brute(rows, [])


def test_a_text_that_a_third_of_rows_share(spark):
    rows = [(i, "same text #" if i % 3 else f"text {i}", "a" if i % 2 else None) for i in range(900)]
    labels = [(i, i % 4 // 2, int(i % 5 == 0)) for i in range(0, 900, 2)]
    docs, known = frames(spark, rows, labels)
    assert result(filter_audit.audit(filter_audit.failures(docs), known), *COLUMNS) == brute(rows, labels)
