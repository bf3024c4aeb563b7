import random

import numpy as np
import pyarrow as pa
import pytest

from fleetloom.llm import jaccard_join
from fleetloom.llm import components as components_module
from fleetloom.llm.components import components
from fleetloom.llm.shared import stored

from .helpers import corpus, frame, lower, result, words


def shingles(text, size):
    parts = words(lower(text or ""))
    if len(parts) < size:
        return {tuple(parts)} if parts else set()
    return {tuple(parts[i : i + size]) for i in range(len(parts) - size + 1)}


def brute(rows, size, num, den):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=repr)


def near_copies(seed=0):
    """Texts of 1 to 400 words with copies in which a few words differ."""
    draw = random.Random(seed)
    rows, number = corpus(seed, 30), 1000
    for length in (1, 3, 4, 5, 7, 8, 9, 10, 12, 15, 20, 30, 60, 120, 400):
        base = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(length)]
        for _ in range(12):
            text = list(base)
            for _ in range(draw.choice([0, 1, 1, 2, 3, 4]) if length < 100 else draw.randint(0, 8)):
                text[draw.randrange(len(text))] = draw.choice(["new", "other"])
            rows.append((number, " ".join(text[: len(text) - draw.choice([0, 0, 1])])))
            number += 1
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "size", "num"), [(0, 4, 85), (1, 5, 80), (2, 4, 85)])
def test_same_as_brute_force(spark, seed, size, num):
    rows = near_copies(seed)
    found = jaccard_join.near_duplicates(frame(spark, rows), size, num, 100)
    assert result(found, "doc_id", "n_shingles", "component_id") == brute(rows, size, num, 100)


def test_large_groups_need_several_centres(spark):
    # A chain: neighbours are similar, the ends are not; all share signatures with some.
    draw = random.Random(5)
    text = [f"w{i}" for i in range(300)]
    rows = []
    for number in range(40):
        rows.append((number, " ".join(text)))
        for _ in range(3):
            text[draw.randrange(300)] = f"n{number}"
    assert result(jaccard_join.near_duplicates(frame(spark, rows), 4, 85, 100), "doc_id", "n_shingles", "component_id") == brute(rows, 4, 85, 100)


@pytest.mark.parametrize("num", [85, 80])
def test_similar_sets_share_a_signature(num):
    draw = np.random.default_rng(num)
    for n in [*range(1, 40), 60, 100, 333, 1000]:
        for _ in range(6):
            first = draw.integers(0, 2**63, n).astype(np.uint64)
            drop = int(draw.integers(0, max(n // 4, 1) + 1))
            second = np.r_[first[drop:], draw.integers(0, 2**63, int(draw.integers(0, n // 5 + 2))).astype(np.uint64)]
            if not len(second):
                continue
            common, union = n - drop, n + len(second) - (n - drop)
            text = np.r_[np.zeros(n, int), np.ones(len(second), int)]
            owner, value = jaccard_join.signatures(text, np.r_[first, second], 2, num, 100)
            shared = set(value[owner == 0].tolist()) & set(value[owner == 1].tolist())
            assert shared or 100 * common < num * union


def test_slices_rounds_and_long_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SLICE", 5)
    monkeypatch.setattr(jaccard_join, "MORE_PAIRS", 1)
    monkeypatch.setattr(jaccard_join, "LISTED", 4)
    rows = near_copies(6)
    found = jaccard_join.near_duplicates(frame(spark, rows), 4, 85, 100)
    assert result(found, "doc_id", "n_shingles", "component_id") == brute(rows, 4, 85, 100)


def test_sets_that_share_a_name_stay_apart(spark):
    rows = near_copies(7)
    found = jaccard_join.JaccardJoin(frame(spark, rows), 4, 85, 100, name_bits=6)
    # Nearly every name of six bits is shared; all such sets are named by both halves.
    assert len(found.renamed) > 20
    assert result(found.classes(), "doc_id", "n_shingles", "component_id") == brute(rows, 4, 85, 100)


def test_the_largest_component_is_not_compared_with_itself(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SLICE", 4)
    join = jaccard_join.JaccardJoin(frame(spark, [(1, "a b c d e f g h")]), 4, 85, 100)
    # Node n of the group: 40 nodes of root 0, and three others of their own.
    members = [(9, n, 0 if n < 40 else n) for n in range(43)]
    profiles = [(n, 10, bytes([10]) + bytes(jaccard_join.PARTS - 1)) for n in range(43)]
    given = spark.createDataFrame(members, "grp long, node long, root long")
    known = spark.createDataFrame(profiles, "node long, size long, profile binary")
    pairs = {tuple(r) for r in join._possible(given, known, None).collect()}
    assert pairs == {(a, b) for b in (40, 41, 42) for a in range(b)}
    # Within slices, a forest of the possible pairs.
    alone = given.withColumn("root", given["node"])
    assert len(join._possible(alone, known, 0, within=True).collect()) >= 43 - 11


def test_a_forest_ties_what_all_pairs_tie():
    draw = np.random.default_rng(3)
    for size in (2, 5, 30):
        profile = (draw.random((size, jaccard_join.PARTS)) < 0.02).astype(np.uint8)
        profile[size // 2 :] = profile[0]
        nodes = np.arange(size) + 100
        table = pa.table(
            {
                "grp": np.zeros(size, int), "i": np.zeros(size, int), "j": np.zeros(size, int), "node": nodes, "root": nodes,
                "slice": np.zeros(size, int), "size": profile.sum(axis=1, dtype=np.int64),
                "profile": pa.array([row.tobytes() for row in profile], pa.binary()),
            }
        )
        ends = np.array([0, size])
        every, forest = (
            {(a, b) for batch in jaccard_join._compared(table, ends, 85, 100, limit) for a, b in zip(*batch.to_pydict().values(), strict=True)}
            for limit in (None, 0)
        )

        def tied(pairs):
            root = {n: n for n in nodes.tolist()}
            for a, b in sorted(pairs):
                ra, rb = root[a], root[b]
                root = {n: min(ra, rb) if r in (ra, rb) else r for n, r in root.items()}
            return root

        assert forest <= every and tied(forest) == tied(every)
        assert len(forest) == size - len(set(tied(every).values()))


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 100])
def test_repeated_nodes_in_batches_of_a_few_rows(monkeypatch, rows):
    monkeypatch.setattr(jaccard_join, "LISTED", 4)
    groups = {1: "AAAABC", 2: "AB", 3: "AAAAAAAAA", 4: "ABBCCCDDE", 5: "AAAAAABBBBBBCDEF", 6: "BA", 7: "ABCDEEEEEEE"}
    pairs = sorted((sig, ord(node)) for sig, nodes in groups.items() for node in nodes)
    batches = [
        pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs[at : at + rows], strict=True)], ["sig", "node"])
        for at in range(0, len(pairs), rows)
    ]
    named = {}
    for batch in jaccard_join._members(iter(batches)):
        for row in batch.to_pylist():
            named.setdefault(row["grp"], set()).add(chr(row["node"]))
    # Short lists have one group each, long ones one for each signature.
    assert sorted("".join(sorted(x)) for x in named.values()) == ["AB", "ABC", "ABCDE", "ABCDE", "ABCDEF"]
    assert {4, 5, 7} <= set(named)


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(140)] + [(i, i + 1) for i in range(1000, 1060)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}
    for a, b in links:
        ra, rb = root.get(a, a), root.get(b, b)
        for n in [*root, a, b]:
            if root.get(n, n) in (ra, rb):
                root[n] = min(ra, rb)
    assert {n: found.get(n, n) for n in root} == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_several_tasks(spark, monkeypatch):
    chain = [(i, i + 1) for i in range(0, 400)] + [(i, i + 500) for i in range(0, 300, 2)] + [(1000, 1001), (1001, 1000)]
    links = spark.createDataFrame(chain, "a long, b long")
    written = []
    monkeypatch.setattr(components_module, "stored", lambda df, label: written.append(label) or stored(df, label))
    whole = {r.node: r.root for r in components(links).collect()}
    # What fits into a task is tied there, without rounds of shuffles.
    assert written == ["stars"]
    assert whole == {i: 0 for i in [*range(1, 401), *range(500, 800, 2)]} | {1001: 1000}
    monkeypatch.setattr(components_module, "TASK_LINKS", 50)
    assert {r.node: r.root for r in components(links).collect()} == whole
    assert "links" in written


def test_one_of_each_class_stays(spark):
    rows = near_copies(3)
    docs = frame(spark, rows)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    wanted = brute(rows, 5, 80, 100)
    classes = {c for i, n, c in wanted if n}
    ids = [r.doc_id for r in kept.collect()]
    # ID 8 has two texts, one of them twice: one row of each stays.
    assert ids.count(8) == 2
    ids.remove(8)
    assert sorted(i for i in ids if i is not None) == sorted([c for c in classes if c is not None] + [i for i, n, _ in wanted if not n and i is not None])


def test_empty(spark):
    assert jaccard_join.near_duplicates(frame(spark, []), 4, 85, 100).count() == 0
    assert jaccard_join.keep_one(frame(spark, [])).count() == 0
