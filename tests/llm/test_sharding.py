import zlib

from fleetloom.llm import sharding

from .helpers import corpus, frame


def test_every_row_has_one_slot(spark):
    rows = corpus()
    found = sharding.shard_documents(frame(spark, rows), sharding.layout(8), sharding.layout(9)).collect()
    assert len(found) == len(rows)
    key = repr
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=key) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=key
    )
    for shard in range(8):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 8) for r in found)


def placed(spark, tree, n=4000):
    df = sharding.shard_of(spark.range(n), sharding.F.col("id"), tree, "shard")
    return {r.id: r.shard for r in df.collect()}


def test_weights_and_movement(spark):
    tree = [sharding.Leaf(f"r{i // 4}", f"k{i // 2}", i, 1.0 + i % 2) for i in range(8)]
    before = placed(spark, tree)
    counts = [sum(s == i for s in before.values()) for i in range(8)]
    assert all(abs(c / 4000 - leaf.weight / 12) < 0.03 for c, leaf in zip(counts, tree, strict=True))
    heavier = [leaf._replace(weight=3.0) if leaf.shard == 2 else leaf for leaf in tree]
    after = placed(spark, heavier)
    moved = {(before[i], after[i]) for i in before if before[i] != after[i]}
    # Region 0, its rack 1 and shard 2 became heavier; at each level rows go only to the heavier child.
    assert moved and all(new in range(4) for _, new in moved)
    assert all(new in (2, 3) for old, new in moved if old in range(4))
    assert all(new == 2 for old, new in moved if old in (2, 3))


def test_growing_by_one_takes_rows_only_into_the_new_shard(spark):
    for size in (8, 9, 11):
        before, after = placed(spark, sharding.layout(size), 1500), placed(spark, sharding.layout(size + 1), 1500)
        assert all(after[i] in (before[i], size) for i in before)


def test_empty(spark):
    assert sharding.shard_documents(frame(spark, []), sharding.layout(8), sharding.layout(9)).count() == 0
