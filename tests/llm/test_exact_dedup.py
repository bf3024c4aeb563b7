import hashlib
import re

from pyspark.sql import functions as F

from fleetloom.llm import exact_dedup

from .helpers import SPACE, corpus, frame, result

COLUMNS = ("doc_id", "keep_id", "group_size", "text_sha256")


def plain(text):
    return re.sub(SPACE, "", text or "")


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(plain(text), []).append((-len(text or ""), i is None, i))
    return sorted(
        ((i, min(groups[plain(t)])[2], len(groups[plain(t)]), hashlib.sha256(plain(t).encode()).hexdigest()) for i, t in rows),
        key=repr,
    )


def rows_with_copies(seed=0):
    rows = corpus(seed)
    rows += [(500 + i, rows[i % 5][1]) for i in range(40)] + [(None, " "), (700, "\t\t\t\t\t\t\t\t"), (699, "\n\n\n\n\n\n\n\n")]
    return [row for row in rows if row != (None, None)]


def test_same_as_brute_force(spark, tmp_path):
    rows = rows_with_copies()
    frame(spark, rows).write.parquet(str(tmp_path / "docs"))
    found = exact_dedup.deduplicate(spark, str(tmp_path / "docs"))
    assert result(found, *COLUMNS) == brute(rows)
    kept = found.where("kept")
    assert kept.count() == len({plain(t) for _, t in rows}) == kept.select("text_sha256").distinct().count()
    assert kept.where("NOT doc_id <=> keep_id").count() == 0


def test_digest_hits_are_checked_by_their_bytes(spark, tmp_path):
    rows = rows_with_copies(1)
    frame(spark, rows).write.parquet(str(tmp_path / "docs"))
    weak = lambda body: F.substring(F.md5(body), 1, 1)
    found = exact_dedup.deduplicate(spark, str(tmp_path / "docs"), digest=weak)
    assert result(found, *COLUMNS) == brute(rows)


def test_a_second_run_reads_only_new_files(spark, tmp_path):
    rows = rows_with_copies(2)
    folder, progress = str(tmp_path / "docs"), str(tmp_path / "progress")
    frame(spark, rows[:50]).write.parquet(folder)
    first = exact_dedup.update_state(spark, folder, progress).agg(F.sum("size")).first()[0]
    frame(spark, rows[50:]).write.mode("append").parquet(folder)
    assert first == 50
    assert exact_dedup.update_state(spark, folder, progress).agg(F.sum("size")).first()[0] == len(rows)
    assert result(exact_dedup.deduplicate(spark, folder, progress), *COLUMNS) == brute(rows)


def test_empty(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "docs"))
    assert exact_dedup.deduplicate(spark, str(tmp_path / "docs")).count() == 0


def test_a_single_file(spark, tables):
    found = exact_dedup.deduplicate(spark, f"{tables}/documents.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    assert result(found, *COLUMNS) == brute(rows)


def test_a_partitioned_folder(spark, tmp_path):
    rows = rows_with_copies(4)
    docs = frame(spark, rows)
    folder = str(tmp_path / "docs")
    docs.selectExpr("*", "pmod(coalesce(doc_id, 0), 3) AS v", "'p q' AS w").write.partitionBy("v", "w").parquet(folder)
    assert result(exact_dedup.deduplicate(spark, folder), *COLUMNS) == brute(rows)
    one = str(tmp_path / "docs" / "v=1")
    some = [row for row in rows if (row[0] or 0) % 3 == 1]
    assert result(exact_dedup.deduplicate(spark, one), *COLUMNS) == brute(some)
