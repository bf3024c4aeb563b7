import corpus_pipeline
from fleetloom.llm import quality
from fleetloom.llm.shared import stored

from . import test_decontamination, test_jaccard_join
from .helpers import corpus, frame


def test_run_is_its_stages_on_what_is_left(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    left, ids = docs, set(rows)
    names = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        names.append(name)
        left = stored(stage(spark, left, tables), "stage")
        assert left.columns == docs.columns
        now = left.collect()
        assert all(r == rows[r.doc_id] for r in now)
        kept = {r.doc_id for r in now}
        assert len(kept) == len(now) and kept < ids
        texts = [(i, rows[i].text) for i in sorted(ids)]
        if name == "quality classifier":
            scores = quality.quality_scores(docs, labels).where("score >= 0.7").select("doc_id").collect()
            assert kept == {r.doc_id for r in scores}
        elif name == "n-gram Jaccard join":
            assert kept == {c for _, _, c in test_jaccard_join.brute(texts, 5, 80, 100)}
        elif name == "benchmark decontamination":
            assert kept == {row[0] for row in test_decontamination.brute(texts, items) if not row[5]}
        else:
            tokens = lambda some: sum(len(test_jaccard_join.words(rows[i].text)) for i in some)
            assert 0.75 * tokens(ids) < tokens(kept) < 0.95 * tokens(ids)
        ids = kept
    assert len(names) == 4
    found = corpus_pipeline.run(spark, tables)
    assert {r.doc_id for r in found.collect()} == ids


def test_mixing_leaves_a_column_named_domain_alone(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").selectExpr("*", "'MINE' AS DOMAIN", "doc_id AS _domain")
    mixed = corpus_pipeline.mixing_stage(spark, docs, tables)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert rows and all(r.DOMAIN == "MINE" and r._domain == r.doc_id for r in rows)


def test_stages_survive_awkward_rows(spark, tables):
    for rows in (corpus(), []):
        docs = frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, tables).columns == docs.columns
            assert stage(spark, docs, tables).count() <= len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, tables).count() == len(rows)
