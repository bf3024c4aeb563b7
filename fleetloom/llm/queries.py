"""The training-data operators on the given tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetloom.llm import (
    class_lm,
    decontamination,
    exact_dedup,
    filter_audit,
    jaccard_join,
    line_dedup,
    mixing,
    quality,
    sharding,
    substring_dedup,
    token_counts,
    toxicity,
    whitening,
)
from fleetloom.llm.shared import UPPER
from fleetloom.queries.registry import Query, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into eight shards, and where they would be with a ninth."""
    docs = table(spark, sf_dir, "documents")
    return sharding.shard_documents(docs, sharding.layout(8), sharding.layout(9))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.decontamination_report(docs, items)


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.keep_bitmaps(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
oracle(
    "op2_decontamination",
    f"""
    WITH item AS (
      SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
    wanted AS (
      SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS span
      FROM item, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS place(i) WHERE len(words) > 0),
    doc AS (
      SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
    found AS (
      SELECT doc_id, i, w.size, item_id
      FROM (SELECT doc_id, i, size, array_to_string(words[i : i + size - 1], ' ') AS span
            FROM doc, (SELECT DISTINCT size FROM wanted), unnest(range(1, len(words) - size + 2)) AS place(i)) d
      JOIN wanted w ON w.size = d.size AND w.span = d.span),
    hit AS (
      SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, size FROM found), unnest(range(i, i + size)) AS word(j)
      GROUP BY doc_id),
    held AS (
      SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)""",
)
oracle(
    "op3_line_dedup",
    f"""
    WITH line AS (
      SELECT doc_id, pos, body, translate(regexp_replace(body, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                                          '{UPPER}', '{UPPER.lower()}') AS key
      FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS body,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
    judged AS (
      SELECT doc_id, pos, body, coalesce(length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key), false) AS dropped FROM line)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
           sha256(coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
    FROM judged GROUP BY doc_id""",
)


@query
def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_documents(table(spark, sf_dir, "documents"))


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


oracle(
    "op5_exact_dedup",
    """
    WITH bare AS (
      SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body
      FROM documents)
    SELECT doc_id, first_value(doc_id) OVER (PARTITION BY body ORDER BY size DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY body) AS group_size,
           row_number() OVER (PARTITION BY body ORDER BY size DESC, doc_id) = 1 AS kept, sha256(body) AS text_sha256
    FROM bare""",
)


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), size=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


#: Levels of the mixing tree; the domain is read off the number of the source.
def mix_levels(domain: str = "domain") -> tuple[str, str, str]:
    return domain, "lang", "source"


def with_domain(docs: DataFrame, name: str = "domain") -> DataFrame:
    """The documents with the domain read off the number of their source, in a column *name*."""
    number = F.regexp_extract("source", r"([0-9]+)$", 1).try_cast("int")
    return docs.withColumn(name, F.when(number < 7, "web").when(number < 14, "books").otherwise("code"))


def mix_weights(name: str = "domain") -> list:
    """Three parts web, two books, one code; English counts double; sources are equal."""
    domain = F.when(mixing.level_is(name, "web"), 3).when(mixing.level_is(name, "books"), 2).otherwise(1)
    return [domain, F.when(mixing.level_is("lang", "en"), 2).otherwise(1), F.lit(1)]


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the corpus's tokens, from at most four passes over a source."""
    docs = with_domain(table(spark, sf_dir, "documents"))
    return mixing.mix(docs, mix_levels(), mix_weights(), F.col("tokens") / 2)


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders, by source."""
    masked = filter_audit.failures(table(spark, sf_dir, "documents"))
    return filter_audit.audit(masked, table(spark, sf_dir, "labels"))


oracle(
    "op11_filter_audit",
    """
    WITH doc AS (
      SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    test AS (
      SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
             100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS c,
             regexp_matches(text, '[#$%&*|]') AS d,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM doc),
    label AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS bad FROM labels GROUP BY doc_id),
    tally AS (
      SELECT part, a, b, c, d, e, coalesce(good, false) AS good, coalesce(bad, false) AS bad, count(*) AS n
      FROM test LEFT JOIN label USING (doc_id) GROUP BY ALL),
    letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
    sequence AS (
      SELECT p.f || q.f || r.f || s.f || t.f AS filter_order
      FROM letter p, letter q, letter r, letter s, letter t
      WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
    gone AS (
      SELECT tally.*, filter_order, coalesce(least(
          CASE WHEN a THEN instr(filter_order, 'A') END, CASE WHEN b THEN instr(filter_order, 'B') END,
          CASE WHEN c THEN instr(filter_order, 'C') END, CASE WHEN d THEN instr(filter_order, 'D') END,
          CASE WHEN e THEN instr(filter_order, 'E') END), 6) AS gone_at,
        a::INT + b::INT + c::INT + d::INT + e::INT AS failed
      FROM tally, sequence),
    laid AS (
      SELECT gone.*, step, substr(filter_order, step, 1) AS f, gone_at = step AS here,
        CASE substr(filter_order, step, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails
      FROM gone, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
    counted AS (
      SELECT part, filter_order, step, any_value(f) AS f,
        sum(CASE WHEN gone_at > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN here THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN fails AND gone_at < step THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails AND failed = 1 THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN here AND good THEN n ELSE 0 END) AS good_lost,
        sum(CASE WHEN here AND bad THEN n ELSE 0 END) AS toxic_lost
      FROM laid GROUP BY part, filter_order, step)
    SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
      redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
      toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
    FROM counted""",
)


@query
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; ``passages`` are the significant toxic ones."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
