"""Queries that remove secrets from documents and chunked conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetloom.operators import redact as ops
from fleetloom.queries.registry import query, table
from fleetloom.session import shared_path, spread
from fleetloom.streaming.redaction import live_parts, redact_live

TOKEN = r'token = "([^"]+)"'

_DOC_SECRETS_SQL = r"""secrets AS (
  SELECT DISTINCT unnest(regexp_extract_all(text, 'token = "([^"]+)"', 1)) AS secret FROM documents)"""
_PATTERN_SQL = """pattern AS (
  SELECT string_agg(regexp_escape(secret), '|' ORDER BY length(secret) DESC, secret) AS p FROM secrets)"""
_REDACTED_DOCS_SQL = f"""
    WITH {_DOC_SECRETS_SQL}, {_PATTERN_SQL}, redacted AS (
      SELECT doc_id, text AS original,
             coalesce(regexp_replace(text, p, '*** redacted ***', 'g'), text) AS text
      FROM documents, pattern)
    SELECT doc_id, text, text <> original AS changed FROM redacted"""

_CONV_SECRETS_SQL = """secrets AS (
  SELECT DISTINCT right(a.text, 4) || left(b.text, 4) AS secret
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
  WHERE a.turn = 0)"""
_REDACTED_CHUNKS_SQL = f"""
    WITH {_CONV_SECRETS_SQL}, {_PATTERN_SQL}, streams AS (
      SELECT conv_id AS stream_id, string_agg(text, '' ORDER BY turn) AS whole FROM conversations GROUP BY 1),
    redacted AS (
      SELECT stream_id, coalesce(regexp_replace(whole, p, '*** redacted ***', 'g'), whole) AS whole
      FROM streams, pattern)
    SELECT stream_id, CAST(page AS BIGINT) AS page, substr(whole, CAST(page * 1000 + 1 AS BIGINT), 1000) AS text
    FROM redacted, unnest(range((length(whole) + 999) // 1000)) AS pages(page)"""

PAGE = 1_000


def document_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(1)))
    return ops.secret_set(table(spark, sf_dir, "documents").select(found.alias("secret")))


def conversation_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End of the first turn and start of the second: never inside one chunk."""
    turns = table(spark, sf_dir, "conversations")
    first = turns.where(F.col("turn") == 0).select("conv_id", F.right("text", F.lit(4)).alias("a"))
    second = turns.where(F.col("turn") == 1).select("conv_id", F.left("text", F.lit(4)).alias("b"))
    return ops.secret_set(first.join(second, "conv_id").select(F.concat("a", "b").alias("secret")))


@query(
    f"""WITH {_DOC_SECRETS_SQL.replace('secrets AS', 'tokens AS')},
    {_CONV_SECRETS_SQL.replace('secrets AS', 'seams AS')}
    SELECT secret FROM tokens WHERE secret <> '' UNION SELECT secret FROM seams WHERE secret <> ''"""
)
def secret_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.secret_set(document_secrets(spark, sf_dir), conversation_secrets(spark, sf_dir))


@query(_REDACTED_DOCS_SQL)
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    docs = docs.withColumn("original", F.col("text"))
    done = ops.redact(docs, "text", document_secrets(spark, sf_dir))
    return done.select("doc_id", "text", (F.col("text") != F.col("original")).alias("changed"))


@query(_REDACTED_DOCS_SQL)
def redact_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined form, whatever the number of secrets."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    docs = docs.withColumn("original", F.col("text"))
    done = ops.redact_large(docs, "text", document_secrets(spark, sf_dir))
    return done.select("doc_id", "text", (F.col("text") != F.col("original")).alias("changed"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.col("text").alias("chunk"), "role"
    )


@query(_REDACTED_CHUNKS_SQL)
def redact_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    secrets = conversation_secrets(spark, sf_dir)
    return ops.redact_chunks(_chunks(spark, sf_dir).drop("role"), secrets, page_chars=PAGE)


@query(_REDACTED_CHUNKS_SQL)
def redact_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a live stream whose user turns arrive first; secrets are read anew at each trigger."""
    vault, source, folder, progress = (shared_path(spark, f"live-{part}") for part in ("secrets", "source", "redacted", "progress"))
    conversation_secrets(spark, sf_dir).write.parquet(vault)
    chunks = _chunks(spark, sf_dir)
    ends = chunks.groupBy("stream_id").agg(F.max("seq").alias("_end"))
    live = chunks.join(ends, "stream_id").select(
        "stream_id", "seq", "chunk", (F.col("seq") == F.col("_end")).alias("last"), "role"
    )
    slices = [live.where(F.col("role") == "user").drop("role"), live.where(F.col("role") != "user").drop("role")]
    for part in slices:
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(part.schema).parquet(source)
        writer = redact_live(stream, lambda session: session.read.parquet(vault), folder)
        writer.option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    whole = live_parts(spark, folder, live.schema).select("stream_id", F.col("part").alias("seq"), F.col("text").alias("chunk"))
    return ops.rechunk(whole, PAGE).select("stream_id", F.col("block").alias("page"), "text")
