"""Benchmark decontamination over a positional inverted index.

The index holds one posting (term, document, position) for each training word
that some test phrase uses, and an end mark per document.  A phrase is looked up
from its rarest term: that term's postings give candidate places, the next
rarest must stand at its own offset, and what is left is intersected with the
postings of all other terms at once.  Everything is joins on equal keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetloom.llm.shared import fits_broadcast, lower_ascii, stored

WINDOW = 10
#: What separates words once A to Z are lowered: ASCII other than digits and a to z.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text in order; none for a null."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAKS)
    return F.filter(parts, lambda word: word != "")


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of ``items(item_id, text)``: ``phrase`` (words) and the ``items`` that hold it.

    An item with fewer words than a window is one window; one without words gives
    none.  Windows of an item without ID count, but no ID is reported for them.
    """
    words = F.col("words")
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - window, F.lit(0)))
    return (
        items.select("item_id", words_of(F.col("text")).alias("words"))
        .where(F.size("words") > 0)
        .select("item_id", "words", F.explode(starts).alias("start"))
        .select("item_id", F.slice(words, F.col("start") + 1, F.lit(window)).alias("phrase"))
        .groupBy("phrase")
        .agg(F.collect_set("item_id").alias("items"))
        .withColumn("phrase_id", F.sha2(F.array_join("phrase", " "), 256))
    )


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Written postings ``(term, row, pos)`` of ``docs(doc_id, text)``.

    Each row of *docs* also has an end mark: the empty term at the position after
    its last word, with its ``doc_id``.  ``row`` numbers the rows, so repeated and
    null IDs stay apart.  *terms* limits the postings to the words asked for.
    """
    words = F.concat(words_of(F.col("text")), F.array(F.lit("")))
    numbered = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    postings = numbered.select("row", "doc_id", F.posexplode(words).alias("pos", "term"))
    postings = postings.withColumn("doc_id", F.when(F.col("term") == "", F.col("doc_id")))
    if terms is not None:
        end_mark = docs.sparkSession.range(1).select(F.lit("").alias("term"))
        wanted = terms.unionByName(end_mark).distinct()
        wanted = stored(wanted, "terms")
        if fits_broadcast(wanted.count(), 64):
            wanted = F.broadcast(wanted)
        postings = postings.join(wanted, "term", "left_semi")
    return stored(postings, "postings")


def _ranked_terms(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Terms of each phrase with offset and rank, rarest first; phrases with an unknown term are gone."""
    frequency = index.where("term <> ''").groupBy("term").agg(F.count("*").alias("postings"))
    exploded = wanted.select("phrase_id", F.size("phrase").alias("length"), F.posexplode("phrase").alias("offset", "term"))
    by_rarity = W.partitionBy("phrase_id").orderBy("postings", "offset")
    whole = W.partitionBy("phrase_id")
    return (
        exploded.join(frequency, "term", "left")
        .withColumn("known", F.count("postings").over(whole))
        .where(F.col("known") == F.col("length"))
        .withColumn("rarity", F.row_number().over(by_rarity))
        .select("phrase_id", "length", "term", "offset", "rarity")
    )


def _narrow(df: DataFrame, row_bytes: int) -> DataFrame:
    """*df*, written and counted, to be sent to all executors only if it is small."""
    df = stored(df, "candidates")
    return F.broadcast(df) if fits_broadcast(df.count(), row_bytes) else df


def find_phrases(index: DataFrame, wanted: DataFrame, slop: int = 0) -> DataFrame:
    """Places ``(phrase_id, row, start, length)`` of the phrases ``wanted(phrase_id, phrase)``.

    With *slop* 0 the words stand side by side.  Otherwise it is a proximity match:
    the rarest term fixes the start, and each other term may stand up to *slop*
    positions from where it would be in the exact phrase, whose start may then lie
    before the text.
    """
    ranked = stored(_ranked_terms(index, wanted), "ranked-terms")
    postings = index.where("term <> ''").select("term", "row", "pos")
    anchor = ranked.where("rarity = 1").select("phrase_id", "length", "term", F.col("offset").alias("shift"))
    if fits_broadcast(anchor.count(), 128):
        anchor = F.broadcast(anchor)
    start = (F.col("pos") - F.col("shift")).alias("start")
    found = postings.join(anchor, "term").select("phrase_id", "length", "row", start).where(F.col("start") >= -slop)
    for chosen in (F.col("rarity") == 2, F.col("rarity") > 2):
        terms = ranked.where(chosen)
        found = _intersect(postings, found, terms, slop)
    return found


def _intersect(postings: DataFrame, found: DataFrame, terms: DataFrame, slop: int) -> DataFrame:
    """Candidates of which every one of *terms* is near its place, with those of phrases without such terms."""
    found = stored(found, "places")
    near = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))
    others = terms.select("phrase_id", "term", "offset")
    needed = found.join(others, "phrase_id").select(
        "phrase_id", "length", "row", "start", "term", "offset", near.alias("near")
    )
    needed = needed.withColumn("pos", F.col("start") + F.col("offset") + F.col("near")).drop("near").where("pos >= 0")
    # Only documents with a candidate matter; what is shuffled, if anything, is their postings.
    mine = postings.join(_narrow(found.select("row").distinct(), 24), "row", "left_semi")
    met = mine.join(_narrow(needed, 160), ["term", "row", "pos"])
    asked = terms.groupBy("phrase_id").agg(F.count("*").alias("asked"))
    full = (
        met.groupBy("phrase_id", "length", "row", "start")
        .agg(F.countDistinct("offset").alias("met"))
        .join(asked, "phrase_id")
        .where("met = asked")
        .select("phrase_id", "length", "row", "start")
    )
    return full.unionByName(found.join(asked, "phrase_id", "left_anti"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: words, words inside occurrences, and the items that occur.

    Null and empty texts have no words and are clean; repeated rows and null IDs
    stay apart.  Without items every document is clean.  Other columns are not read.
    """
    asked = stored(phrases(items, window), "phrases")
    index = build_index(docs, asked.select(F.explode("phrase").alias("term")))
    places = stored(find_phrases(index, asked), "found")
    before = W.partitionBy("row").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    # Where windows start at the same word, the longest counts.
    hits = (
        places.groupBy("row", "start")
        .agg(F.max("length").alias("length"))
        .withColumn("covered", F.coalesce(F.max(end).over(before), F.lit(0)))
        .groupBy("row")
        .agg(F.sum(F.greatest(end - F.greatest("start", "covered"), F.lit(0))).alias("n_hit"))
    )
    holders = (
        places.select("row", "phrase_id").distinct()
        .join(asked.select("phrase_id", "items"), "phrase_id")
        .select("row", F.explode(F.col("items").cast("array<string>")).alias("item_id"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    )
    rows = index.where("term = ''").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    return (
        rows.join(hits.join(holders, "row", "left"), "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        )
    )


def decontamination_report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """:func:`contamination` with the number and digest of the items and the verdict."""
    return contamination(docs, items, window).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of *docs*, with all their columns, without a word inside an occurrence.

    Repeated rows are judged alike, as one text.
    """
    text_hash = F.xxhash64("text")
    # The words decide, so equal texts need to be looked at once, under their hash.
    keyed = docs.select(text_hash.alias("doc_id"), "text")
    found = contamination(keyed, items, window).where("n_hit > 0").select("doc_id").distinct()
    hit = stored(found.withColumnRenamed("doc_id", "_hit_hash"), "contaminated")
    hit = F.broadcast(hit) if fits_broadcast(hit.count(), 16) else hit
    return docs.join(hit, F.xxhash64(docs["text"]) == hit["_hit_hash"], "left_anti")
