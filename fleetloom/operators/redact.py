"""Removal of known secrets from texts and chunked logs.

Every form gives the same text: at each position, left to right, the longest
secret that starts there is replaced, and scanning goes on behind it.
"""

from __future__ import annotations

import os.path
import string
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fleetloom.operators.ordered import running_total
from fleetloom.session import cut_lineage

# Fixed value: what a secret is replaced by.
MARKER = "*** redacted ***"

# A pattern is built on the driver only from a secret set within these bounds.
MAX_PATTERN_SECRETS = 2_000
MAX_PATTERN_CHARS = 256 * 1024
# Largest prefix table broadcast at once; more prefixes take more passes.
MAX_BROADCAST_PREFIXES = 1_000_000

# A secret is looked up by its first characters: the longest of these that it has.
PREFIX_CHARS = (1, 2, 3, 4, 8)
BLOCK_CHARS = 4_096
CELL_CHARS = 64


def secret_set(*sources: DataFrame) -> DataFrame:
    """Union of one-column sources without empty values and duplicates."""
    columns = [source.select(F.col(source.columns[0]).alias("secret")) for source in sources]
    return reduce(DataFrame.union, columns).where(F.length("secret") > 0).distinct()


def _quote(text: str) -> str:
    special = string.punctuation + string.whitespace
    return "".join("\\" + c if c in special else c for c in text)


def _branches(words: Sequence[str]) -> str:
    """Pattern of a sorted list of distinct words that prefers the longest one."""
    groups: dict[str, list[str]] = {}
    for word in words:
        groups.setdefault(word[0], []).append(word)
    branches = []
    for group in groups.values():
        stem = os.path.commonprefix(group)
        tails = [word[len(stem) :] for word in group]
        longer = [tail for tail in tails if tail]
        branch = _quote(stem)
        if longer:
            optional = "?" if len(longer) < len(tails) else ""
            branch += f"(?:{_branches(longer)}){optional}"
        branches.append(branch)
    return "|".join(branches)


def secret_pattern(secrets: Sequence[str]) -> str:
    """Pattern matching the longest secret at a position.

    Secrets share their common stems, so a position costs a few character tests
    instead of one attempt per secret.
    """
    words = sorted({s for s in secrets if s})
    if not words:
        return ""
    firsts = "".join(sorted({_quote(word[0]) for word in words}))
    return f"(?=[{firsts}])(?:{_branches(words)})"


def bounded_secrets(secrets: DataFrame) -> list[str] | None:
    """The secret values, or None when they are too many or too long for one pattern."""
    short = F.when(F.length("secret") <= MAX_PATTERN_CHARS, F.col("secret")).alias("secret")
    values = [row["secret"] for row in secrets.select(short).limit(MAX_PATTERN_SECRETS + 1).collect()]
    if len(values) > MAX_PATTERN_SECRETS or None in values:
        return None
    return values if sum(map(len, values)) <= MAX_PATTERN_CHARS else None


def redact_with(text: Column | str, secrets: Sequence[str]) -> Column:
    """Redacted text for a bounded list of secrets, inside the JVM."""
    column = F.col(text) if isinstance(text, str) else text
    pattern = secret_pattern(secrets)
    return F.regexp_replace(column, F.lit(pattern), F.lit(MARKER)) if pattern else column


def redact(df: DataFrame, text_col: str, secrets: DataFrame) -> DataFrame:
    """Replace every secret in *text_col*.

    A bounded secret set becomes one pattern; a larger one is joined.  Both give the
    same text for every row, whatever its keys.
    """
    values = bounded_secrets(secrets)
    if values is None:
        return redact_large(df, text_col, secrets)
    return df.withColumn(text_col, redact_with(text_col, values))


def redact_columns(df: DataFrame, text_cols: Sequence[str], secrets: DataFrame) -> DataFrame:
    """The same for several columns; *secrets* and, beyond one pattern, *df* are computed once."""
    secrets = cut_lineage(secrets)
    values = bounded_secrets(secrets)
    if values is not None:
        return df.withColumns({name: redact_with(name, values) for name in text_cols})
    done = cut_lineage(df)
    for name in text_cols:
        done = redact_large(done, name, secrets)
    return done


def find_hits(
    blocks: DataFrame,
    keys: Sequence[str],
    secrets: DataFrame,
    prefix_chars: Sequence[int] = PREFIX_CHARS,
    max_prefixes: int = MAX_BROADCAST_PREFIXES,
) -> DataFrame:
    """Longest secret starting at each position: ``(keys, pos, len)``.

    *blocks* is ``(keys, base, body, text)``: *text* starts at position *base* and
    goes on beyond its *body* characters by the longest secret less one, as far
    as there is text.  Fixed-length grams of the text meet a broadcast table of
    secret prefixes, so only real candidates leave their task; those are then
    checked by an equi-join on the whole secret.
    """
    keys = list(keys)
    taken = F.lit(1)
    for n in sorted(prefix_chars):
        taken = F.when(F.length("secret") >= n, F.lit(n)).otherwise(taken)
    # Prefixes meet as hashes: a join on one long is the quickest there is, and a
    # collision only costs a candidate that the whole secret then rules out.
    prefixes = (
        secrets.select(taken.alias("_n"), "secret")
        .groupBy(F.xxhash64(F.expr("substring(secret, 1, _n)")).alias("gram"))
        .agg(
            F.collect_set(F.length("secret")).alias("lengths"),
            F.collect_set("_n").alias("_ns"),
        )
    )
    stats = prefixes.agg(
        F.count(F.lit(1)).alias("n"),
        F.array_distinct(F.flatten(F.collect_set("_ns"))).alias("grams"),
    ).first()
    prefixes = prefixes.select("gram", "lengths")
    if not stats["n"]:
        return blocks.select(*keys, F.col("base").alias("pos"), F.lit(0).alias("len")).limit(0)
    passes = -(-stats["n"] // max_prefixes)
    # A cell is short, because reaching a character costs a walk over those before it,
    # and holds no more than its grams need: long secrets do not widen it.
    cell, reach = CELL_CHARS, max(stats["grams"])
    first = F.col("_cell") * cell
    cells = blocks.withColumn(
        "_cell",
        F.explode(F.sequence(F.lit(0), F.call_function("div", F.col("body") - 1, F.lit(cell)).cast("int"))),
    ).select(
        *keys,
        "base",
        F.col("text").alias("_block"),
        first.alias("_first"),
        F.least(F.lit(cell), F.col("body") - first).cast("int").alias("_width"),
        F.substring("text", first + 1, F.lit(cell + reach - 1)).alias("_chars"),
    )
    grams = cells.select(
        *keys, "base", "_block", "_first", "_chars", F.explode(F.sequence(F.lit(0), F.col("_width") - 1)).alias("_i")
    )
    lengths = sorted(stats["grams"])
    if len(lengths) > 1:
        grams = grams.withColumn("_n", F.explode(F.array(*[F.lit(n) for n in lengths])))
    else:
        grams = grams.withColumn("_n", F.lit(lengths[0]))
    grams = grams.withColumn("gram", F.xxhash64(F.expr("substring(_chars, _i + 1, _n)")))
    found = []
    for turn in range(passes):
        part = prefixes
        if passes > 1:
            part = prefixes.where(F.pmod("gram", F.lit(passes)) == turn)
        found.append(grams.join(F.broadcast(part), "gram"))
    candidates = (
        reduce(DataFrame.unionByName, found)
        .select(*keys, "base", "_first", "_i", "_block", F.explode("lengths").alias("len"))
        .select(
            *keys,
            (F.col("base") + F.col("_first") + F.col("_i")).alias("pos"),
            "len",
            F.substring("_block", F.col("_first") + F.col("_i") + 1, F.col("len")).alias("secret"),
        )
    )
    return (
        candidates.where(F.length("secret") == F.col("len"))
        .join(secrets.select("secret"), "secret", "left_semi")
        .groupBy(*keys, "pos")
        .agg(F.max("len").alias("len"))
    )


def longest_secret(secrets: DataFrame) -> int:
    return secrets.agg(F.coalesce(F.max(F.length("secret")), F.lit(0))).first()[0]


def _free_after(hits: Column, free: Column) -> Column:
    """Where scanning goes on behind the last hit of a sorted list."""
    return F.aggregate(
        hits,
        free.cast("bigint"),
        lambda acc, hit: F.when(hit["pos"] >= acc, hit["pos"] + hit["len"]).otherwise(acc),
    )


def _kept(hits: Column, free: Column) -> Column:
    """Hits of one sorted list that neither an earlier kept hit nor *free* covers."""
    apart = F.forall(
        F.sequence(F.lit(1), F.greatest(F.size(hits) - 1, F.lit(1))),
        lambda i: F.get(hits, i)["pos"] >= F.get(hits, i - 1)["pos"] + F.get(hits, i - 1)["len"],
    )
    empty = F.filter(hits, lambda hit: F.lit(False))
    folded = F.aggregate(
        hits,
        F.struct(free.cast("bigint").alias("free"), empty.alias("kept")),
        lambda acc, hit: F.when(
            hit["pos"] >= acc["free"],
            F.struct(
                (hit["pos"] + hit["len"]).cast("bigint").alias("free"),
                F.array_append(acc["kept"], hit).alias("kept"),
            ),
        ).otherwise(acc),
    )["kept"]
    return F.when(
        (F.size(hits) < 2) | apart, F.filter(hits, lambda hit: hit["pos"] >= free)
    ).otherwise(folded)


def _rebuild(text: Column, first: Column, size: Column, kept: Column) -> Column:
    """Text from position *first* up to *size* with the kept hits replaced."""

    def pieces(hits: Column) -> Column:
        def end_before(i: Column) -> Column:
            previous = F.get(hits, i - 1)
            return F.when(i == 0, first).otherwise(previous["pos"] + previous["len"])

        def piece(i: Column) -> Column:
            end = F.when(i < F.size(hits), F.get(hits, i)["pos"]).otherwise(size)
            length = F.greatest(end - end_before(i), F.lit(0))
            return F.substring(text, (end_before(i) + 1).cast("int"), length.cast("int"))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(hits)), piece), MARKER)

    # Bound to a variable, so that the kept hits are computed once and not per piece.
    return F.get(F.transform(F.array(kept), pieces), F.lit(0))


def _text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text; what is redacted depends on nothing else."""
    return [F.xxhash64(text).alias("_text_1"), F.xxhash64(F.lit("2"), text).alias("_text_2")]


def blocks_of(texts: DataFrame, keys: Sequence[str], text: str, overhang: int) -> DataFrame:
    """Blocks of the texts as :func:`find_hits` takes them: ``(keys, base, body, text)``."""
    size, first = F.length(text), F.col("_b") * BLOCK_CHARS
    last = F.call_function("div", size - 1, F.lit(BLOCK_CHARS)).cast("int")
    return texts.select(*keys, text, F.explode(F.sequence(F.lit(0), last)).alias("_b")).select(
        *keys,
        first.cast("bigint").alias("base"),
        F.least(F.lit(BLOCK_CHARS), size - first).alias("body"),
        F.substring(text, first + 1, F.lit(BLOCK_CHARS + overhang)).alias("text"),
    )


def redact_large(
    df: DataFrame,
    text_col: str,
    secrets: DataFrame,
    prefix_chars: Sequence[int] = PREFIX_CHARS,
    max_prefixes: int = MAX_BROADCAST_PREFIXES,
) -> DataFrame:
    """Same text as :func:`redact` for a secret table of any size.

    Hits are tied to the text itself and not to keys of the row, so rows with
    missing or repeated keys are redacted like all others.
    """
    secrets = cut_lineage(secrets)
    overhang = max(longest_secret(secrets) - 1, 0)
    key = ["_text_1", "_text_2"]
    texts = df.where(F.length(text_col) > 0).select(*_text_key(F.col(text_col)), F.col(text_col).alias("_text"))
    blocks = blocks_of(texts, key, "_text", overhang)
    # One text holds at most as many hits as characters, so this list is bounded.
    hits = (
        find_hits(blocks, key, secrets, prefix_chars, max_prefixes)
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list(F.struct("pos", "len"))).alias("_hits"))
    )
    hits = hits.select(F.struct(*key).alias("_text_key"), "_hits")
    own = F.struct(*_text_key(df[text_col]))
    joined = df.join(hits, own == hits["_text_key"], "left")
    zero = F.lit(0).cast("bigint")
    rebuilt = _rebuild(df[text_col], zero, F.length(df[text_col]), _kept(hits["_hits"], zero))
    done = F.when(hits["_hits"].isNull(), df[text_col]).otherwise(rebuilt).alias(text_col)
    return joined.select(*[done if c == text_col else df[c] for c in df.columns])


def rechunk(chunks: DataFrame, size: int, overhang: int = 0) -> DataFrame:
    """Cut each stream into blocks of *size* characters: ``(stream_id, block, body, text)``.

    *chunks* is ``(stream_id, seq, chunk)``; two chunks of a stream with the same
    ``seq`` are an error.  A null ``stream_id`` is a stream of its own.  A block's
    *text* runs *overhang* characters (at most *size*) into the next block.
    Offsets are running totals over even slices of the data, however far apart the
    numbers in ``seq`` are; no stream is ever gathered whole.
    """
    if overhang > size:
        raise ValueError("overhang must not exceed the block size")
    # As a struct a null ID equals itself in every join below.
    chunks = chunks.where(F.length("chunk") > 0).select(F.struct("stream_id").alias("stream_id"), "seq", "chunk")
    lengths = chunks.select("stream_id", "seq", F.length("chunk").alias("_length"))
    repeated = lengths.groupBy("stream_id", "seq").count().where("count > 1")
    if not repeated.isEmpty():
        raise ValueError("a stream has several chunks with the same seq")
    ends = running_total(lengths, ["stream_id"], ["seq"], F.col("_length"), "_end")
    placed = chunks.join(ends.select("stream_id", "seq", "_end"), ["stream_id", "seq"])
    placed = placed.withColumn("_off", F.col("_end") - F.length("chunk"))
    div = lambda a: F.call_function("div", a, F.lit(size))
    spread = placed.select(
        "stream_id",
        "chunk",
        "_off",
        "_end",
        F.explode(
            F.sequence(
                F.greatest(div(F.col("_off") - overhang), F.lit(0).cast("bigint")),
                div(F.col("_end") - 1),
            )
        ).alias("block"),
    )
    low = F.greatest(F.col("_off"), F.col("block") * size)
    high = F.least(F.col("_end"), (F.col("block") + 1) * size + overhang)
    pieces = spread.where(high > low).select(
        "stream_id",
        "block",
        low.alias("_low"),
        F.substring(
            "chunk", (low - F.col("_off") + 1).cast("int"), (high - low).cast("int")
        ).alias("_piece"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("_low", "_piece")))
    text = F.array_join(F.transform(ordered, lambda p: p["_piece"]), "")
    return (
        pieces.groupBy("stream_id", "block")
        .agg(text.alias("text"))
        .where(F.length("text") > 0)
        .select(
            F.col("stream_id.stream_id").alias("stream_id"),
            "block",
            F.least(F.lit(size), F.length("text")).alias("body"),
            "text",
        )
    )


def redact_chunks(
    chunks: DataFrame,
    secrets: DataFrame,
    block_chars: int = BLOCK_CHARS,
    page_chars: int = 65_536,
    prefix_chars: Sequence[int] = PREFIX_CHARS,
) -> DataFrame:
    """Redact chunked streams, also secrets that straddle chunks.

    Returns ``(stream_id, page, text)``: the redacted stream in pages of
    *page_chars* characters.  Streams are handled block by block, each block
    seeing enough of the next one to find the secrets that start in it.
    """
    secrets = cut_lineage(secrets)
    overhang = max(longest_secret(secrets) - 1, 0)
    size = max(block_chars, overhang + 1)
    cut = rechunk(chunks, size, overhang).withColumn("stream_id", F.struct("stream_id"))
    blocks = cut_lineage(cut)
    key = ["stream_id", "block"]
    hits = cut_lineage(
        find_hits(blocks.withColumn("base", F.lit(0).cast("bigint")), key, secrets, prefix_chars)
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list(F.struct("pos", "len"))).alias("hits"))
    )
    carried = _carry(hits, size)
    joined = blocks.join(hits, key, "left").join(carried, key, "left")
    carry = F.coalesce("carry", F.lit(0).cast("bigint"))
    kept = F.coalesce(_kept(F.col("hits"), carry), F.array().cast("array<struct<pos:bigint,len:int>>"))
    redacted = joined.select(
        F.col("stream_id.stream_id").alias("stream_id"),
        F.col("block").alias("seq"),
        _rebuild(F.col("text"), carry, F.col("body").cast("bigint"), kept).alias("chunk"),
    )
    return rechunk(redacted, page_chars).select(
        "stream_id", F.col("block").alias("page"), "text"
    )


def _carry(hits: DataFrame, size: int) -> DataFrame:
    """Characters of each block already covered by a hit of the block before.

    What a block hands on depends on what it was handed, but only where a hit
    crosses a border.  Each such (block, carry) state points to one state of the
    next block; the states really reached are found by doubling the distance
    that the pointers jump, in as many rounds as the logarithm of the longest
    run of crossed borders.
    """
    key = ["stream_id", "block"]
    crossing = F.transform(
        F.filter("hits", lambda h: h["pos"] + h["len"] > size), lambda h: h["pos"] + h["len"] - size
    )
    zero = F.lit(0).cast("bigint")
    crossed = hits.select(*key, "hits", crossing.alias("_out")).where(F.size("_out") > 0)
    incoming = crossed.select("stream_id", (F.col("block") + 1).alias("block"), F.col("_out").alias("_in"))
    sources = crossed.join(incoming, key, "left")
    states = sources.select(
        *key,
        F.col("_in").isNull().alias("head"),
        F.explode(
            F.array_distinct(F.concat(F.array(zero), F.coalesce("_in", F.array().cast("array<bigint>"))))
        ).alias("carry"),
        "hits",
    )
    free = _free_after(F.col("hits"), F.col("carry"))
    jumps = cut_lineage(
        states.select(
            *key,
            "carry",
            "head",
            (F.col("block") + 1).alias("to_block"),
            F.greatest(free - size, zero).alias("to_carry"),
        )
    )
    reached = jumps.where("head").select(*key, "carry")
    jumps = jumps.drop("head")
    while True:
        ahead = cut_lineage(
            reached.join(jumps, [*key, "carry"]).select(
                "stream_id", F.col("to_block").alias("block"), F.col("to_carry").alias("carry")
            )
        )
        if ahead.isEmpty():
            return reached.where(F.col("carry") > 0)
        reached = cut_lineage(reached.unionByName(ahead))
        onward = jumps.select(
            "stream_id",
            F.col("block").alias("to_block"),
            F.col("carry").alias("to_carry"),
            F.col("to_block").alias("_far_block"),
            F.col("to_carry").alias("_far_carry"),
        )
        jumps = cut_lineage(
            jumps.join(onward, ["stream_id", "to_block", "to_carry"]).select(
                *key,
                "carry",
                F.col("_far_block").alias("to_block"),
                F.col("_far_carry").alias("to_carry"),
            )
        )
