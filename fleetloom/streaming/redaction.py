"""Live redaction of chunked streams."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from fleetloom.operators.redact import (
    MARKER,
    MAX_PATTERN_CHARS,
    MAX_PATTERN_SECRETS,
    _kept,
    _rebuild,
    blocks_of,
    find_hits,
    longest_secret,
    secret_pattern,
    secret_set,
)
from fleetloom.session import cut_lineage

#: Characters of secrets that every task of a live stream may hold.
MAX_LIVE_CHARS = 64 << 20

_STATE = "next_seq long, part long, tail string, last_seq long, seqs array<long>, chunks array<string>"


class Masker:
    """Replaces secrets in a text that is still growing.

    Text that as a whole may yet become a longer secret is held back.  Up to the
    size of one pattern, secrets are found by it; more of them by their first
    characters and a set.  Both find the longest secret at the first place that has one.
    """

    def __init__(self, secrets: Sequence[str], pattern_secrets: int = MAX_PATTERN_SECRETS):
        self.words = sorted({s for s in secrets if s})
        self.longest = max(map(len, self.words), default=0)
        small = len(self.words) <= pattern_secrets and sum(map(len, self.words)) <= MAX_PATTERN_CHARS
        pattern = secret_pattern(self.words) if small else ""
        if pattern:
            search = re.compile(pattern).search
            self.find = lambda text, pos: (m.span() if (m := search(text, pos)) else None)
            return
        self.known = set(self.words)
        lengths: dict[str, set[int]] = {}
        for word in self.words:
            lengths.setdefault(word[:2], set()).add(len(word))
        self.lengths = {start: sorted(some, reverse=True) for start, some in lengths.items()}
        self.find = self._look_up

    def _look_up(self, text: str, pos: int) -> tuple[int, int] | None:
        for at in range(pos, len(text)):
            for start in (text[at : at + 2], text[at]):
                for size in self.lengths.get(start, ()):
                    if text[at : at + size] in self.known:
                        return at, at + size
        return None

    def may_grow(self, text: str) -> bool:
        """Is *text* the beginning of a longer secret?"""
        at = bisect.bisect_right(self.words, text)
        return at < len(self.words) and self.words[at].startswith(text)

    def drain(self, text: str, flush: bool) -> tuple[str, str]:
        """(text that can be shown now, text to hold back)."""
        out, pos = [], 0
        # Places from which the rest of the text may become a longer secret, found once.
        tail = () if flush else range(max(0, len(text) - self.longest + 1), len(text))
        growing = [p for p in tail if self.may_grow(text[p:])]
        while pos < len(text):
            match = self.find(text, pos)
            stop = match[0] if match else len(text)
            held = next((p for p in growing if pos <= p <= stop), None)
            if held is not None:
                out.append(text[pos:held])
                return "".join(out), text[held:]
            out.append(text[pos:stop])
            if match:
                out.append(MARKER)
            pos = match[1] if match else len(text)
        return "".join(out), ""


def live_secrets(secrets: DataFrame, limit: int = MAX_LIVE_CHARS) -> list[str]:
    """The values of a secret table for :func:`redact_stream`; more than *limit* characters are an error."""
    size = secrets.agg(F.coalesce(F.sum(F.length("secret")), F.lit(0))).first()[0]
    if size > limit:
        raise ValueError(f"{size} characters of secrets are more than a live stream can hold: {limit}")
    return [row["secret"] for row in secrets.select("secret").collect()]


def redact_stream(chunks: DataFrame, secrets: Sequence[str], idle_ms: int | None = None) -> DataFrame:
    """Redact ``(stream_id, seq, chunk, last)`` as it arrives: ``(stream_id, part, text, late)``.

    Parts in order spell the redacted stream.  Chunks count from 0 and may come
    out of order; a gap is waited for.  The chunk marked *last* closes the stream
    and flushes it, and so does silence of *idle_ms* when given: then gaps are
    passed over.  A chunk that comes after that is not lost: it is redacted by itself
    and given out with *late* set.  A stream closed by silence is forgotten after
    the same time again.  Such a stream needs a trigger that goes on: Spark runs empty
    batches for timers of this kind without end.  *secrets* is a list as returned by :func:`live_secrets`.
    The state holds the gap chunks and less than one secret of text.
    """
    words = chunks.sparkSession.sparkContext.broadcast(list(secrets))
    maskers: list[Masker] = []

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if not maskers:
            maskers.append(Masker(words.value))
        next_seq, part, tail, last_seq, seqs, texts = (
            state.get if state.exists else (0, 0, "", -1, [], [])
        )
        waiting = {int(seq): text for seq, text in zip(seqs, texts)}
        closing, closed, late = state.hasTimedOut, part < 0, []
        if closing and closed:
            state.remove()
            return
        for frame in () if closing else frames:
            for seq, chunk, last in zip(frame["seq"], frame["chunk"], frame["last"]):
                if closed or seq < next_seq:
                    late.append(maskers[0].drain(chunk or "", True)[0])
                else:
                    waiting[int(seq)] = chunk or ""
                if last:
                    last_seq = int(seq)
        if late:
            yield pd.DataFrame({"stream_id": [key[0]] * len(late), "part": [max(part, -part)] * len(late), "text": late, "late": True})
        if closed:
            state.update((next_seq, part, "", -1, [], []))
            state.setTimeoutDuration(idle_ms)
            return
        arrived = [tail]
        if closing:
            arrived += [waiting[seq] for seq in sorted(waiting)]
            next_seq = max([next_seq, *(seq + 1 for seq in waiting)])
            waiting = {}
        while next_seq in waiting:
            arrived.append(waiting.pop(next_seq))
            next_seq += 1
        ended = 0 <= last_seq < next_seq
        closing = closing or ended
        shown, tail = maskers[0].drain("".join(arrived), closing)
        if shown:
            yield pd.DataFrame({"stream_id": [key[0]], "part": [part], "text": [shown], "late": False})
            part += 1
        if ended:
            state.remove()
            return
        if closing:
            # A negative part marks a stream that silence has closed.
            part = min(-part, -1)
        state.update((next_seq, part, tail, last_seq, list(waiting), list(waiting.values())))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    id_type = chunks.schema["stream_id"].dataType.simpleString()
    return chunks.groupBy("stream_id").applyInPandasWithState(
        step,
        f"stream_id {id_type}, part long, text string, late boolean",
        _STATE,
        "append",
        "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout",
    )


#: Triggers for which a closed stream is remembered, so that chunks sent again do not open it anew.
REMEMBER_TRIGGERS = 1_000
#: Folders of state in turn: a trigger reads the one before it and writes over an older one.
_SLOTS = 3


def _open_schema(chunks: DataFrame) -> StructType:
    """State of :func:`redact_live`: ``chunk`` rows wait behind a gap, an ``open`` row has the tail and the next
    chunk's number, a ``closed`` row the trigger that closed the stream."""
    rest = "kind string, seq long, text string, last boolean, part long"
    return StructType([chunks.schema["stream_id"], *StructType.fromDDL(rest).fields])


def redact_live(chunks: DataFrame, secrets: Callable[[SparkSession], DataFrame], folder: str) -> DataStreamWriter:
    """Redact ``(stream_id, seq, chunk, last)`` as it arrives, with secrets from a table that may grow meanwhile.

    *secrets* reads the table, one column, and is called once per trigger: what is added to the table
    masks all text that is given out from the next trigger on.  No secret passes through the driver and
    their number has no bound; they meet the text as in ``redact_large``, by joins.
    Results ``(stream_id, part, text)`` are written below ``folder/parts``, one folder a trigger; parts in order spell the redacted
    stream.  Chunks count from 0, may come out of order, and wait for a gap.  Of a stream that is not
    closed, the last characters, one less than the longest secret, are held back.  The chunk marked *last* closes it;
    chunks that are sent again are passed over, for ``REMEMBER_TRIGGERS`` triggers after the end too.

    State is a table of open streams: tail and waiting chunks.  A trigger that is run again reads the same
    state and writes over its results.  New text of one stream in one trigger, and its
    waiting chunks, are one row: bound triggers with ``maxBytesPerTrigger``.  The
    caller sets checkpoint location and trigger and starts the writer.
    """
    schema, folder = _open_schema(chunks), folder.rstrip("/")

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            old = spark.read.schema(schema).parquet(f"{folder}/open/slot={(number - 1) % _SLOTS}")
        else:
            old = spark.createDataFrame([], schema)
        done = cut_lineage(_advance(batch, old, secret_set(secrets(spark)), number))
        parts = done.where(F.length("shown") > 0).select("stream_id", "part", F.col("shown").alias("text"))
        parts.write.mode("overwrite").parquet(f"{folder}/parts/trigger={number}")
        kind = F.when(F.col("closed").isNotNull(), "closed").otherwise("open")
        marks = done.where(F.col("closed").isNull() | (F.col("closed") > number - REMEMBER_TRIGGERS)).select(
            "stream_id", kind.alias("kind"), F.coalesce("closed", "next_seq").alias("seq"), F.col("tail").alias("text"),
            F.lit(False).alias("last"), (F.col("part") + (F.length("shown") > 0).cast("long")).alias("part"),
        )
        waiting = done.select("stream_id", F.inline("waiting")).select(
            "stream_id", F.lit("chunk").alias("kind"), "seq", F.col("chunk").alias("text"), "last", F.lit(None).cast("long").alias("part")
        )
        marks.unionByName(waiting).write.mode("overwrite").parquet(f"{folder}/open/slot={number % _SLOTS}")

    return chunks.writeStream.foreachBatch(step)


def _advance(batch: DataFrame, old: DataFrame, secrets: DataFrame, number: int) -> DataFrame:
    """One row per known stream: ``(stream_id, part, shown, tail, next_seq, waiting, closed)`` after a trigger."""
    key = F.struct("stream_id").alias("_key")
    marks = old.where("kind <> 'chunk'").select(
        key,
        F.when(F.col("kind") == "open", F.col("seq")).alias("_next"),
        F.when(F.col("kind") == "closed", F.col("seq")).alias("_closed"),
        F.col("text").alias("_tail"),
        F.col("part").alias("_part"),
    )
    arrived = batch.select(key, F.col("seq").cast("long"), F.coalesce("chunk", F.lit("")).alias("chunk"), F.coalesce("last", F.lit(False)).alias("last"))
    held = old.where("kind = 'chunk'").select(key, "seq", F.col("text").alias("chunk"), "last")
    once = held.unionByName(arrived).groupBy("_key", "seq").agg(F.min("chunk").alias("chunk"), F.max("last").alias("last"))
    lists = once.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("seq", "chunk", "last"))).alias("_chunks"))
    streams = marks.join(lists, "_key", "full").select(
        F.col("_key.stream_id").alias("stream_id"),
        F.coalesce("_next", F.lit(0)).cast("long").alias("_next"),
        "_closed",
        F.coalesce("_tail", F.lit("")).alias("_tail"),
        F.coalesce("_part", F.lit(0)).cast("long").alias("part"),
        F.coalesce("_chunks", F.array().cast("array<struct<seq:bigint,chunk:string,last:boolean>>")).alias("_chunks"),
    )
    # Numbers are distinct and sorted: up to the first gap, number and place go on together.
    streams = streams.withColumn("_chunks", F.filter("_chunks", lambda c: F.col("_closed").isNull() & (c["seq"] >= F.col("_next"))))
    ready = F.filter("_chunks", lambda c, i: c["seq"] - i == F.col("_next"))
    waiting = F.filter("_chunks", lambda c, i: c["seq"] - i > F.col("_next"))
    streams = cut_lineage(
        streams.withColumns({"_ready": ready, "waiting": waiting}).select(
            "stream_id",
            "part",
            F.concat("_tail", F.array_join(F.transform("_ready", lambda c: c["chunk"]), "")).alias("_text"),
            F.exists("_ready", lambda c: c["last"]).alias("_ended"),
            (F.col("_next") + F.size("_ready")).alias("next_seq"),
            "waiting",
            "_closed",
        )
    )
    secrets = cut_lineage(secrets)
    overhang = max(longest_secret(secrets) - 1, 0)
    texts = streams.where(F.length("_text") > 0)
    hits = find_hits(blocks_of(texts, ["stream_id"], "_text", overhang), ["stream_id"], secrets)
    # At most one hit a character of the text.
    hits = hits.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("pos", "len"))).alias("_hits"))
    found = streams.withColumn("_key", key).join(hits.select(key, "_hits"), "_key", "left")
    zero, size = F.lit(0).cast("long"), F.length("_text").cast("long")
    settled = F.when(F.col("_ended"), size).otherwise(F.greatest(size - overhang, zero))
    found = found.withColumn("_settled", settled)
    none = F.array().cast("array<struct<pos:bigint,len:int>>")
    sure = F.filter(F.coalesce(F.col("_hits").cast("array<struct<pos:bigint,len:int>>"), none), lambda h: h["pos"] < F.col("_settled"))
    found = found.withColumn("_sure", _kept(sure, zero))
    # A hit that begins before the held back characters may take some of them.
    end = F.aggregate("_sure", F.col("_settled"), lambda acc, h: F.greatest(acc, h["pos"] + h["len"]))
    found = found.withColumn("_end", end)
    return found.select(
        "stream_id",
        "part",
        _rebuild(F.col("_text"), zero, F.col("_end"), F.col("_sure")).alias("shown"),
        F.expr("substring(_text, int(_end) + 1)").alias("tail"),
        "next_seq",
        # Numbers beyond the last chunk belong to nothing.
        F.when(F.col("_ended"), F.slice("waiting", 1, 0)).otherwise(F.col("waiting")).alias("waiting"),
        F.when(F.col("_ended"), F.lit(number).cast("long")).otherwise(F.col("_closed")).alias("closed"),
    )


def live_parts(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """What :func:`redact_live` has written so far; *schema* is that of the chunks."""
    shape = StructType([schema["stream_id"], *StructType.fromDDL("part long, text string").fields])
    return spark.read.schema(shape).parquet(f"{folder.rstrip('/')}/parts/*")
