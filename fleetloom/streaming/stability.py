"""Live readiness and retry budgets with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: How long a decided key is remembered after its last event, in seconds of event time.
FORGET_SECONDS = 30 * 86_400

_STABLE_STATE = "t0 long, began long, last long, done boolean, ts array<long>, id array<long>, bad array<boolean>"
_RETRY_STATE = "t0 long, hit long, last long, done boolean"


def _micros(series: pd.Series) -> np.ndarray:
    return series.to_numpy().astype("datetime64[us]").astype("int64")


def _stable_start(ts: np.ndarray, bad: np.ndarray, began: int, quiet: int) -> tuple[int, int]:
    """(start that stayed good for *quiet* or -1, start still open or -1).

    *ts* is sorted; *began* is the open start from earlier, or -1.
    """
    good = ~bad
    fresh = np.concatenate(([began < 0], bad[:-1])) if len(bad) else np.zeros(0, bool)
    starts = ts[good & fresh]
    if began >= 0:
        starts = np.concatenate(([began], starts))
    # Starts and the first bad event behind each of them, by row order.
    rows = np.flatnonzero(good & fresh)
    if began >= 0:
        rows = np.concatenate(([-1], rows))
    bad_rows = np.flatnonzero(bad)
    following = np.searchsorted(bad_rows, rows, side="right")
    closed = following < len(bad_rows)
    ends = ts[bad_rows[following[closed]]]
    held = np.flatnonzero(ends - starts[closed] >= quiet)
    if len(held):
        return int(starts[closed][held[0]]), -1
    return -1, int(starts[~closed][0]) if (~closed).any() else -1


def stable_stream(
    events: DataFrame,
    quiet_seconds: int,
    deadline_seconds: int,
    delay_seconds: int = 60,
    forget_seconds: int = FORGET_SECONDS,
) -> DataFrame:
    """Streaming form of ``first_stable``: one row per node, when it is decided.

    *events* is ``(node, event_id, ts TIMESTAMP, good)``.  An event waits in the
    state until nothing older can come: until the watermark, or a later event of
    its node less the delay, passes it.  So disorder within the delay changes
    nothing; later rows are dropped and counted by Spark.  A timer makes silence
    count.  The rows of one node in a trigger share a task: bound them with the
    source's ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``.  A decided node leaves the state
    once the watermark is *forget_seconds* past its last event; if it comes back
    after that, a new wait begins.
    """
    quiet, limit = quiet_seconds * 1_000_000, deadline_seconds * 1_000_000
    delay = delay_seconds * 1_000_000

    def decide(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        t0, began, last, done, ts, ids, bad = state.get if state.exists else (-1, -1, -1, False, [], [], [])
        rows = [f for f in frames if len(f)] if not state.hasTimedOut else []
        last = max([last, *(int(_micros(f["ts"]).max()) for f in rows)])
        if done:
            _keep_or_forget(state, (t0, -1, last, True, [], [], []), last, forget_seconds)
            return
        ts, ids, bad = (np.array(ts, "int64"), np.array(ids, "int64"), np.array(bad, bool))
        for frame in rows:
            ts = np.concatenate([ts, _micros(frame["ts"])])
            ids = np.concatenate([ids, frame["event_id"].fillna(-1).to_numpy("int64")])
            bad = np.concatenate([bad, ~frame["good"].eq(True).to_numpy(bool)])
        order = np.lexsort((ids, ts))
        ts, ids, bad = ts[order], ids[order], bad[order]
        if len(ts):
            t0 = int(ts[0]) if t0 < 0 else min(t0, int(ts[0]))
        mark = state.getCurrentWatermarkMs()
        now = max([mark * 1000, *(ts[-1:] - delay).tolist()])
        ready = int(np.searchsorted(ts, now, side="right"))
        start, began = _stable_start(ts[:ready], bad[:ready], began, quiet)
        if start < 0 and began >= 0 and began + quiet <= now:
            start = began
        result = None
        if start >= 0 and start + quiet <= t0 + limit:
            result = ("stable", start + quiet)
        elif start >= 0 or t0 + limit <= now:
            result = ("timeout", t0 + limit)
        if result is not None:
            _keep_or_forget(state, (t0, -1, last, True, [], [], []), last, forget_seconds)
            yield pd.DataFrame(
                {"node": [key[0]], "outcome": [result[0]], "at": [pd.Timestamp(result[1], unit="us")]}
            )
            return
        ts, ids, bad = ts[ready:], ids[ready:], bad[ready:]
        state.update((t0, began, last, False, ts.tolist(), ids.tolist(), bad.tolist()))
        moments = [t0 + limit, *([began + quiet] if began >= 0 else []), *ts[:1].tolist()]
        state.setTimeoutTimestamp(max(-(-min(moments) // 1000), mark + 1))

    node_type = events.schema["node"].dataType.simpleString()
    return (
        events.withWatermark("ts", f"{delay_seconds} seconds")
        .groupBy("node")
        .applyInPandasWithState(
            decide,
            f"node {node_type}, outcome string, at timestamp",
            _STABLE_STATE,
            "append",
            "EventTimeTimeout",
        )
    )


def _keep_or_forget(state, value: tuple, last: int, forget_seconds: int) -> None:
    """Keep a decided key until the watermark is so far past its *last* event that it is forgotten.

    Whatever comes later than that is at least as far from the last event, as older rows are dropped.
    """
    mark, due = state.getCurrentWatermarkMs(), last // 1000 + forget_seconds * 1000 + 1
    if due <= mark:
        if state.exists:
            state.remove()
        return
    state.update(value)
    state.setTimeoutTimestamp(due)


def retry_stream(
    attempts: DataFrame, budget_seconds: int, delay_seconds: int = 60, forget_seconds: int = FORGET_SECONDS
) -> DataFrame:
    """Streaming form of ``retry_outcome`` over ``(key, ts TIMESTAMP, ok)``.

    The state is three timestamps, so a key may have any number of attempts.  Decided
    keys are forgotten as in :func:`stable_stream`.
    """
    budget = budget_seconds * 1_000_000

    def decide(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        t0, hit, last, done = state.get if state.exists else (-1, -1, -1, False)
        for frame in frames if not state.hasTimedOut else ():
            ts = _micros(frame["ts"])
            last = max([last, *([int(ts.max())] if len(ts) else [])])
            if done:
                continue
            ok = ts[frame["ok"].eq(True).to_numpy(bool)]
            if len(ts):
                t0 = int(ts.min()) if t0 < 0 else min(t0, int(ts.min()))
            if len(ok):
                hit = int(ok.min()) if hit < 0 else min(hit, int(ok.min()))
        if done:
            _keep_or_forget(state, (t0, hit, last, True), last, forget_seconds)
            return
        now = state.getCurrentWatermarkMs() * 1000
        in_time = 0 <= hit <= t0 + budget
        if (in_time and hit <= now) or t0 + budget <= now:
            _keep_or_forget(state, (t0, hit, last, True), last, forget_seconds)
            outcome, at = ("success", hit) if in_time else ("gave up", t0 + budget)
            yield pd.DataFrame(
                {"key": [key[0]], "outcome": [outcome], "at": [pd.Timestamp(at, unit="us")]}
            )
            return
        state.update((t0, hit, last, False))
        moment = min(t0 + budget, hit) if in_time else t0 + budget
        state.setTimeoutTimestamp(max(-(-moment // 1000), now // 1000 + 1))

    key_type = attempts.schema["key"].dataType.simpleString()
    return (
        attempts.withWatermark("ts", f"{delay_seconds} seconds")
        .groupBy("key")
        .applyInPandasWithState(
            decide,
            f"key {key_type}, outcome string, at timestamp",
            _RETRY_STATE,
            "append",
            "EventTimeTimeout",
        )
    )
