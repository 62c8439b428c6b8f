"""Admission as streaming state: one counter a key, with a timer that clears it.

A throttle window starts at a key's first request after the last window ran out, which is
neither a tumbling nor a session window; a quota is a counter of one KST day. Both are held
by ``applyInPandasWithState``. Requests of a micro-batch are taken in (time, id) order. With
a watermark the state of a key goes once event time has passed the end of its window or day,
so state is bounded by the keys active in one window; requests later than the watermark are
dropped by Spark. Without one (``timeout="NoTimeout"``) nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _sorted(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    every = list(parts)
    return pd.concat(every).sort_values(["ms", "id"], kind="stable") if every else pd.DataFrame({"ms": [], "id": []})


def throttle_stream(requests: DataFrame, window_ms: int, most: int, watermark: str | None = None) -> DataFrame:
    """requests (key, ms, id[, ts]) -> (key, id, denied, retry_after_ms)."""

    def run(key, parts, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        rows = _sorted(parts)
        ids, denied, retry = [], [], []
        for t, i in zip(rows.ms, rows.id):
            t = int(t)
            if start is None or t >= start + window_ms:
                start, n = t, 0
            n += 1
            ids.append(int(i)), denied.append(n > most), retry.append(start + window_ms - t if n > most else 0)
        state.update((start, n))
        if watermark:
            state.setTimeoutTimestamp(max(start + window_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]] * len(ids), "id": ids, "denied": denied, "retry_after_ms": retry})

    df = requests.withWatermark("ts", watermark) if watermark else requests
    mode = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout
    return df.groupBy("key").applyInPandasWithState(run, "key bigint, id bigint, denied boolean, retry_after_ms bigint", "start bigint, n bigint", "append", mode)


def quota_stream(requests: DataFrame, limit: int, watermark: str | None = None) -> DataFrame:
    """requests (key, day, ms, id, chars[, ts]) -> (key, day, id, allowed, used)."""

    def run(key, parts, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        rows = _sorted(parts)
        ids, ok, sums = [], [], []
        for i, c in zip(rows.id, rows.chars):
            fits = used + int(c) <= limit
            used += int(c) if fits else 0
            ids.append(int(i)), ok.append(fits), sums.append(used)
        state.update((used,))
        if watermark:
            ends = int((pd.Timestamp(key[1]) + pd.Timedelta(hours=15)).timestamp() * 1000)
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        n = len(ids)
        yield pd.DataFrame({"key": [key[0]] * n, "day": [key[1]] * n, "id": ids, "allowed": ok, "used": sums})

    df = requests.withWatermark("ts", watermark) if watermark else requests
    mode = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout
    return df.groupBy("key", "day").applyInPandasWithState(run, "key bigint, day string, id bigint, allowed boolean, used bigint", "used bigint", "append", mode)


def as_requests(events: DataFrame) -> DataFrame:
    """The events table, batch or stream, as requests."""
    from parchment.operators.admission import kst_day

    ts = F.col("ts").cast("timestamp")
    return events.select(F.col("user_id").alias("key"), ts.alias("ts"), F.unix_millis(ts).alias("ms"), F.col("event_id").alias("id"), kst_day(F.col("ts")).alias("day"), F.round(F.col("value") * 10).cast("bigint").alias("chars"))
