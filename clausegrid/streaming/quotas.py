"""Event quotas and counts as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests of each user in tumbling windows; rows later than the watermark are dropped by design. Needs ts, user_id."""
    kept = events.withWatermark("ts", late)
    counts = kept.groupBy(F.window("ts", window), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), "user_id", "n")


def anchored_quota_stream(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """event_id, count and allowed under windows anchored at a key's first request. Needs key, ts, event_id.

    The state of a key is its window's end and count. Rows of a micro-batch are
    taken in order of time; what a later batch brings is taken as it comes. A
    key without requests for twice its window is forgotten, so that the state
    does not grow with all keys that ever were.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        reset, count = state.get if state.exists else (0, 0)
        rows = pd.concat(batches).sort_values(["us", "event_id"])
        out = []
        for us, event in zip(rows["us"], rows["event_id"], strict=True):
            if count == 0 or us > reset:
                reset, count = int(us) + seconds * 1_000_000, 0
            count = min(count + 1, limit + 1)
            out.append((event, count, count <= limit))
        state.update((reset, count))
        state.setTimeoutDuration(2 * seconds * 1000)
        yield pd.DataFrame(out, columns=["event_id", "count", "allowed"])

    rows = events.select("key", F.unix_micros("ts").alias("us"), "event_id")
    return rows.groupBy("key").applyInPandasWithState(step, "event_id long, count int, allowed boolean", "reset long, count int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def replay(events: DataFrame) -> DataFrame:
    """Events with those delivered twice left out, within the watermark. Needs ts, event_id."""
    return events.withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["event_id"])


def tokens_to_lines(chunks: DataFrame) -> DataFrame:
    """key, n (from 0) and line of a text that came in pieces: whole lines in order, empty ones too; what follows the last break only if it is not blank. Needs key, seq, piece."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: F.coalesce(x["piece"], F.lit(""))), "")
    lines = F.split("text", "\n", -1)
    whole = F.when(F.trim(F.element_at(lines, -1)) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return chunks.groupBy("key").agg(text.alias("text")).select("key", F.posexplode(whole).alias("n", "line"))
