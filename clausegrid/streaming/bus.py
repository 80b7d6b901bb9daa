"""Events of a key for readers that may come late, and a sink that keeps each batch once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: Events that end a key's story.
FINAL = ("complete", "error")
#: A key is forgotten so long after its end, and a key without an end so long after its last row.
KEEP_MS, QUIET_MS = 10 * 60 * 1000, 24 * 60 * 60 * 1000
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DELIVERED = "reader long, n int, event_id long, status string, ms long"


class _Bus(StatefulProcessor):
    """A key's events so far, the readers that wait for more, and when it is forgotten."""

    def __init__(self, final: tuple[str, ...], keep_ms: int, quiet_ms: int):
        self.final, self.keep_ms, self.quiet_ms = final, keep_ms, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "event_id long, status string, ms long")
        self.readers = handle.getListState("readers", "reader long")
        self.until = handle.getValueState("until", "ms long, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(e) for e in self.events.get()]
        waiting = [r[0] for r in self.readers.get()]
        until, ended = self.until.get() if self.until.exists() else (None, False)
        new, out, last = [], [], None
        pdf = pd.concat(rows).sort_values(["ms", "is_reader", "id"])
        for ms, is_reader, own, status in pdf[["ms", "is_reader", "id", "status"]].itertuples(index=False):
            last = int(ms)
            if is_reader:
                for n, event in enumerate([*held, *new], 1):
                    out.append((int(own), n, *event))
                    if event[1] in self.final:
                        break
                else:
                    waiting.append(int(own))
                continue
            event = (int(own), status, last)
            new.append(event)
            out += [(r, len(held) + len(new), *event) for r in waiting]
            if status in self.final:
                waiting = []
                if not ended:
                    ended = True
                    until = self._forget_at(until, last + self.keep_ms)
        if not ended and last is not None:
            until = self._forget_at(until, last + self.quiet_ms)
        if new:
            self.events.appendList(new)
        self.readers.put([(r,) for r in waiting]) if waiting else self.readers.clear()
        self.until.update((until, ended))
        yield pd.DataFrame([(*key, *x) for x in out], columns=["key", "reader", "n", "event_id", "status", "ms"])

    def _forget_at(self, before: int | None, at: int) -> int:
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        return at

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.events, self.readers, self.until):
            state.clear()
        yield pd.DataFrame([], columns=["key", "reader", "n", "event_id", "status", "ms"])

    def close(self) -> None:
        pass


def delivered(rows: DataFrame, final: tuple[str, ...] = FINAL, late: str = "1 minute", keep_ms: int = KEEP_MS, quiet_ms: int = QUIET_MS) -> DataFrame:
    """key, reader, n, event_id, status and ms: what each reader of a key is sent, as a stream.

    Needs key, ts, is_reader, id, status: an event with its id and status, or a
    reader (its id, no status) that begins to read. A reader first gets the
    key's events so far and then each new one, up to the first final one. The
    rows of a micro-batch are taken in order of time, events before readers;
    rows later than the watermark are dropped by design. Ten minutes after its
    first final event, by the time of events, a key is forgotten, and one that
    does not end a day after its last row, so that the state holds recent keys only.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    own = rows.withWatermark("ts", late).select("key", "ts", F.unix_millis("ts").alias("ms"), "is_reader", F.col("id").cast("long").alias("id"), "status")
    kind = rows.schema["key"].dataType.simpleString()
    return own.groupBy("key").transformWithStateInPandas(_Bus(final, keep_ms, quiet_ms), f"key {kind}, {_DELIVERED}", "Append", "EventTime")


def as_message(event: Column) -> Column:
    """An event as one message of a text stream."""
    return F.concat(F.lit("data: "), F.to_json(event), F.lit("\n\n"))


def pushed(stream: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer that puts each micro-batch into a folder of its own, batch_id=n, over what an earlier try has left there.

    A batch that is repeated after a failure has the same number, so that its
    rows are there once.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def until_first_end(rows: DataFrame, keys: list[str], order: list[str], final: tuple[str, ...] = FINAL) -> DataFrame:
    """Rows of each key up to the first final one, that one included. Needs status; nulls do not end."""
    ends = F.coalesce(F.col("status").isin(*final), F.lit(False)).cast("int")
    before = F.sum(ends).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_ends", F.coalesce(before, F.lit(0))).where("_ends = 0").drop("_ends")


def with_polled_ends(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Events (key, n, status) up to the first final one, and for jobs (key, state) that are done but have no events the event that says so.

    A complete job ends with ``complete``, a failed one with ``error``; others
    have nothing to say.
    """
    heard = until_first_end(events.select("key", "n", "status"), ["key"], ["n"])
    done = F.when(F.col("state") == "complete", "complete").when(F.col("state") == "failed", "error")
    silent = jobs.join(events.select("key").distinct(), "key", "left_anti").select("key", F.lit(0).cast(events.schema["n"].dataType).alias("n"), done.alias("status"))
    return heard.unionByName(silent.where("status is not null"))
