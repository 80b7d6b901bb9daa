"""Streams: the event bus with late readers, the sink under a repeated batch, counts, repeats, and lines of pieces."""

from __future__ import annotations

import os
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.streaming import bus, quotas

START = datetime(2024, 1, 1)
ROWS = "key string, ts timestamp, is_reader boolean, id long, status string"


def at(minutes: float) -> datetime:
    return START + timedelta(minutes=minutes)


def files(spark: SparkSession, path: Path, schema: str, batches: list[list[tuple]]) -> DataFrame:
    """A stream that reads one batch after another."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path / "made" / str(n)))
        (path / "in").mkdir(exist_ok=True)
        part = next((path / "made" / str(n)).glob("part-*.parquet"))
        os.rename(part, path / "in" / f"{n:03d}.parquet")
        os.utime(path / "in" / f"{n:03d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))


def test_late_readers_get_all_events_up_to_the_first_end(spark: SparkSession, tmp_path) -> None:
    event = lambda k, m, i, s: (k, at(m), False, i, s)
    reader = lambda k, m, r: (k, at(m), True, r, None)
    batches = [
        [event("a", 0, 1, "start"), event("a", 1, 2, "step"), event("b", 0, 9, "start")],
        [reader("a", 2, 100), event("a", 3, 3, "step")],
        [event("a", 4, 4, "complete"), event("a", 5, 5, "step"), event("a", 5, 6, "error"), reader("b", 4, 300)],
        [reader("a", 6, 200)],
        [event("c", 60, 20, "start")],
        [event("c", 61, 21, "step")],
        [reader("a", 62, 400), event("b", 62, 10, "error")],
    ]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        query = bus.pushed(bus.delivered(files(spark, tmp_path, ROWS, batches)), str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(240)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    sent = lambda r: sorted((x["n"], x["event_id"], x["status"]) for x in rows if x["reader"] == r)
    assert sent(100) == sent(200) == [(1, 1, "start"), (2, 2, "step"), (3, 3, "step"), (4, 4, "complete")]
    assert sent(300) == [(1, 9, "start"), (2, 10, "error")]
    assert sent(400) == []  # ten minutes after its end the key is forgotten


def test_a_repeated_batch_is_there_once(spark: SparkSession, tmp_path) -> None:
    schema = "key string, n int"
    stream = files(spark, tmp_path, schema, [[("a", i) for i in range(5)], [("b", i) for i in range(5)]])
    run = lambda: bus.pushed(stream, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    assert run()
    first = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("key", "n").collect()))
    commits = tmp_path / "state" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        if (commits / name).exists():
            os.rename(commits / name, tmp_path / f"lost-{name.strip('.')}")
    assert run()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("key", "n").collect())) == first
    assert len(first) == 10


def test_messages_and_ends(spark: SparkSession) -> None:
    rows = spark.createDataFrame([("a", 1, "step"), ("a", 2, "complete"), ("a", 3, "error"), ("b", 1, None), ("b", 2, "step")], "key string, n int, status string")
    jobs = spark.createDataFrame([("a", "failed"), ("b", "complete"), ("c", "failed"), ("d", "complete"), ("e", "pending")], "key string, state string")
    got = sorted(tuple(str(x) for x in r) for r in bus.with_polled_ends(rows, jobs).collect())
    assert got == [("a", "1", "step"), ("a", "2", "complete"), ("b", "1", "None"), ("b", "2", "step"), ("c", "0", "error"), ("d", "0", "complete")]
    text = rows.where("n = 3").select(bus.as_message(F.struct("key", "n")).alias("m")).first()["m"]
    assert text == 'data: {"key":"a","n":3}\n\n'


def test_counts_and_repeats(spark: SparkSession, tmp_path) -> None:
    schema = "ts timestamp, user_id long, event_id long"
    batches = [[(at(1), 1, 1), (at(2), 1, 2), (at(61), 2, 3)], [(at(2), 1, 2), (at(62), 2, 4), (at(240), 1, 5)], [(at(241), 3, 7)], [(at(3), 1, 6)]]
    stream = files(spark, tmp_path, schema, batches)
    counts = quotas.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    once = quotas.replay(stream).writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "r")).start()
    assert counts.awaitTermination(120) and once.awaitTermination(120)
    got = {(r["start"], r["user_id"]): r["n"] for r in spark.table("counts").collect()}
    assert got == {(at(0), 1): 3, (at(60), 2): 2}  # the late row of the last batch is dropped
    assert sorted(r["event_id"] for r in spark.table("once").collect()) == [1, 2, 3, 4, 5, 7]


def test_lines_of_pieces(spark: SparkSession) -> None:
    rows = [("a", 2, "lo\n\nwor"), ("a", 1, "hel"), ("a", 3, "ld\nrest"), ("b", 1, "x\n"), ("b", 2, " "), ("c", 1, None)]
    got = quotas.tokens_to_lines(spark.createDataFrame(rows, "key string, seq int, piece string"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 0, "hello"), ("a", 1, ""), ("a", 2, "world"), ("a", 3, "rest"), ("b", 0, "x")]
