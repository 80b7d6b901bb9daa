"""Running values, lanes and quotas of one key over many ranges, against loops."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from clausegrid.operators import events, sweeps


def brute_lanes(steps: list[tuple]) -> dict[tuple, int]:
    out, ends = {}, {}
    for trace, step, start, stop in sorted(steps, key=lambda s: (str(s[0]), s[2], s[1])):
        own = ends.setdefault(trace, [])
        lane = next((i for i, e in enumerate(own) if start >= e - 0.1), len(own))
        own[lane : lane + 1] = [stop]
        out[trace, step] = lane
    return out


def made(seed: int) -> list[tuple]:
    r = random.Random(seed)
    steps, at = [], 0.0
    for n in range(400):
        at += r.choice([0.0, 0.0, 1.0, 2.5, 30.0])
        steps.append((r.choice(["hot", "hot", "hot", "b", None]), n, at, at + r.choice([0.0, 0.05, 1.0, 4.0, 12.0])))
    return steps


@pytest.mark.parametrize("size", [100_000, 25])
def test_running_values(spark: SparkSession, size: int) -> None:
    r = random.Random(1)
    rows = [(r.choice(["a", "a", None]), r.randrange(40), n, r.choice([None, r.randrange(100)])) for n in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, n int, v int")
    ranged = sweeps.in_ranges(df, ["k"], ["t", "n"], size)
    assert (ranged.select("_range").distinct().count() > 5) == (size == 25)
    out = sweeps.running(ranged, ["k"], ["t", "n"], "s", F.col("v"))
    out = sweeps.running(out, ["k"], ["t", "n"], "m", F.col("v"), "max", own=False)
    got = {x["n"]: (x["s"], x["m"]) for x in out.collect()}
    seen: dict = {}
    for k, _, n, v in sorted(rows, key=lambda x: (str(x[0]), x[1], x[2])):
        before = seen.setdefault(k, [])
        want_max = max(before, default=None)
        if v is not None:
            before.append(v)
        assert got[n] == (sum(before) if before else None, want_max)


@pytest.mark.parametrize("size", [100_000, 20])
def test_lanes_and_parallelism(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, size: int) -> None:
    monkeypatch.setattr(sweeps, "RANGE_ROWS", size)
    steps = made(3)
    df = spark.createDataFrame(steps, "trace string, step int, start double, stop double").repartition(4)
    want = brute_lanes(steps)
    assert {(x["trace"], x["step"]): x["lane"] for x in events.lanes(df).collect()} == want
    most: dict = {}
    for (trace, _), lane in want.items():
        most[trace] = max(most.get(trace, 0), lane + 1)
    assert {x["trace"]: x["parallel"] for x in sweeps.parallelism(df).collect()} == most
    cut = sweeps.stretches(df, ["trace"], ["start", "step"], F.col("start"), F.col("stop") - 0.1)
    assert cut.where("trace = 'hot'").select("stretch").distinct().count() > 10
    assert events.lanes(df.limit(0)).count() == 0 and sweeps.parallelism(df.limit(0)).count() == 0


@pytest.mark.parametrize("in_memory", [False, True])
def test_quota_of_one_key_in_many_stretches(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, in_memory: bool) -> None:
    monkeypatch.setattr(sweeps, "RANGE_ROWS", 30)
    r = random.Random(5)
    at, rows = datetime(2024, 1, 1), []
    for n in range(300):
        at += timedelta(seconds=r.choice([0, 20, 400, 3600, 3601, 9000]))
        rows.append((r.choice([1, 1, 1, 2]), at, n))
    got = {x["event_id"]: (x["count"], x["allowed"]) for x in events.anchored_quota(spark.createDataFrame(rows, "key long, ts timestamp, event_id long"), 3, 3600, in_memory).collect()}
    state: dict = {}
    for key, ts, n in rows:
        reset, count = state.get(key, (ts - timedelta(1), 0))
        if ts > reset:
            reset, count = ts + timedelta(seconds=3600), 0
        allowed = count < 3
        count = min(count + 1, 3 if in_memory else 4)
        state[key] = (reset, count)
        assert got[n] == (count, allowed)
