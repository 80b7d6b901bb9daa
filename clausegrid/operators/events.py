"""Quotas and traces over event logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.functions.numbers import half_up
from clausegrid.operators.sweeps import in_ranges, running, stretches


def sliding_quota(events: DataFrame, hourly: int, daily: int) -> DataFrame:
    """Adds in_hour and in_day, earlier requests of the user within the window, allowed, and remaining. Needs user_id, ts, event_id."""
    out = _with_earlier(events, {"user": F.col("user_id").cast("string")}, {"in_hour": ("user", 3600), "in_day": ("user", 86400)})
    ok = (F.col("in_day") < daily) & (F.col("in_hour") < hourly)
    left = F.greatest(F.lit(0), F.least(F.lit(hourly) - F.col("in_hour") - 1, F.lit(daily) - F.col("in_day") - 1))
    return out.withColumns({"allowed": ok, "remaining": left})


# Requests in a day and an hour that users and guests may make, and in a day about one lease.
USER_LIMITS, GUEST_LIMITS, LEASE_LIMIT = (50, 15), (10, 5), 30
# Requests in an hour by route.
ROUTE_LIMITS = {
    "report_get": 60, "report_post": 20, "report_patch": 30, "report_delete": 20, "job": 120, "retry": 5, "pdf_url": 60,
    "feedback": 20, "negotiation": 10, "stream": 30, "rent_increase": 30, "eviction": 30, "deposit_fees": 30,
}
# Uploads in a day by users and by guests.
UPLOAD_LIMITS = (5, 3)


def _with_earlier(rows: DataFrame, keys: dict[str, Column], windows: dict[str, tuple[str, int]]) -> DataFrame:
    """Rows with a column for each window (key, seconds), keys being strings: how many rows of the key came within so many seconds before, in order of time and event_id.

    A row is a mark of each of its keys at its time, and one at each window's
    start; running counts of the rows up to its marks differ by what lies between.
    So the work grows with the rows, not with what a window holds, and no key
    needs a task of its own. Needs ts, event_id.
    """
    us = F.unix_micros("ts")
    mark = lambda key, at, name: F.struct(F.lit(key).alias("_of"), keys[key].alias("_key"), at.alias("_at"), F.lit(int(not name)).alias("_real"), F.lit(name).alias("_name"))
    marks = [mark(key, us, "") for key in keys] + [mark(key, us - seconds * 1_000_000, name) for name, (key, seconds) in windows.items()]
    own = F.struct(*(F.col(c) for c in rows.columns))
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    split = numbered.select("event_id", own.alias("_own"), "_row", F.explode(F.array(*marks)).alias("_m"))
    # Only the first mark carries the row.
    split = split.select("event_id", "_row", "_m.*", F.when((F.col("_m._real") == 1) & (F.col("_m._of") == next(iter(keys))), F.col("_own")).alias("_own"))
    by, order = ["_of", "_key"], ["_at", "_real", "event_id", "_row"]
    counted = running(in_ranges(split, by, order), by, order, "_n", F.col("_real"), own=False)
    n = F.coalesce("_n", F.lit(0))
    at = lambda key, name: F.max(F.when((F.col("_of") == key) & (F.col("_name") == name), n))
    found = counted.groupBy("_row").agg(F.first("_own", ignorenulls=True).alias("_own"), *((at(key, "") - at(key, name)).alias(name) for name, (key, _) in windows.items()))
    return found.select("_own.*", *windows)


def chat_quota(requests: DataFrame) -> DataFrame:
    """Adds allowed, reason and remaining by the limits of a user or guest in a day and an hour and of a lease in a day.

    Needs event_id, ts, user_id (null for guests), ip, lease_id. The first
    limit that is met in this order is the reason.
    """
    user = F.coalesce(F.concat(F.lit("u"), "user_id"), F.concat(F.lit("g"), "ip"))
    rows = requests.withColumn("_guest", F.col("user_id").isNull())
    rows = _with_earlier(rows, {"who": user, "lease": F.col("lease_id").cast("string")}, {"_day": ("who", 86400), "_hour": ("who", 3600), "_lease": ("lease", 86400)})
    limit = lambda k: F.when(F.col("_guest"), GUEST_LIMITS[k]).otherwise(USER_LIMITS[k])
    who = F.when(F.col("_guest"), "ip").otherwise("user")
    reason = F.when(F.col("_day") >= limit(0), F.concat(F.lit("daily_"), who, F.lit("_limit"))).when(F.col("_hour") >= limit(1), F.concat(F.lit("hourly_"), who, F.lit("_limit"))).when(F.col("_lease") >= LEASE_LIMIT, "per_lease_limit")
    left = F.greatest(F.lit(0), F.least(limit(0) - F.col("_day") - 1, limit(1) - F.col("_hour") - 1, LEASE_LIMIT - F.col("_lease") - 1))
    out = rows.withColumns({"reason": reason, "allowed": reason.isNull(), "remaining": F.when(reason.isNull(), left).otherwise(0)})
    return out.drop("_guest", "_day", "_hour", "_lease")


def upload_quota(requests: DataFrame) -> DataFrame:
    """Adds allowed by the uploads in a day. Needs event_id, ts, user_id (null for guests), ip."""
    user = F.coalesce(F.concat(F.lit("u"), "user_id"), F.concat(F.lit("g"), "ip"))
    rows = _with_earlier(requests, {"who": user}, {"_day": ("who", 86400)})
    limit = F.when(F.col("user_id").isNull(), UPLOAD_LIMITS[1]).otherwise(UPLOAD_LIMITS[0])
    return rows.withColumn("allowed", F.col("_day") < limit).drop("_day")


def route_quota(requests: DataFrame) -> DataFrame:
    """Adds allowed by each route's limit in an hour; unknown routes have none. Needs event_id, ts, key, route."""
    limits = F.create_map(*(F.lit(x) for kv in ROUTE_LIMITS.items() for x in kv))
    rows = _with_earlier(requests, {"both": F.to_json(F.struct("key", "route"))}, {"_hour": ("both", 3600)})
    return rows.withColumn("allowed", F.coalesce(F.col("_hour") < F.element_at(limits, F.col("route")), F.lit(True))).drop("_hour")


def fail_open(checked: DataFrame, open_: bool = True) -> DataFrame:
    """Requests whose check gave no answer pass, or not if ``open_`` is false. Needs allowed."""
    return checked.withColumn("allowed", F.coalesce("allowed", F.lit(open_)))


def anchored_quota(events: DataFrame, limit: int, seconds: int, in_memory: bool = False) -> DataFrame:
    """event_id, count and allowed under windows that start at a key's first request after the last one ended.

    A refused request counts one beyond the limit in the stored form; in memory
    the count stays at the limit. Windows are sequential, but one certainly
    begins after a pause that is longer than a window; a key's rows are cut
    there, and the stretches go through Python loops of their own, which keep
    only (count, start of the window). Needs key, ts, event_id.
    """
    rows = events.select("key", F.unix_micros("ts").alias("us"), "event_id")
    rows = stretches(rows, ["key"], ["us", "event_id"], F.col("us"), F.col("us") + seconds * 1_000_000 + 1)
    parts = rows.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "us", "event_id")
    most = limit if in_memory else limit + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, reset, count = None, 0, 0
        for pdf in batches:
            out = []
            for *k, us, e in zip(pdf["key"], pdf["stretch"], pdf["us"], pdf["event_id"], strict=True):
                if k != key or us > reset:
                    key, reset, count = k, us + seconds * 1_000_000, 0
                allowed = count < limit
                count = min(count + 1, most)
                out.append((e, count, allowed))
            yield pd.DataFrame(out, columns=["event_id", "count", "allowed"])

    return parts.mapInPandas(run, "event_id long, count int, allowed boolean")


def latest_status(events: DataFrame, final: tuple[str, ...]) -> DataFrame:
    """For each key the first final event if there is one, else the last event. Needs key, ts, event_id, status."""
    is_final = F.col("status").isin(*final)
    first_final = F.min(F.when(is_final, F.struct("ts", "event_id", "status")))
    per = events.groupBy("key").agg(first_final.alias("f"), F.max(F.struct("ts", "event_id", "status")).alias("l"))
    return per.select("key", F.coalesce("f.status", "l.status").alias("status"), F.coalesce("f.event_id", "l.event_id").alias("event_id"))


def trace_extent(steps: DataFrame) -> DataFrame:
    """trace, t0, span (1 at least), total and longest duration. Needs trace, start_ms, duration_ms."""
    end = F.max(F.col("start_ms") + F.col("duration_ms"))
    return steps.groupBy("trace").agg(
        F.min("start_ms").alias("t0"),
        F.greatest(end - F.min("start_ms"), F.lit(1)).cast("long").alias("span_ms"),
        F.sum("duration_ms").alias("total_ms"),
        F.max("duration_ms").alias("peak_ms"),
    )


def trace_geometry(steps: DataFrame) -> DataFrame:
    """Adds left_pct and width_pct (0.8 at least) of each step in its trace."""
    extent = trace_extent(steps).select("trace", "t0", "span_ms")
    joined = steps.join(extent, "trace")
    left = half_up((F.col("start_ms") - F.col("t0")) * 100.0 / F.col("span_ms"), 3)
    width = F.greatest(F.lit(0.8), half_up(F.col("duration_ms") * 100.0 / F.col("span_ms"), 3))
    return joined.withColumns({"left_pct": left, "width_pct": width}).drop("t0", "span_ms")


def virtual_offsets(steps: DataFrame) -> DataFrame:
    """Adds offset_ms: the durations of the trace's earlier steps together. Needs trace, seq, duration_ms."""
    w = Window.partitionBy("trace").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("offset_ms", F.coalesce(F.sum("duration_ms").over(w), F.lit(0)))


def lanes(steps: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """trace, step and lane by first fit: the first lane that is free when the step starts. Needs trace, step, start, stop.

    First fit is sequential, but where all lanes are free it begins anew; a
    trace's steps are cut there, and of a stretch only the lanes are kept.
    """
    rows = stretches(steps.select("trace", "step", "start", "stop"), ["trace"], ["start", "step"], F.col("start"), F.col("stop") - tolerance)
    parts = rows.repartition("trace", "stretch").sortWithinPartitions("trace", "stretch", "start", "step").select("trace", "stretch", "step", "start", "stop")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trace, ends = None, []
        for pdf in batches:
            out = []
            for t, stretch, step, start, stop in pdf.itertuples(index=False):
                if (t, stretch) != trace:
                    trace, ends = (t, stretch), []
                lane = next((i for i, e in enumerate(ends) if start >= e - tolerance), len(ends))
                ends[lane : lane + 1] = [stop]
                out.append((t, step, lane))
            yield pd.DataFrame(out, columns=["trace", "step", "lane"])

    kind = dict(steps.dtypes)
    return parts.mapInPandas(run, f"trace {kind['trace']}, step {kind['step']}, lane int")


# The category of each tool in a trace; others are unknown. Benchmarks are not shown.
CATEGORIES = {
    "parse_document": "parse",
    "detect_jurisdiction": "classify",
    "segment_clauses": "classify",
    "classify_clause": "classify",
    "lookup_statute": "rag",
    "lookup_tribunal": "rag",
    "score_risk": "score",
    "detect_contradiction": "analyse",
    "check_missing": "analyse",
    "generate_negotiation": "generate",
    "generate_report": "generate",
    "benchmark_clause": "unknown",
}
NOT_SHOWN, NARROWEST, LANE_GAP = "benchmark_clause", 0.8, 0.1


def trace_rows(steps: DataFrame) -> DataFrame:
    """trace, step, category, left_pct, width_pct and lane of the steps that are shown.

    Needs trace, step, seq, tool, start_ms, duration_ms. Where a step of a
    trace has no time, the steps of the whole trace stand one after another in
    order of seq. A step is at least 0.8 wide; lanes are by first fit in order of
    left_pct, with a tenth of slack. Null durations count as 0.
    """
    rows = steps.withColumn("_d", F.coalesce("duration_ms", F.lit(0)))
    per = rows.groupBy(F.col("trace").alias("_t")).agg(F.count_if(F.col("start_ms").isNull()).alias("_without"), F.min("start_ms").alias("_t0"), F.max(F.col("start_ms") + F.col("_d")).alias("_end"), F.sum("_d").alias("_sum"))
    timed = F.col("_without") == 0
    rows = rows.join(per.withColumn("_span", F.greatest(F.when(timed, F.col("_end") - F.col("_t0")).otherwise(F.col("_sum")), F.lit(1))), F.col("trace").eqNullSafe(F.col("_t")))
    rows = rows.where(~F.coalesce(F.col("tool") == NOT_SHOWN, F.lit(False)))
    before = F.sum("_d").over(Window.partitionBy("trace").orderBy("seq", "step").rowsBetween(Window.unboundedPreceding, -1))
    start = F.when(timed, F.col("start_ms") - F.col("_t0")).otherwise(F.coalesce(before, F.lit(0)))
    known = F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv))
    rows = rows.select("trace", "step", F.coalesce(F.try_element_at(known, F.col("tool")), F.lit("unknown")).alias("category"), (start * 100.0 / F.col("_span")).alias("left_pct"), F.greatest(F.col("_d") * 100.0 / F.col("_span"), F.lit(NARROWEST)).alias("width_pct"))
    placed = lanes(rows.select("trace", "step", F.col("left_pct").alias("start"), (F.col("left_pct") + F.col("width_pct")).alias("stop")), LANE_GAP)
    return rows.join(placed.select(F.col("trace").alias("_t"), F.col("step").alias("_s"), "lane"), F.col("trace").eqNullSafe(F.col("_t")) & (F.col("step") == F.col("_s"))).drop("_t", "_s")
