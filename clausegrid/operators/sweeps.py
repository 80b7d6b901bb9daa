"""Running values over ordered rows of a key in two steps, so that no key needs a task of its own.

Rows are dealt into ranges of (key, order). Within a range a window runs on; what
the ranges of a key add up to is one row each, over which a second window runs.
Sequential operators are cut where nothing carries over, by such running values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.sources.tables import cut

#: Rows of a range, about.
RANGE_ROWS = 100_000


def in_ranges(rows: DataFrame, keys: list[str], order: list[str], range_rows: int = 0) -> DataFrame:
    """Rows with _range, which rises with keys and order; a range holds rows of equal ranks together. Written down, since ranges are drawn from a sample."""
    parts = max(1, -(-rows.count() // (range_rows or RANGE_ROWS)))
    return cut(rows.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()))


def running(rows: DataFrame, keys: list[str], order: list[str], name: str, value: Column, how: str = "sum", own: bool = True) -> DataFrame:
    """Rows of in_ranges() with the sum or max of a value over a key's rows so far, the own row included if ``own``.

    Rows of equal order are taken one after another; nulls do not count, and the
    value is null before any.
    """
    by = {"sum": F.sum, "max": F.max}[how]
    last = Window.currentRow if own else -1
    within = by(value).over(Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, last))
    totals = rows.groupBy(*keys, "_range").agg(by(value).alias("_total"))
    before = by("_total").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), before.alias("_carried"))
    match = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.withColumn("_within", within).join(carried, match).drop("_r", *(f"_k{i}" for i in range(len(keys))))
    either = F.coalesce("_within", "_carried")
    both = F.col("_within") + F.col("_carried") if how == "sum" else F.greatest("_within", "_carried")
    return joined.withColumn(name, F.coalesce(both, either)).drop("_within", "_carried")


def stretches(rows: DataFrame, keys: list[str], order: list[str], start: Column, stop: Column, range_rows: int = 0) -> DataFrame:
    """Rows with stretch, from 1: a new one begins where nothing before reaches beyond a row's start."""
    ranged = in_ranges(rows, keys, order, range_rows)
    reach = running(ranged, keys, order, "_reach", stop, "max", own=False)
    opens = F.col("_reach").isNull() | (start >= F.col("_reach"))
    return running(reach.withColumn("_opens", opens.cast("int")), keys, order, "stretch", F.col("_opens")).drop("_reach", "_opens", "_range")


def parallelism(steps: DataFrame, tolerance: float = 0.1, range_rows: int = 0) -> DataFrame:
    """trace and parallel: how many lanes its steps need at once, by a sweep over starts and ends.

    A lane is free from ``tolerance`` before its step's end; a step that is no
    longer than that takes a lane for itself only. Needs trace, step, start, stop.
    """
    free = F.greatest(F.col("stop") - tolerance, F.col("start"))
    lasts = free > F.col("start")
    begin = F.struct(F.col("start").alias("at"), F.lit(1).alias("kind"), F.when(lasts, 1).otherwise(0).alias("change"), F.when(lasts, 0).otherwise(1).alias("alone"))
    end = F.struct(free.alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("change"), F.lit(0).alias("alone"))
    marks = steps.select("trace", "step", F.explode(F.when(lasts, F.array(begin, end)).otherwise(F.array(begin))).alias("m")).select("trace", "step", "m.*")
    order = ["at", "kind", "step"]
    swept = running(in_ranges(marks, ["trace"], order, range_rows), ["trace"], order, "open", F.col("change"))
    return swept.groupBy("trace").agg(F.max(F.when(F.col("kind") == 1, F.col("open") + F.col("alone"))).cast("int").alias("parallel"))
