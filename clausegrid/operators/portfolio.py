"""Aggregates over clauses and their documents.

The functions expect columns lease_id, seq (the clause's place), risk_score,
clause_type and others named in each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.functions.numbers import half_up
from clausegrid.operators.sweeps import in_ranges, running

HEAVY_WEIGHT = 1.5


def risk_level(score: Column) -> Column:
    """low up to 3, medium up to 6, high up to 8, critical beyond."""
    return F.when(score <= 3, "low").when(score <= 6, "medium").when(score <= 8, "high").otherwise("critical")


def confidence_level(x: Column) -> Column:
    """high from 0.75, medium from 0.45, else low."""
    return F.when(x >= 0.75, "high").when(x >= 0.45, "medium").otherwise("low")


def public_stats(leases: DataFrame, clauses: DataFrame) -> DataFrame:
    """Totals over leases (lease_id, score) and their clauses (lease_id, red).

    The mean score counts a lease as often as it has clauses, once if it has
    none. Clauses are counted for each lease before the join, so that the join
    has one row for each lease.
    """
    counts = clauses.groupBy("lease_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("red").alias("red"))
    joined = leases.join(counts, "lease_id", "left").select("lease_id", "score", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("red", F.lit(0)).alias("red"))
    weight = F.greatest(F.col("n"), F.lit(1))
    return joined.agg(
        F.count_distinct("lease_id").alias("total_leases"),
        half_up(F.sum(F.col("score") * weight).cast("double") / F.sum(weight), 1).alias("avg_risk_score"),
        F.sum("n").alias("total_clauses"),
        F.sum("red").alias("total_red_flags"),
    )


def overall_risk(clauses: DataFrame) -> DataFrame:
    """For each lease_id the weighted mean score, its blend with the maximum, the floor of void clauses, and the level.

    Needs heavy (counts HEAVY_WEIGHT times) and void (unenforceable).
    """
    w = F.when(F.col("heavy"), HEAVY_WEIGHT).otherwise(1.0)
    per = clauses.groupBy("lease_id").agg(
        half_up(F.sum(w * F.col("risk_score")) / F.sum(w), 1).alias("base"),
        F.max("risk_score").alias("top"),
        F.count_if("void").alias("n_void"),
    )
    blended = F.when(F.col("top") >= 8, half_up(0.6 * F.col("base") + 0.4 * F.col("top"), 1)).otherwise(F.col("base"))
    floor = F.when(F.col("n_void") >= 4, 9.5).when(F.col("n_void") == 3, 8.5).when(F.col("n_void") == 2, 7.5).otherwise(0.0)
    return per.withColumn("overall", F.greatest(blended, floor)).withColumn("level", risk_level(F.col("overall")))


def risk_distribution(clauses: DataFrame) -> DataFrame:
    """Counts and shares of each risk level for each lease_id."""
    levels = ("low", "medium", "high", "critical")
    per = clauses.withColumn("level", risk_level(F.col("risk_score"))).groupBy("lease_id")
    out = per.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("level") == x).alias(x) for x in levels))
    return out.withColumns({f"{x}_share": half_up(F.col(x) * 100.0 / F.col("n"), 2) for x in levels})


def ranked(clauses: DataFrame, k: int | None, least: float | None = None) -> DataFrame:
    """The k clauses of each lease with the highest scores, all without a k, nulls last, ties in clause order."""
    if least is not None:
        clauses = clauses.where(F.col("risk_score") >= least)
    place = F.row_number().over(Window.partitionBy("lease_id").orderBy(F.desc_nulls_last("risk_score"), "seq"))
    placed = clauses.withColumn("place", place)
    return placed if k is None else placed.where(F.col("place") <= k)


def percentile_among_peers(target: DataFrame, pool: DataFrame, least: int = 10) -> DataFrame:
    """Where each target (id, grp, x) stands among the other rows of its group in the pool.

    Returns n, percentile, mean and median. Below ``least`` peers all but n are
    null. Ranks come from running counts over the distinct values of each group,
    made in ranges, so that neither a target meets all its peers nor a group one
    task.
    """
    values = pool.groupBy("grp", "x").agg(F.count(F.lit(1)).alias("c"))
    ranged = in_ranges(values.where("grp is not null"), ["grp"], ["x"])
    below = running(ranged, ["grp"], ["x"], "upto", F.col("c")).select("grp", "x", "c", "upto")
    groups = values.groupBy("grp").agg(F.sum("c").alias("all"), F.sum(F.col("x") * F.col("c")).alias("total"))
    # The middle values are the first ones that half of the rows do not exceed.
    middle = below.join(groups.select("grp", "all"), "grp").groupBy("grp").agg(*(F.min(F.when(F.col("upto") >= rank, F.col("x"))).cast("double").alias(name) for name, rank in (("low", F.expr("(all + 1) div 2")), ("high", F.expr("all div 2 + 1")))))
    groups = groups.join(middle.select("grp", ((F.col("low") + F.col("high")) / 2).alias("median")), "grp")
    joined = target.join(below.select("grp", "x", "upto"), ["grp", "x"]).join(groups, "grp")
    n = F.col("all") - 1
    enough = n >= least
    return joined.select(
        "id",
        "grp",
        n.alias("n"),
        F.when(enough, half_up((F.col("upto") - 1) * 100.0 / n).cast("int")).alias("percentile"),
        F.when(enough, half_up((F.col("total") - F.col("x")).cast("double") / n, 1)).alias("mean"),
        F.when(enough, half_up(F.col("median"), 1)).alias("median"),
    )


def confusion(rows: DataFrame) -> DataFrame:
    """Counts and ratios of predicted against actual (booleans); empty denominators give 1 for precision and recall, 0 else."""
    p, a = F.col("predicted"), F.col("actual")
    c = rows.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))

    def ratio(x: Column, y: Column, empty: float) -> Column:
        return F.when(y > 0, x.cast("double") / y).otherwise(empty)

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    c = c.withColumns({"precision": ratio(tp, tp + fp, 1.0), "recall": ratio(tp, tp + fn, 1.0), "fpr": ratio(fp, fp + tn, 0.0)})
    both = F.col("precision") + F.col("recall")
    return c.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))
