"""Pairs of clauses of one lease that may contradict each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def same_type_pairs(clauses: DataFrame) -> DataFrame:
    """All pairs of clauses of one lease and type, the earlier one first. Needs lease_id, clause_type, seq."""
    a = clauses.select("lease_id", "clause_type", F.col("seq").alias("a"))
    b = clauses.select("lease_id", "clause_type", F.col("seq").alias("b"))
    return a.join(b, ["lease_id", "clause_type"]).where("a < b")


def cross_type_pairs(clauses: DataFrame, type_pairs: list[tuple[str, str]]) -> DataFrame:
    """For each given pair of types the pair of the first clauses of those types in each lease."""
    spark = clauses.sparkSession
    first = clauses.groupBy("lease_id", "clause_type").agg(F.min("seq").alias("seq"))
    wanted = F.broadcast(spark.createDataFrame(list({frozenset(p): p for p in type_pairs}.values()), "left_type string, right_type string"))
    a = first.select("lease_id", F.col("clause_type").alias("left_type"), F.col("seq").alias("a")).join(wanted, "left_type")
    b = first.select("lease_id", F.col("clause_type").alias("right_type"), F.col("seq").alias("b"))
    return a.join(b, ["lease_id", "right_type"]).select("lease_id", "left_type", "right_type", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def present_and_missing(found: DataFrame, required: list[tuple[int, str]]) -> DataFrame:
    """For each lease which required types it has, in order, which it lacks, and the share it has. Needs lease_id, clause_type."""
    spark = found.sparkSession
    want = F.broadcast(spark.createDataFrame(required, "place int, clause_type string"))
    have = found.select("lease_id", "clause_type").distinct().join(want, "clause_type")
    per = have.groupBy("lease_id").agg(F.sort_array(F.collect_set("place")).alias("have"))
    every = F.array(*(F.lit(p) for p, _ in required))
    leases = found.select("lease_id").distinct().join(per, "lease_id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<int>")))
    return leases.select("lease_id", "have", F.array_except(every, "have").alias("missing"), (F.floor(F.size("have") * 100.0 / len(required) + 0.5) / 100).alias("coverage"))
