"""Rule calculators over batches: rent increases, eviction notices, deposits, fees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.functions.numbers import half_up

# The yearly guideline in percent.
GUIDELINES = (
    (2018, 1.8),
    (2019, 1.8),
    (2020, 2.2),
    (2021, 0.0),
    (2022, 1.2),
    (2023, 2.5),
    (2024, 2.5),
    (2025, 2.5),
    (2026, 2.1),
    (2027, 1.9),
)

# Fee types and whether they are legal.
FEES = (
    ("last_months_rent", "legal"),
    ("key_deposit_refundable", "conditional"),
    ("security_or_damage_deposit", "illegal"),
    ("pet_deposit_or_fee", "illegal"),
    ("application_or_credit_check_fee", "illegal"),
    ("admin_or_move_in_fee", "illegal"),
    ("post_dated_cheque_fee", "illegal"),
)

NOTICE_DAYS = 90
MONTHS_BETWEEN = 12


def guidelines(spark: SparkSession) -> DataFrame:
    """guideline_year and percent; ten rows."""
    return spark.createDataFrame(list(GUIDELINES), "guideline_year int, percent double")


def with_guideline(rows: DataFrame, year: Column) -> DataFrame:
    """Adds guideline_year (the year, kept within the table), percent and is_estimate."""
    low, high = GUIDELINES[0][0], GUIDELINES[-1][0]
    within = F.least(F.greatest(year, F.lit(low)), F.lit(high)).cast("int")
    named = rows.withColumn("guideline_year", within).withColumn("is_estimate", (year < low) | (year > high))
    return named.join(F.broadcast(guidelines(rows.sparkSession)), "guideline_year")


def rent_increases(rows: DataFrame) -> DataFrame:
    """Adds the checks of a proposed increase and its verdict.

    Needs current_rent, proposed_rent, notice_date, effective_date, last_date,
    exempt, approved. Without an increase nothing is checked.
    """
    out = with_guideline(rows, F.year("effective_date"))
    percent = (F.col("proposed_rent") - F.col("current_rent")) / F.col("current_rent") * 100.0
    out = out.withColumn("increase_percent", half_up(percent, 2))
    notice = F.datediff("effective_date", "notice_date") >= NOTICE_DAYS
    often = F.col("effective_date") >= F.add_months("last_date", MONTHS_BETWEEN)
    within = F.col("exempt") | F.col("approved") | (percent <= F.col("percent") + 0.01)
    any_ = percent > 0
    return out.withColumns(
        {
            "notice_ok": F.when(any_, notice),
            "frequency_ok": F.when(any_, often),
            "guideline_ok": F.when(any_, within),
            "verdict": F.when(any_ & ~(notice & often & within), "not_compliant").otherwise("compliant"),
        }
    )


def eviction_notices(rows: DataFrame) -> DataFrame:
    """Adds required_days, actual_days, months of rent owed, the number of failed checks and the verdict.

    Needs notice_type (N4, N5, N8, N12, N13), notice_date, termination_date,
    tenancy, ground, served_by, individual_landlord, individual_unit,
    compensation and, where there, units (of the building; without it one month
    is owed); what a type does not use may be null. A purchaser's notice is not
    checked for the landlord's eligibility.
    """
    kind, weekly = F.col("notice_type"), F.col("tenancy") == "daily_weekly"
    required = (
        F.when(kind == "N4", F.when(weekly, 7).otherwise(14))
        .when(kind == "N5", F.when(F.col("ground") == "damage_wilful_severe", 10).otherwise(20))
        .when(kind == "N8", F.when(weekly, 28).otherwise(60))
        .when(kind == "N12", 60)
        .when(kind == "N13", 120)
    )
    actual = F.datediff("termination_date", "notice_date")
    none = F.lit(False)
    ineligible = (kind == "N12") & (F.col("served_by") == "landlord") & ~(F.coalesce("individual_landlord", none) & F.coalesce("individual_unit", none))
    unpaid = ~F.coalesce("compensation", none) & ((kind == "N12") | ((kind == "N13") & ~F.coalesce(F.col("ground") == "repairs", none)))
    failed = sum((F.when(x, 1).otherwise(0) for x in (actual < required, ineligible, unpaid)), F.lit(0))
    units = F.col("units") if "units" in rows.columns else F.lit(1)
    months = F.when(kind == "N12", 1).when((kind == "N13") & ~F.coalesce(F.col("ground") == "repairs", none), F.when(units >= 5, 3).otherwise(1)).otherwise(0)
    out = rows.withColumns({"required_days": required, "actual_days": actual, "months_owed": months, "failed": failed})
    return out.withColumn("verdict", F.when(F.col("failed") > 0, "not_valid").otherwise("appears_valid"))


def deposit_interest(rows: DataFrame) -> DataFrame:
    """Interest on deposits by calendar year: id, exceeds_cap, years, total_interest.

    Needs id, deposit, rent, paid_date, as_of_date. A year counts the days from
    its first or the payment to its last or the reference day.
    """
    held = rows.where(F.col("as_of_date") > F.col("paid_date")).withColumn("year", F.explode(F.sequence(F.year("paid_date"), F.year("as_of_date"))))
    start, end = F.make_date("year", F.lit(1), F.lit(1)), F.make_date(F.col("year") + 1, F.lit(1), F.lit(1))
    days = F.datediff(F.least(end, "as_of_date"), F.greatest(start, "paid_date"))
    held = with_guideline(held.withColumn("days", days).withColumn("of", F.datediff(end, start)).where("days > 0"), F.col("year"))
    owed = F.col("deposit") * (F.col("percent") / 100.0) * (F.col("days") / F.col("of"))
    per = held.groupBy("id").agg(F.count(F.lit(1)).alias("years"), half_up(F.sum(owed), 2).alias("total_interest"))
    cap = F.col("deposit") > F.col("rent") + 0.01
    joined = rows.join(per, "id", "left")
    return joined.select("id", cap.alias("exceeds_cap"), F.coalesce("years", F.lit(0)).alias("years"), F.coalesce("total_interest", F.lit(0.0)).alias("total_interest"))


def fee_verdicts(rows: DataFrame) -> DataFrame:
    """Adds the verdict on each fee_type; unknown types have none."""
    fees = rows.sparkSession.createDataFrame(list(FEES), "fee_type string, verdict string")
    return rows.join(F.broadcast(fees), "fee_type", "left")
