"""Golden cases of the rule calculators, and sequential operators against plain loops."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from clausegrid.operators import documents, events, rules
from clausegrid.plans.catalogue import QUERIES
from clausegrid.sources import tables
from clausegrid.streaming import quotas

INCREASE = "current_rent double, proposed_rent double, notice_date date, effective_date date, last_date date, exempt boolean, approved boolean"
BASE = (2000.0, 2040.0, date(2024, 3, 1), date(2024, 6, 1), date(2023, 6, 1), False, False)


@pytest.mark.parametrize(
    ("change", "verdict"),
    [
        ({}, "compliant"),
        ({1: 2200.0}, "not_compliant"),
        ({2: date(2024, 5, 1)}, "not_compliant"),
        ({2: date(2024, 3, 3)}, "compliant"),
        ({4: date(2024, 1, 1)}, "not_compliant"),
        ({1: 2400.0, 5: True}, "compliant"),
        ({1: 2200.0, 6: True}, "compliant"),
        ({1: 2000.0, 2: date(2024, 5, 31)}, "compliant"),
        ({2: date(2024, 11, 1), 3: date(2025, 2, 28), 4: date(2024, 2, 29)}, "compliant"),
        ({1: 2050.0}, "compliant"),
    ],
)
def test_rent_increase(spark: SparkSession, change: dict, verdict: str) -> None:
    row = tuple(change.get(i, v) for i, v in enumerate(BASE))
    assert rules.rent_increases(spark.createDataFrame([row], INCREASE)).first()["verdict"] == verdict


def test_guideline_outside_the_table_is_an_estimate(spark: SparkSession) -> None:
    row = rules.rent_increases(spark.createDataFrame([(2000.0, 2010.0, date(2029, 1, 1), date(2030, 6, 1), date(2028, 1, 1), False, False)], INCREASE)).first()
    assert (row["guideline_year"], row["percent"], row["is_estimate"]) == (2027, 1.9, True)


NOTICE = "notice_type string, days int, tenancy string, ground string, served_by string, individual_landlord boolean, individual_unit boolean, compensation boolean"


@pytest.mark.parametrize(
    ("row", "verdict"),
    [
        (("N4", 14, "monthly", None, None, None, None, None), "appears_valid"),
        (("N4", 10, "monthly", None, None, None, None, None), "not_valid"),
        (("N4", 7, "daily_weekly", None, None, None, None, None), "appears_valid"),
        (("N5", 10, None, "damage_wilful_severe", None, None, None, None), "appears_valid"),
        (("N5", 9, None, "interference", None, None, None, None), "not_valid"),
        (("N8", 28, "daily_weekly", None, None, None, None, None), "appears_valid"),
        (("N12", 60, None, None, "landlord", False, True, True), "not_valid"),
        (("N12", 60, None, None, "purchaser", None, None, True), "appears_valid"),
        (("N12", 60, None, None, "landlord", True, True, False), "not_valid"),
        (("N13", 120, None, "repairs", None, None, None, False), "appears_valid"),
        (("N13", 120, None, "demolition", None, None, None, False), "not_valid"),
    ],
)
def test_eviction(spark: SparkSession, row: tuple, verdict: str) -> None:
    rows = spark.createDataFrame([row], NOTICE).withColumn("notice_date", F.lit("2024-01-01").cast("date"))
    assert rules.eviction_notices(rows.withColumn("termination_date", F.expr("date_add(notice_date, days)"))).first()["verdict"] == verdict


def test_deposit_interest(spark: SparkSession) -> None:
    rows = [(1, 2500.0, 2000.0, date(2024, 1, 1), date(2024, 1, 1)), (2, 2000.0, 2000.0, date(2024, 1, 1), date(2025, 1, 1)), (3, 2000.0, 2000.0, date(2023, 1, 1), date(2025, 1, 1))]
    found = {r["id"]: r for r in rules.deposit_interest(spark.createDataFrame(rows, "id int, deposit double, rent double, paid_date date, as_of_date date")).collect()}
    assert found[1]["exceeds_cap"] and found[1]["years"] == 0
    assert (found[2]["exceeds_cap"], found[2]["years"], found[2]["total_interest"]) == (False, 1, 50.0)
    assert (found[3]["years"], found[3]["total_interest"]) == (2, 100.0)


def test_fees(spark: SparkSession) -> None:
    found = rules.fee_verdicts(spark.createDataFrame([("last_months_rent",), ("pet_deposit_or_fee",), ("other",)], "fee_type string"))
    assert {r["fee_type"]: r["verdict"] for r in found.collect()} == {"last_months_rent": "legal", "pet_deposit_or_fee": "illegal", "other": None}


def test_anchored_quota_and_its_stream(spark: SparkSession, tmp_path) -> None:
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(minutes=m), 100 * k + i) for k in (1, 2) for i, m in enumerate([0, 1, 2, 3, 4, 5, 61, 62, 200])]
    df = spark.createDataFrame(rows, "key long, ts timestamp, event_id long")
    want = {100 * k + i: x for k in (1, 2) for i, x in enumerate([1, 2, 3, 4, 5, 6, 1, 2, 1])}
    assert {r["event_id"]: r["count"] for r in events.anchored_quota(df, 5, 3600).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = quotas.anchored_quota_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "events")), 5, 3600)
    q = stream.writeStream.format("memory").queryName("anchored").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination(120)
    assert {r["event_id"]: r["count"] for r in spark.table("anchored").collect()} == want


def test_lanes_are_first_fit(spark: SparkSession) -> None:
    rows = [("t", 1, 0.0, 1000.0), ("t", 2, 0.0, 1000.0), ("t", 3, 1000.0, 2000.0), ("u", 1, 0.0, 1.0)]
    found = events.lanes(spark.createDataFrame(rows, "trace string, step int, start double, stop double")).collect()
    assert {(r["trace"], r["step"]): r["lane"] for r in found} == {("t", 1): 0, ("t", 2): 1, ("t", 3): 0, ("u", 1): 0}


def test_segments_and_references(spark: SparkSession) -> None:
    text = "Preamble\n1. Rent is due\nmore\n\nARTICLE IV: Entry\nsee section 2.1 and subject to clause 3a"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = [(r["clause"], r["number"], r["heading"], r["start"], r["n_chars"], r["confidence"]) for r in documents.segments(df).orderBy("clause").collect()]
    assert got == [(1, "synthetic-1", None, 0, 8, 0.6), (2, "1", "Rent is due", 9, 19, 0.6), (3, "ARTICLE IV", "Entry", 30, 58, 0.6)]
    plain = spark.createDataFrame([(1, "a first paragraph of it\n\n\na first paragraph of it"), (2, "short")], df.schema)
    assert [(r["doc_id"], r["number"], r["start"]) for r in documents.segments(plain).orderBy("doc_id", "clause").collect()] == [(1, "synthetic-1", 0), (1, "synthetic-2", 26), (2, "synthetic-1", 0)]
    assert df.where("doc_id = 1").select(documents.references(F.col("text")).alias("r")).first()["r"] == ["3a", "2.1"]


def test_upsert_keeps_the_new_row(spark: SparkSession) -> None:
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in tables.upsert(old, new, ["k"], ["v"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert [tuple(r) for r in tables.changed(new, old, ["k"], "v").orderBy("k").collect()] == [(2, "c"), (3, "d")]


def test_red_flags_of_a_long_lease_are_all_there(spark: SparkSession, tmp_path) -> None:
    line = "l_orderkey long, l_linenumber int, l_discount double, l_returnflag string, l_partkey long, l_suppkey long"
    rows = [(1, i, 0.06 + i % 5 / 100, "R", 1, 1) for i in range(1500)] + [(2, 1, 0.05, "N", 1, 1), (2, 2, 0.1, "N", 1, 1)]
    spark.createDataFrame(rows, line).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = QUERIES["red_flags_sorted"](spark, str(tmp_path)).collect()
    want = sorted((-round(x * 100), seq) for _, seq, x, *_ in rows[:1500])
    assert [(-r["risk_score"], r["seq"]) for r in sorted(found, key=lambda r: r["place"]) if r["lease_id"] == 1] == want
    assert sorted(r["place"] for r in found if r["lease_id"] == 1) == list(range(1, 1501))
    assert [r["seq"] for r in found if r["lease_id"] == 2] == [2]
