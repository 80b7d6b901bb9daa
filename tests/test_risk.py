"""Golden cases of the risk catalogue and of screening."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from clausegrid.operators import risk, screening
from clausegrid.plans.catalogue import QUERIES

CLAUSE = "clause_type string, text string, statutes array<struct<section:string,text:string,relevance:double>>"


@pytest.mark.parametrize(
    ("kind", "text", "section", "law", "violations", "level"),
    [
        ("entry_rights", "The landlord may enter at any time without notice.", "26", "written notice, 24 hours", ["entry_without_notice"], "high"),
        ("entry_rights", "The landlord may enter with 24 hours written notice.", "26", "written notice, 24 hours", [], "low"),
        ("security_deposit", "A non-refundable deposit is due.", "105", "deposit", ["non_refundable_deposit"], "critical"),
        ("security_deposit", "The deposit is the last month of rent.", "105", "deposit", [], "low"),
        ("pets", "A fine of $200 for every pet.", "14", "void", ["pet_fines"], "medium"),
        ("rent_payment", "Post-dated cheques may be provided.", "108", "cheque", [], "low"),
        ("rent_payment", "Twelve post-dated cheques are due.", "108", "cheque", ["post_dated_cheques"], "medium"),
    ],
)
def test_catalogue(spark: SparkSession, kind: str, text: str, section: str, law: str, violations: list, level: str) -> None:
    row = risk.scored(spark.createDataFrame([(kind, text, [(section, law, 0.9)])], CLAUSE)).first()
    assert row["violations"] == violations
    assert row["risk_level"] == level
    assert row["unenforceable"] == bool(violations)


def test_blank_and_unsupported_clauses(spark: SparkSession) -> None:
    rows = [("pets", None, [("14", "void", 0.9)]), ("pets", "A fine and penalty; forfeit; cleaning fee regardless; non-refundable fee", []), ("pets", "A fine for every pet", [("14", "void", 0.1)])]
    blank, bare, weak = risk.scored(spark.createDataFrame(rows, CLAUSE)).collect()
    assert (blank["risk_score"], blank["confidence"]) == (1.0, 0.0)
    assert (bare["risk_score"], bare["risk_level"], bare["confidence"]) == (5.0, "critical", 0.3)
    assert (weak["violations"], weak["confidence"]) == ([], 0.4)


def test_risk_score_reads_the_whole_text(spark: SparkSession, tmp_path) -> None:
    ahead = "plain words " * 500
    rows = [(14, ahead + "The landlord may enter at any time without notice."), (29, ahead), (44, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r["violations"] for r in QUERIES["risk_score"](spark, str(tmp_path)).collect()}
    assert found == {14: "entry_without_notice", 29: "", 44: ""}


def test_scrubbing_puts_names_first(spark: SparkSession) -> None:
    text = "John Smith, a.b@c.org, M5V 2T6, 416-555-1234, $1,200.00, Apt 4B, 123 Main Street"
    got = spark.createDataFrame([(text,)], "t string").select(screening.scrubbed(F.col("t"))).first()[0]
    assert got == "[NAME], [EMAIL], [POSTAL], [PHONE], $[AMOUNT], [UNIT], 123 [NAME]"


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("Residential Tenancies Act of Alberta", "CA-ON"),
        ("in Alberta", "CA-AB"),
        ("laws of the State of Ohio", "INTL"),
        ("T2X 1A1", "CA-AB"),
        ("nothing", "UNKNOWN"),
        (None, "UNKNOWN"),
    ],
)
def test_jurisdiction(spark: SparkSession, text: str | None, code: str) -> None:
    assert screening.jurisdictions(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["code"] == code


def test_outcome(spark: SparkSession) -> None:
    rows = [("TST-1", "The application is granted."), ("LTL-2", "The application is granted."), ("TST-3", "The tenant shall pay."), ("X-4", "is granted")]
    got = [r["outcome"] for r in screening.outcomes(spark.createDataFrame(rows, "case_number string, text string")).collect()]
    assert got == ["tenant_favour", "landlord_favour", "landlord_favour", "mixed"]


# One clause for each violation, what must be found in it, and the section that shows it ("" where the text does).
GOLDEN = (
    ("entry_without_notice", "The landlord may enter at any time.", "26", "at least 24 hours notice"),
    ("non_refundable_deposit", "A non-refundable deposit of one month.", "105", "no other deposit"),
    ("rent_increase_without_guideline", "A rent increase of any amount may follow.", "120", "the guideline"),
    ("waiver_of_rights", "The occupant gives up protection: waive each right.", "4", "contract out"),
    ("mandatory_arbitration", "All matters go to arbitration.", "168", "the board decides"),
    ("post_dated_cheques", "Twelve postdated cheques at signing.", "108", ""),
    ("maintenance_offloaded", "The tenant bears all maintenance.", "20", ""),
    ("rta_waiver", "These terms supersede provincial law.", "4", ""),
    ("daily_late_fee", "$25 for each day of delay.", "59", ""),
    ("pet_fines", "A fine for every pet.", "14", ""),
    ("excess_deposit", "A deposit of three months.", "105", ""),
    ("early_termination_fee", "A lease break costs one rent.", "37", ""),
    ("surveillance_in_unit", "A camera records the bedroom.", "28", ""),
    ("guest_surcharge", "Visitors cost $10 per night.", "134", ""),
    ("assignment_fee", "To sublet, a $50 charge applies.", "97", ""),
    ("vital_services_cutoff", "The renter must ensure heat.", "29", ""),
    ("quiet_enjoyment_violation", "Regular inspection: we enter monthly.", "22", ""),
    ("assignment_prohibition", "Subletting is forbidden; no subletting.", "95", ""),
    ("unlawful_renewal_obligation", "You must give notice if you do not renew or not continue.", "38", ""),
    ("multiple_rent_increases", "Rent shall be adjusted quarterly.", "119", ""),
    ("service_reduction_no_rent_decrease", "Parking: we may discontinue.", "121", ""),
    ("retaliation_or_coercion", "You forfeit the right to complain.", "138", ""),
    ("self_help_eviction", "We change the locks.", "", ""),
    ("self_help_eviction", "You vacate within 3 days.", "", ""),
    ("unlawful_termination", "Verbal notice suffices.", "", ""),
    ("unlawful_termination", "14 days written notice to end the tenancy.", "", ""),
    ("rta_waiver", "By signing you relinquish this.", "", ""),
    ("maintenance_offloaded", "The tenant pays the cost of the furnace.", "", ""),
    ("early_termination_fee", "Leaving early: pay three months, then leave.", "", ""),
    ("surveillance_in_unit", "CCTV in the living area.", "", ""),
    ("guest_surcharge", "Guests owe $5 per person.", "", ""),
    ("assignment_fee", "Assigning has a $90 fee.", "", ""),
    ("vital_services_cutoff", "The tenant shall pay for water.", "", ""),
    ("assignment_prohibition", "The tenant may not assign.", "", ""),
    ("unlawful_renewal_obligation", "The lease will automatically renew for a fixed term.", "", ""),
    ("retaliation_or_coercion", "We evict for exercising claims.", "", ""),
)


def test_each_violation_is_found(spark: SparkSession) -> None:
    rows = [(i, text, "other", [(section, law, 0.9)] if section else [("999", "", 0.9)]) for i, (_, text, section, law) in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "id int, text string, clause_type string, statutes array<struct<section string, text string, relevance double>>")
    found = {r["id"]: r for r in risk.scored(df).collect()}
    for i, (name, text, _, _) in enumerate(GOLDEN):
        assert name in found[i]["violations"], text
        assert found[i]["risk_score"] >= (7 if name in risk.CRITICAL else 5) and found[i]["unenforceable"], text
    assert len({name for name, *_ in GOLDEN}) == 24


def test_caps_decisions_and_clean_clauses(spark: SparkSession) -> None:
    kind = "text string, clause_type string, statutes array<struct<section string, text string, relevance double>>, decisions array<struct<outcome string, relevance double>>"
    none: list = []
    won = [("tenant_favour", 0.9), ("tenant_favour", 0.9), ("landlord_favour", 0.4)]
    rows = [
        ("No pets are welcome.", "pets", none, none),
        ("Rent is due on the first.", "rent_payment", none, won),
        ("Keep the unit clean and tidy.", "maintenance_repairs", none, won),
        ("Plain words.", "other", [("1", "", 0.9)], won),
        ("Plain words.", "other", [("1", "", 0.9)], [("landlord_favour", 0.9)] * 5),
        ("All repairs are the other side's, with every appliance.", "other", [("1", "", 0.9)], none),
        ("  ", "other", [("1", "", 0.9)], won),
        ("The landlord maintains the unit.", "other", none, none),
    ]
    got = [(r["risk_score"], r["violations"]) for r in risk.scored(spark.createDataFrame(rows, kind).coalesce(1)).collect()]
    assert [x for x, _ in got] == [3.0, 4.0, 3.0, 4.0, 2.0, 6.0, 1.0, 3.0]
    assert all(v == [] for _, v in got)
