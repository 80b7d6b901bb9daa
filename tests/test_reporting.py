"""Reports, letters and labels on small cases with nulls, ties and empty tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from clausegrid.operators import events, explanations, reporting

CLAUSES = "lease_id int, seq int, number string, clause_type string, risk_score double, heavy boolean, void boolean, text string"
CLASHES = "lease_id int, id_a int, id_b int, kind string, severity string, has_contradiction boolean"
SOURCES = "lease_id int, seq int, key string, reference string, url string"


def test_report_rows(spark: SparkSession) -> None:
    leases = spark.createDataFrame([(1, "Ontario", [3, 4]), (2, "Ontario", None)], "lease_id int, jurisdiction string, missing array<int>")
    clauses = spark.createDataFrame(
        [(1, 2, "2", "pets", 7.0, False, False, "no pets"), (1, 1, "1", "entry_rights", 9.0, True, True, "x" * 101), (1, 3, "3", "rent_payment", 7.0, False, False, "pay"), (1, 4, "4", "standard_boilerplate", 8.0, False, False, "misc"), (1, 5, "5", "pets", 2.0, False, False, None)],
        CLAUSES,
    )
    clashes = spark.createDataFrame([(1, 1, 2, "generic", "medium", True), (1, 1, 3, None, None, False)], CLASHES)
    sources = spark.createDataFrame([(1, 2, "statute:1", "Act s.1", "u"), (1, 1, "statute:1", "Act s.1", "v"), (1, 1, "decision:2", "TST-1", None)], SOURCES)
    one, two = reporting.report_rows(leases, clauses, clashes, sources).orderBy("lease_id").collect()
    assert [(x["seq"], x["risk_level"]) for x in one["red_flags"]] == [(1, "critical"), (4, "high"), (2, "high"), (3, "high")]
    assert [x["seq"] for x in one["points"]] == [1, 2, 3] and one["points"][0]["counter"].endswith(reporting.REST_UNCHANGED)
    assert [(x["key"], x["url"]) for x in one["sources"]] == [("decision:2", None), ("statute:1", "v")]
    assert len(one["contradictions"]) == 1 and one["clauses"] == 5 and "4 high-risk clauses" in one["summary"]
    assert (two["overall"], two["level"], two["clauses"], two["red_flags"], two["missing"]) == (0.0, "low", 0, [], [])
    assert reporting.report_rows(leases.limit(0), clauses, clashes, sources).count() == 0


def test_letters(spark: SparkSession) -> None:
    leases = spark.createDataFrame([(1, "Ann", "Bo", "1 King St", "assertive"), (2, "Cy", "Di", "2 King St", None), (3, "E", "F", "G", "formal")], "lease_id int, tenant string, landlord string, address string, tone string")
    items = spark.createDataFrame([(1, 2, "7", "Pets", "Remove it", None, "No.", " "), (1, 1, "3", "Entry", "Give notice", "s.27", None, " Own words "), (2, 1, "1", "Rent", "Lower it", "", None, None)], "lease_id int, seq int, number string, heading string, ask string, section string, argument string, counter string")
    got = {r["lease_id"]: r for r in reporting.letters(leases, items).collect()}
    assert sorted(got) == [1, 2]
    assert "1. Clause 3 — Entry: Give notice (s.27)\n2. Clause 7 — Pets: Remove it\n\nRegarding Clause 3 (Entry): \n\nRegarding Clause 7 (Pets): No.\n\n" in got[1]["body"]
    assert got[1]["body"].startswith("Dear Bo,\n\nRe: ") and got[1]["body"].endswith("Yours truly,\nAnn")
    assert [tuple(x) for x in got[1]["addendum"]] == [("3", "Entry", "Own words"), ("7", "Pets", reporting.LETTER_LINES[4] + "Remove it")]
    assert reporting.LETTER_OPENINGS["formal"] in got[2]["body"] and "Regarding" not in got[2]["body"]


def test_what_is_shown(spark: SparkSession) -> None:
    points = spark.createDataFrame([(0, None, None, None, None, None, None), (1, "c", "entry_rights", "high", False, True, "x")], "n int, clause_id string, clause_type string, priority string, negotiable boolean, walk_away boolean, ask string")
    got = [(r["id"], r["label"], r["priority"], r["negotiable"], r["walk_away"], r["ask"]) for r in reporting.shown_points(points).orderBy("n").collect()]
    assert got == [("neg-0", "Clause 1", "medium", True, False, ""), ("c", "Entry Rights", "high", False, True, "x")]
    clauses = spark.createDataFrame([("1", None, None, None, "", ["s.27(1)"]), ("synthetic-2", "h", 1.0, "low", None, None), (None, "h", 9.0, "high", "own", ["s.3"])], "number string, heading string, risk_score double, risk_level string, suggested string, sections array<string>")
    shown = {r["number"]: r for r in reporting.shown_clauses(clauses).collect()}
    assert sorted(shown) == ["", "1"] and shown["1"]["compliant"].startswith("The Landlord may enter") and shown[""]["compliant"] == "own"
    leases = spark.createDataFrame([("1 King St", "4", None, "a/b/c.pdf"), (None, "4", "Toronto", None), ("2 King St", "", "", "x.pdf")], "address string, unit string, city string, file_path string")
    assert [(r["shown_address"], r["shown_city"], r["file_name"]) for r in reporting.shown_lease(leases).collect()] == [("4 – 1 King St", "", "c.pdf"), ("Rental Unit", "Toronto", ""), ("2 King St", "", "x.pdf")]
    clashes = spark.createDataFrame([(1, 0, 10, 99, "entry_vs_quiet_enjoyment", None), (1, 1, 98, 99, None, "high")], "lease_id int, n int, id_a int, id_b int, kind string, severity string")
    named = spark.createDataFrame([(1, 10, "4", ""), (2, 99, "5", "Other lease")], "lease_id int, id int, number string, heading string")
    out = [tuple(r)[2:] for r in reporting.shown_contradictions(clashes, named).orderBy("n").collect()]
    assert out == [("Clause 4", "Quiet Enjoyment", "entry_vs_quiet_enjoyment", "medium"), ("Clause A", "Clause B", "direct_conflict", "high")]


def test_positions_and_delays(spark: SparkSession) -> None:
    rows = spark.createDataFrame([(4.25, "medium", 500, 10_000), (12.0, "critical", None, 0), (-1.0, "odd", 1, 10**9), (None, "low", 10**9, 10**9)], "score double, level string, ms long, total long")
    got = rows.select(reporting.band_position(F.col("score"), F.col("level")), reporting.replay_delay(F.col("ms"), F.col("total"))).collect()
    assert [tuple(r) for r in got] == [(50.0, 750.0), (100.0, 1200.0), (0.0, 80.0), (None, 1200.0)]
    points = spark.createDataFrame([(1, 2, "later", "x", None), (1, 1, "first", None, None)], "clause_id int, n int, ask string, counter string, argument string")
    clauses = spark.createDataFrame([(1,), (2,)], "clause_id int")
    assert sorted(tuple(r) for r in reporting.with_points(clauses, points).select("clause_id", "ask", "counter", "argument").collect()) == [(1, "first", "", ""), (2, "", "", "")]


def test_explanations(spark: SparkSession) -> None:
    statute = [("RTA", "26", "Entry", 0.9), ("Form", "form_1_x", None, 0.6), ("RTA", "3", "", 0.2)]
    rows = [(1, "The Landlord, in its sole and absolute discretion, may enter.", 9.0, ["odd", "pet_fines"], statute), (2, None, 1.0, [], []), (3, "plain", 5.0, [], statute[2:])]
    got = explanations.explained(spark.createDataFrame(rows, "id int, text string, risk_score double, violations array<string>, statutes array<struct<act:string,section:string,title:string,relevance:double>>"))
    one, two, three = got.orderBy("id").collect()
    assert one["unusual"] and one["suggested"] == explanations.TEMPLATES["pet_fines"]
    assert one["reasons"] == f"Statutory violations found: odd; pet fines. {explanations.ONE_SIDED}. Assessed against: RTA s.26 (Entry), Form"
    assert two["explanation"].endswith(explanations.NO_STATUTES) and two["reasons"] == explanations.NO_STATUTES_REASON and two["suggested"] is None
    assert three["reasons"] == "Clause assessed on language patterns. Score: 5/10."


def test_cards_and_trace_rows(spark: SparkSession) -> None:
    leases = spark.createDataFrame([(1, "complete", 9.0, None, None, None, "a/b.c.pdf"), (2, "complete", 9.0, "T", "A", "C", None), (3, "pending", 10.0, None, "A", None, "x"), (4, "complete", None, None, None, None, None)], "id int, status string, score double, display_title string, address string, city string, file_path string")
    assert [(r["title"], r["subtitle"], r["attention"]) for r in reporting.cards(leases).orderBy("id").collect()] == [("b.c", "b.c.pdf", True), ("T", "C", True), ("A", "x", False), ("", "", False)]
    assert reporting.top_card(leases).collect()[0]["id"] == 1 and reporting.top_card(leases.limit(0)).count() == 0
    steps = [("a", 1, 1, "score_risk", 100, 50), ("a", 2, 2, "benchmark_clause", 100, 900), ("a", 3, 3, None, 120, None), ("b", 1, 2, "parse_document", None, 10), ("b", 2, 1, "score_risk", 5, 30)]
    got = events.trace_rows(spark.createDataFrame(steps, "trace string, step int, seq int, tool string, start_ms long, duration_ms long")).collect()
    assert sorted((r["trace"], r["step"], r["category"], round(r["left_pct"], 3), round(r["width_pct"], 3), r["lane"]) for r in got) == [("a", 1, "score", 0.0, 5.556, 0), ("a", 3, "unknown", 2.222, 0.8, 1), ("b", 1, "parse", 75.0, 25.0, 0), ("b", 2, "score", 0.0, 75.0, 0)]
