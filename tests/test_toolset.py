"""Tools by name over a table of calls, and table functions in SQL."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from clausegrid.functions.tables import registered
from clausegrid.operators import parsing, toolset

CALLS = "call_id long, tool string, input string"


def asked(spark: SparkSession, calls: list[tuple]) -> dict[int, tuple[bool, dict]]:
    corpora = {
        toolset.STATUTES: spark.createDataFrame([(1, "entry_rights", "Written notice of entry is due."), (2, "entry_rights", "Nothing."), (3, "pets", "notice")], "id long, grp string, text string"),
        toolset.DECISIONS: spark.createDataFrame([(7, "entry_rights", "The notice was not written.")], "id long, grp string, text string"),
        toolset.BENCHMARKS: spark.createDataFrame([("pets", float(n % 10)) for n in range(20)], "grp string, x double"),
    }
    rows = [(n, tool, x if x is None or isinstance(x, str) else json.dumps(x)) for n, tool, x in calls]
    found = toolset.answers(spark.createDataFrame(rows, CALLS), corpora).collect()
    assert sorted(r["call_id"] for r in found) == sorted(n for n, *_ in calls)
    return {r["call_id"]: (r["is_error"], json.loads(r["output"])) for r in found}


def test_all_tools_answer(spark: SparkSession) -> None:
    assert len(toolset.TOOLS) == 12
    lease = "1. Rent is due on the first of the month.\n2. Entry\nThe landlord may enter at any time."
    clause = {"clause_id": "c1", "clause_text": "The landlord may enter at any time without notice.", "clause_type": "entry_rights", "risk_score": 9}
    got = asked(
        spark,
        [
            (1, "parse_document", {"pages": ["A lease of more than fifty signs between the landlord and", "the tenant of the unit.", None]}),
            (2, "detect_jurisdiction", {"raw_text": "This lease is governed by the laws of Ontario. Residential Tenancies Act, 2006"}),
            (3, "segment_clauses", {"raw_text": lease}),
            (4, "classify_clause", clause),
            (5, "lookup_statute", {"clause_text": "written notice of entry", "clause_type": "entry_rights"}),
            (6, "lookup_tribunal", {"clause_text": "written notice of entry", "clause_type": "entry_rights"}),
            (7, "score_risk", clause | {"retrieved_statutes": [{"section": "26", "text": "at least 24 hours notice", "relevance": 0.9}]}),
            (8, "detect_contradiction", {"clause_a": {"id": "a", "text": "The landlord may enter.", "type": "entry_rights"}, "clause_b": {"id": "b", "text": "No right to sublet.", "type": "pets"}}),
            (9, "check_missing", {"found_clause_types": ["pets", "rent_payment"], "jurisdiction_code": "CA-ON"}),
            (10, "benchmark_clause", {"clause_type": "pets", "risk_score": 4.5}),
            (11, "generate_negotiation", clause),
            (12, "generate_report", {"jurisdiction": "Ontario", "analyzed_clauses": [{"seq": 1, "number": "1", "clause_type": "entry_rights", "risk_score": 9.0, "text": "x"}]}),
        ],
    )
    assert not any(error for error, _ in got.values())
    out = {n: x for n, (_, x) in got.items()}
    assert out[1]["page_count"] == 3 and out[1]["raw_text"].startswith("A lease")
    assert out[2]["jurisdiction_code"] == "CA-ON" and out[2]["supported"]
    assert out[3]["total"] == 2 and out[3]["clauses"][0]["number"] == "1"
    assert out[4]["primary_type"] == "entry_rights" and out[4]["clause_id"] == "c1"
    assert [r["id"] for r in out[5]["results"]] == [1] and [r["id"] for r in out[6]["results"]] == [7]
    assert out[7]["risk_score"] >= 7 and "entry_without_notice" in out[7]["violations"]
    assert out[8]["has_contradiction"] and out[9]["present"] == [1]
    assert (out[10]["percentile"], out[10]["sample_size"]) == (50, 20)
    assert out[11]["priority"] == "high" and out[11]["counter_language"].startswith("The Landlord shall provide")
    assert out[12]["total_clauses_analyzed"] == 1 and out[12]["overall_risk_level"] == "critical"


def test_wrong_calls_get_errors(spark: SparkSession) -> None:
    got = asked(
        spark,
        [
            (1, "draw_chart", {}),
            (2, None, None),
            (3, "check_missing", {"jurisdiction_code": "CA-ON"}),
            (4, "check_missing", "no json"),
            (5, "classify_clause", None),
            (6, "parse_document", {"pages": ["short"]}),
            (7, "benchmark_clause", {"clause_type": "never", "risk_score": 1.0}),
            (8, "segment_clauses", {"raw_text": ""}),
        ],
    )
    assert {n for n, (error, _) in got.items() if error} == {1, 2, 3, 4, 5, 6, 7}
    assert got[1][1]["error"] == "Unknown tool: draw_chart" and len(got[1][1]["available_tools"]) == 12
    assert got[3][1] == {"error": "Invalid input", "details": ["found_clause_types"]}
    assert sorted(got[4][1]["details"]) == ["found_clause_types", "jurisdiction_code"]
    assert got[8][1]["total"] == 0
    assert toolset.answers(spark.createDataFrame([], CALLS), {}, ("check_missing",)).count() == 0


def test_table_functions_stand_after_lateral(spark: SparkSession) -> None:
    texts = ["Form\n1. Parties\n3. Late\n\n2. Unit\r\nmore", None, "", "1. x\n2. y", "One. Two! Three"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    by_sql = registered(spark).sql("SELECT d.doc_id, s.* FROM {d} AS d, LATERAL form_sections(d.text) AS s", d=df)
    native = parsing.form_sections(df).select("doc_id", "section", "title", "clause_type", "text")
    assert sorted(map(tuple, by_sql.collect())) == sorted(map(tuple, native.collect()))
    said = spark.sql("SELECT d.doc_id, s.n, s.sentence FROM {d} AS d, LATERAL sentences(d.text) AS s WHERE d.doc_id = 4", d=df)
    assert sorted(map(tuple, said.collect())) == [(4, 1, "One."), (4, 2, "Two!"), (4, 3, "Three")]
