"""The tools by name: calls in a table, answers in a table.

A call is a row with the tool's name and its input as JSON. Each tool states the
type of its input, which of its fields must be there, and a transformation of
all its calls at once; so a table of calls is as many Spark plans as there are
tools, whatever the number of calls. Wrong calls get an answer with an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.operators import documents, intake, portfolio, reporting, reports, retrieval, risk, screening

#: Texts and rows that tools look things up in, by name: statutes and decisions (id, grp, text), benchmarks (id, grp, x).
Corpora = dict[str, DataFrame]
STATUTES, DECISIONS, BENCHMARKS = "statutes", "decisions", "benchmarks"
#: The jurisdiction that is covered, and how many rows a lookup gives.
COVERED, FOUND = "CA-ON", 3


@dataclass(frozen=True)
class Tool:
    """A name, the input's type as DDL, the fields it must have, and what it does with calls (call_id, a) to give (call_id, answer)."""

    name: str
    takes: str
    needs: tuple[str, ...]
    work: Callable[[DataFrame, Corpora], DataFrame]


def _answered(rows: DataFrame, call: str, **fields: str | Column) -> DataFrame:
    return rows.select(F.col(call).alias("call_id"), F.struct(*(F.col(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in fields.items())).alias("answer"))


def _parse_document(calls: DataFrame, corpora: Corpora) -> DataFrame:
    pages = calls.select(F.col("call_id").alias("file"), F.posexplode("a.pages").alias("page", "text"))
    text = documents.assembled(documents.without_headers(pages)).select("file", "text")
    sure = intake.text_confidence(pages)
    joined = calls.select(F.col("call_id").alias("file"), F.size("a.pages").alias("n_pages")).join(text, "file", "left").join(sure, "file", "left")
    kept = F.coalesce("text", F.lit(""))
    error = F.when(~intake.long_enough(F.col("text")), "Document text is too short")
    return _answered(joined, "file", error=error, raw_text=kept, page_count="n_pages", extraction_confidence=F.coalesce("confidence", F.lit(0.0)))


def _texts(calls: DataFrame, field: str) -> DataFrame:
    return calls.select(F.col("call_id").alias("doc_id"), F.col(f"a.{field}").alias("text"))


def _detect_jurisdiction(calls: DataFrame, corpora: Corpora) -> DataFrame:
    found = screening.jurisdictions(_texts(calls, "raw_text"))
    return _answered(found, "doc_id", jurisdiction_code="code", confidence=F.col("confidence_pct") / 100, ambiguous="ambiguous", supported="supported")


def _segment_clauses(calls: DataFrame, corpora: Corpora) -> DataFrame:
    found = documents.segments(_texts(calls, "raw_text")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("clause", "number", "heading", "text"))).alias("clauses"), F.first("confidence").alias("confidence"))
    every = _texts(calls, "raw_text").select("doc_id").join(found, "doc_id", "left")
    return _answered(every, "doc_id", clauses="clauses", total=F.coalesce(F.size("clauses"), F.lit(0)), segmentation_confidence=F.coalesce("confidence", F.lit(0.0)))


def _classify_clause(calls: DataFrame, corpora: Corpora) -> DataFrame:
    rows = calls.select("call_id", F.col("a.clause_id").alias("clause_id"), F.col("a.clause_text").alias("text"))
    return _answered(documents.classified(rows), "call_id", clause_id="clause_id", primary_type="primary_type", subtype="subtype", confidence="confidence", needs_lookup="needs_lookup")


def _lookup(decisions: bool) -> Callable[[DataFrame, Corpora], DataFrame]:
    def work(calls: DataFrame, corpora: Corpora) -> DataFrame:
        corpus = corpora[DECISIONS if decisions else STATUTES]
        asked = calls.select(F.col("call_id").alias("query_id"), F.col("a.clause_type").alias("grp"), F.col("a.clause_text").alias("asked"))
        hits = retrieval.keyword_hits(asked, corpus, FOUND, decisions)
        found = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("results"))
        every = asked.select("query_id").join(found, "query_id", "left")
        return _answered(every, "query_id", results="results", total=F.coalesce(F.size("results"), F.lit(0)))

    return work


def _score_risk(calls: DataFrame, corpora: Corpora) -> DataFrame:
    statutes = F.coalesce("a.retrieved_statutes", F.array().cast("array<struct<section:string,text:string,relevance:double>>"))
    rows = calls.select("call_id", F.col("a.clause_text").alias("text"), F.col("a.clause_type").alias("clause_type"), statutes.alias("statutes"))
    return _answered(risk.scored(rows), "call_id", risk_score="risk_score", risk_level="risk_level", violations="violations", is_potentially_unenforceable="unenforceable", confidence="confidence")


def _detect_contradiction(calls: DataFrame, corpora: Corpora) -> DataFrame:
    part = lambda side, field: F.col(f"a.clause_{side}.{field}").alias(f"{field}_{side}")
    rows = calls.select("call_id", *(part(s, f) for s in "ab" for f in ("id", "text", "type")))
    return _answered(reports.detected_contradictions(rows), "call_id", has_contradiction=F.coalesce("has_contradiction", F.lit(False)), contradiction_type="kind", severity="severity")


def _check_missing(calls: DataFrame, corpora: Corpora) -> DataFrame:
    rows = calls.select(F.col("call_id").alias("lease_id"), F.col("a.found_clause_types").alias("types"), (F.col("a.jurisdiction_code") == COVERED).alias("supported"))
    return _answered(reports.protections(rows), "lease_id", present="present", missing="missing", coverage_score="coverage")


def _benchmark_clause(calls: DataFrame, corpora: Corpora) -> DataFrame:
    own = calls.select("call_id", F.col("a.clause_type").alias("grp"), F.col("a.risk_score").alias("x"))
    # One pass over the distinct scores of each group, those of the calls among them.
    known = corpora[BENCHMARKS].groupBy("grp", "x").agg(F.count(F.lit(1)).alias("c"))
    marks = known.unionByName(own.select("grp", "x", F.lit(0).cast("long").alias("c"))).groupBy("grp", "x").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("grp").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    marks = marks.select("grp", "x", upto.alias("upto"), F.sum("c").over(Window.partitionBy("grp")).alias("n"))
    joined = own.join(marks, ["grp", "x"])
    enough = F.col("n") >= 10
    percentile = F.when(enough, F.floor(F.col("upto") * 100.0 / F.col("n") + 0.5).cast("int"))
    error = F.when(~enough, "Not enough benchmarks")
    return _answered(joined.withColumn("p", percentile), "call_id", error=error, percentile="p", sample_size="n", comparison=F.when(enough, reports.peer_label(F.col("p"), F.col("x"))))


def _generate_negotiation(calls: DataFrame, corpora: Corpora) -> DataFrame:
    rows = calls.select("call_id", *(F.col(f"a.{c}").alias(c) for c in ("clause_id", "clause_type", "risk_score")), F.col("a.clause_text").alias("text"))
    counter = F.when(F.col("negotiable"), reporting.counter_language(F.col("clause_type"), F.col("text"))).otherwise("")
    found = reports.negotiation_points(rows).withColumn("counter", counter)
    return _answered(found, "call_id", negotiable="negotiable", priority="priority", ask="ask", counter_language="counter", landlord_likely_response="response", your_rebuttal="rebuttal", walk_away_threshold="walk_away")


def _generate_report(calls: DataFrame, corpora: Corpora) -> DataFrame:
    leases = calls.select(F.col("call_id").alias("lease_id"), F.col("a.jurisdiction").alias("jurisdiction"), F.col("a.missing").alias("missing"))
    clauses = calls.select(F.col("call_id").alias("lease_id"), F.inline("a.analyzed_clauses"))
    clauses = clauses.withColumns({"heavy": F.col("clause_type").isin(*risk.HIGH_TYPES), "void": F.coalesce("void", F.lit(False))})
    none = leases.where(F.lit(False))
    clashes = none.select("lease_id", F.lit(0).alias("id_a"), F.lit(0).alias("id_b"), F.lit("").alias("kind"), F.lit("").alias("severity"), F.lit(True).alias("has_contradiction"))
    sources = none.select("lease_id", F.lit(0).alias("seq"), F.lit("").alias("key"), F.lit("").alias("reference"), F.lit("").alias("url"))
    rows = reporting.report_rows(leases, clauses, clashes, sources)
    return _answered(rows, "lease_id", overall_risk_score="overall", overall_risk_level="level", executive_summary="summary", risk_distribution="levels", total_clauses_analyzed="clauses", red_flags="red_flags", negotiation_points="points")


_CLAUSE = "struct<id:string,text:string,type:string>"
TOOLS = {
    t.name: t
    for t in (
        Tool("parse_document", "pages array<string>", ("pages",), _parse_document),
        Tool("detect_jurisdiction", "raw_text string", ("raw_text",), _detect_jurisdiction),
        Tool("segment_clauses", "raw_text string", ("raw_text",), _segment_clauses),
        Tool("classify_clause", "clause_id string, clause_text string", ("clause_id", "clause_text"), _classify_clause),
        Tool("lookup_statute", "clause_text string, clause_type string", ("clause_text", "clause_type"), _lookup(False)),
        Tool("lookup_tribunal", "clause_text string, clause_type string", ("clause_text", "clause_type"), _lookup(True)),
        Tool("score_risk", "clause_text string, clause_type string, retrieved_statutes array<struct<section:string,text:string,relevance:double>>", ("clause_text", "clause_type"), _score_risk),
        Tool("detect_contradiction", f"clause_a {_CLAUSE}, clause_b {_CLAUSE}", ("clause_a", "clause_b"), _detect_contradiction),
        Tool("check_missing", "found_clause_types array<string>, jurisdiction_code string", ("found_clause_types", "jurisdiction_code"), _check_missing),
        Tool("benchmark_clause", "clause_type string, risk_score double", ("clause_type", "risk_score"), _benchmark_clause),
        Tool("generate_negotiation", "clause_id string, clause_text string, clause_type string, risk_score double", ("clause_id", "clause_text", "clause_type", "risk_score"), _generate_negotiation),
        Tool("generate_report", "jurisdiction string, missing array<int>, analyzed_clauses array<struct<seq:int,number:string,clause_type:string,risk_score:double,void:boolean,text:string>>", ("jurisdiction", "analyzed_clauses"), _generate_report),
    )
}


def _lacking(given: Column, needs: tuple[str, ...]) -> Column:
    """The fields of ``needs`` that an input lacks."""
    return F.filter(F.array(*(F.when(given[f].isNull(), F.lit(f)) for f in needs)), lambda f: f.isNotNull())


def answers(calls: DataFrame, corpora: Corpora, names: tuple[str, ...] = tuple(TOOLS)) -> DataFrame:
    """call_id, tool, output (JSON) and is_error of every call (call_id, tool, input).

    call_id must be unique. An input that is no JSON object of the tool's type,
    or lacks a field that must be there, gives {"error": "Invalid input",
    "details": [the fields]}; an unknown or null tool {"error": "Unknown tool:
    ...", "available_tools": [...]}. An answer that holds an error is one. A tool
    whose corpus is not given must not be among ``names``.
    """
    out, lacks = [], []
    for name in names:
        tool = TOOLS[name]
        given = F.from_json("input", tool.takes)
        lacks.append(F.when(F.col("tool") == name, _lacking(given, tool.needs)))
        own = calls.where(F.col("tool") == name).select("call_id", given.alias("a"))
        done = tool.work(own.where(reduce(lambda x, y: x & y, (F.col(f"a.{f}").isNotNull() for f in tool.needs))), corpora)
        error = F.col("answer.error").isNotNull() if "error" in done.schema["answer"].dataType.names else F.lit(False)
        out.append(done.select("call_id", F.to_json("answer").alias("output"), error.alias("is_error"), F.lit(name).alias("tool")))
    # Wrong calls of all tools are found in one pass.
    wrong = calls.where(F.col("tool").isin(*names)).select("call_id", "tool", F.coalesce(*lacks).alias("lacking")).where(F.size("lacking") > 0)
    out.append(wrong.select("call_id", F.to_json(F.struct(F.lit("Invalid input").alias("error"), F.col("lacking").alias("details"))).alias("output"), F.lit(True).alias("is_error"), "tool"))
    unknown = calls.where(~F.coalesce(F.col("tool").isin(*names), F.lit(False)))
    said = F.struct(F.concat(F.lit("Unknown tool: "), F.coalesce("tool", F.lit("null"))).alias("error"), F.array(*map(F.lit, names)).alias("available_tools"))
    out.append(unknown.select("call_id", F.to_json(said).alias("output"), F.lit(True).alias("is_error"), "tool"))
    return reduce(DataFrame.unionByName, out).select("call_id", "tool", "output", "is_error")
