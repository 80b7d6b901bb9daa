"""Readings of JSON payloads as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that summaries keep as they are, and keys that they count.
INPUT_KEPT = ("clause_id", "clause_type", "jurisdiction_code", "ocr_fallback", "lease_id", "jurisdiction", "risk_score")
INPUT_CHARS = ("raw_text", "clause_text")
INPUT_COUNTS = (("retrieved_statutes", "retrieved_statutes_count"), ("retrieved_decisions", "retrieved_decisions_count"), ("found_clause_types", "found_count"), ("analyzed_clauses", "clause_count"))
OUTPUT_KEPT = (
    "risk_score", "risk_level", "is_potentially_unenforceable", "confidence",
    "page_count", "extraction_method", "jurisdiction", "jurisdiction_code",
    "has_contradiction", "severity", "negotiable", "priority",
    "fallback_used", "retrieval_confidence",
    "overall_risk_score", "overall_risk_level",
    "all_required_present", "coverage_score", "jurisdiction_supported",
    "primary_type", "subtype", "requires_legal_lookup",
)


def first_path(payload: Column, *paths: str) -> Column:
    """The value at the first path that the payload has."""
    return F.coalesce(*(F.get_json_object(payload, p) for p in paths))


def _fields(payload: Column) -> Column:
    """The payload's top-level keys and values; values that are no strings as JSON."""
    return F.coalesce(F.from_json(payload, "map<string,string>"), F.create_map().cast("map<string,string>"))


def _of_fields(payload: Column, work: Callable[[Column], Column]) -> Column:
    """What ``work`` makes of the payload's fields, which are read once however often it names them."""
    return F.get(F.transform(F.array(_fields(payload)), work), F.lit(0))


def _json_array(value: Column) -> Column:
    return F.when(value.startswith("["), F.json_array_length(value))


def input_summary(payload: Column) -> Column:
    """What is kept of a tool's input: some keys as they are, lengths of texts, numbers of entries."""

    def summary(fields: Column) -> Column:
        kept = F.map_filter(fields, lambda k, v: k.isin(*INPUT_KEPT))
        chars = [F.when(F.map_contains_key(fields, k), F.create_map(F.lit(f"{k}_chars"), F.length(fields[k]).cast("string"))) for k in INPUT_CHARS]
        counts = [F.when(_json_array(fields[k]).isNotNull(), F.create_map(F.lit(name), _json_array(fields[k]).cast("string"))) for k, name in INPUT_COUNTS]
        empty = F.create_map().cast("map<string,string>")
        return F.map_concat(kept, *(F.coalesce(x, empty) for x in (*chars, *counts)))

    return _of_fields(payload, summary)


def output_summary(payload: Column) -> Column:
    """What is kept of a tool's output: some scalars, and of other arrays how many entries they have."""

    def summary(fields: Column) -> Column:
        kept = F.map_filter(fields, lambda k, v: k.isin(*OUTPUT_KEPT))
        arrays = F.map_filter(fields, lambda k, v: ~k.isin(*OUTPUT_KEPT) & v.startswith("["))
        counted = F.map_from_entries(F.transform(F.map_entries(arrays), lambda e: F.struct(F.concat(e["key"], F.lit("_count")), F.json_array_length(e["value"]).cast("string"))))
        return F.map_concat(kept, counted)

    return _of_fields(payload, summary)


def wrapped_array(payload: Column, key: str) -> Column:
    """The strings of a JSON array, or of the array under ``key`` of an object; empty without either."""
    bare = F.when(payload.startswith("["), F.from_json(payload, "array<string>"))
    inside = F.from_json(F.get_json_object(payload, f"$.{key}"), "array<string>")
    return F.coalesce(bare, inside, F.array().cast("array<string>"))
