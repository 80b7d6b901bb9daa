"""All queries and their SQL; importing this module registers those of every part."""

from __future__ import annotations

from clausegrid.plans import event_queries, library_queries, lookup_queries, parsing_queries, place_queries, report_queries, risk_queries, search_queries, table_queries, text_queries
from clausegrid.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "event_queries", "library_queries", "lookup_queries", "parsing_queries", "place_queries", "report_queries", "risk_queries", "search_queries", "table_queries", "text_queries"]
