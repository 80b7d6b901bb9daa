"""Operators over clauses, documents, rules and events; each takes and returns DataFrames."""
