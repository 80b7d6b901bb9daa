"""The risk catalogue over documents as clauses, with SQL made from the same rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.operators import risk
from clausegrid.plans.queries import query
from clausegrid.sources import tables

#: Sections that every clause is held against: number, text, relevance.
SECTIONS = (
    ("26", "A landlord may enter with written notice at least 24 hours before.", 0.9),
    ("105", "The only deposit a landlord may collect is the last month of rent.", 0.8),
    ("120", "No increase above the guideline; notice of 90 days.", 0.7),
    ("4", "A provision that conflicts is void; nobody can waive it or contract out.", 0.6),
    ("134", "No additional charge or fee.", 0.6),
    ("28", "Privacy and exclusive possession of the unit.", 0.55),
    ("22", "No interference with reasonable enjoyment.", 0.4),
)
#: Wordings added to the texts in turn, so that the rules have something to find.
WORDINGS = (
    "The landlord may enter the unit at any time without notice.",
    "The landlord may enter with 24 hours written notice, save in an emergency.",
    "A non-refundable deposit is due.",
    "The deposit is the last month of rent.",
    "The landlord may increase rent by any amount.",
    "The tenant waives every right and protection; no court shall hear it.",
    "Late rent costs $25 per day.",
    "Cameras are placed inside the unit.",
    "Guests pay $20 per person per night.",
    "The landlord may change the locks; verbal notice is enough to vacate.",
    "The tenant shall repair the furnace and bear all costs of repair.",
    "No pets; the tenant keeps the unit clean and tidy.",
    "This lease supersedes provincial law, without exception.",
    "Lease break fee applies on early termination.",
    "Utilities are as required by the act.",
)
TYPES = ("entry_rights", "security_deposit", "rent_increase", "utilities", "pets", "rent_payment", "maintenance_repairs")


def _any(phrases: tuple[str, ...]) -> str:
    quoted = [(p[0] == "~", p.lstrip("~").replace("'", "''")) for p in phrases]
    return "(" + " OR ".join(f"regexp_matches(t, '{p}')" if pattern else f"contains(t, '{p}')" for pattern, p in quoted) + ")"


def _rule(rule: risk.Rule) -> str:
    return " AND ".join([*(_any(g) for g in rule.every), *([f"NOT {_any(rule.none)}"] if rule.none else [])])


def _applies(rule: risk.Rule, number: str, law: str) -> bool:
    at = not rule.sections or any(number.startswith(s[:-1]) if s.endswith("*") else number == s for s in rule.sections)
    return at and (not rule.law or any(w in law.lower() for w in rule.law))


def _violation(number: str, law: str) -> str:
    complies = [f"({_rule(r)})" for r in risk.COMPLIANT if _applies(r, number, law)]
    cases = [f"WHEN {' OR '.join(complies)} THEN NULL"] if complies else []
    cases += [f"WHEN {_rule(r)} THEN '{r.name}'" for r in risk.VIOLATIONS if _applies(r, number, law)]
    return f"CASE {' '.join(cases)} END" if cases else "NULL"


def _points(rules: tuple[risk.Rule, ...]) -> str:
    return " + ".join(f"CASE WHEN {_rule(r)} THEN {r.points} ELSE 0 END" for r in rules)


def _in(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _alternatives(rules: tuple[risk.Rule, ...]) -> str:
    return " OR ".join(f"({_rule(r)})" for r in rules)


def _by_text() -> str:
    names = list(dict.fromkeys(r.name for r in risk.TEXT_VIOLATIONS))
    return ", ".join(f"CASE WHEN {_alternatives(tuple(r for r in risk.TEXT_VIOLATIONS if r.name == n))} THEN '{n}' END" for n in names)


_RELEVANT = [s for s in SECTIONS if s[2] >= risk.RELEVANT]


def _index(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][1 + doc_id % {len(values)}]"


RISK_SQL = f"""
WITH c AS (SELECT doc_id, {_index(TYPES)} AS kind, lower(concat(coalesce(text, ''), ' ', {_index(WORDINGS)})) AS t FROM documents),
u AS (SELECT *, list_filter([{", ".join(f"({_violation(n, law)})" for n, law, _ in _RELEVANT)}], lambda x: x IS NOT NULL) AS u, {_any(risk.DEFERS)} AS defers FROM c),
v AS (SELECT *, list_concat(u, list_filter([{_by_text()}], lambda x: x IS NOT NULL AND NOT list_contains(u, x))) AS v FROM u),
b AS (SELECT *, least(10, CAST(CASE WHEN kind IN {_in(risk.PLAIN_TYPES)} THEN 1 ELSE 3 END AS DOUBLE)
        + least(CAST(2 AS DOUBLE), CAST(0.7 AS DOUBLE) * ({" + ".join(f"CAST(regexp_matches(t, '{p}') AS INTEGER)" for p in risk.RESTRICTIVE)}))
        + CASE WHEN {" OR ".join(f"regexp_matches(t, '{p}')" for p in risk.UNUSUAL)} THEN CAST(1.5 AS DOUBLE) ELSE 0 END + CASE WHEN kind IN {_in(risk.HIGH_TYPES)} AND NOT defers THEN 1 ELSE 0 END) AS x0 FROM v),
c1 AS (SELECT *, CASE WHEN kind = 'entry_rights' AND {_any(("24 hour", "24-hour"))} AND {_any(risk.WRITTEN)} THEN least(x0, 3) ELSE x0 END AS x1 FROM b),
c2 AS (SELECT *, CASE WHEN kind = 'entry_rights' AND {_any(risk.EMERGENCY)} THEN greatest(1, x1 - 1) ELSE x1 END AS x2 FROM c1),
c3 AS (SELECT *, CASE WHEN kind = 'security_deposit' AND contains(t, 'last month') AND NOT {_any(risk.NO_REFUND)} THEN least(x2, 2) ELSE x2 END AS x3 FROM c2),
c5 AS (SELECT *, CASE WHEN kind = 'pets' AND {_any(risk.PET_BANS)} AND NOT {_any(risk.PET_ENFORCED)} THEN least(x3, 3)
        WHEN kind = 'rent_payment' AND NOT {_any(risk.RENT_PROHIBITED)} THEN least(x3, 4)
        WHEN kind = 'maintenance_repairs' AND {_any(risk.CLEANLINESS)} AND NOT {_any(risk.MORE_THAN_CLEANING)} THEN least(x3, 3) ELSE x3 END AS x5 FROM c3),
c4 AS (SELECT *, CASE WHEN defers THEN greatest(1, x5 - 1) ELSE x5 END + least(4, 3 * len(v)) + {_points(risk.BONUSES)} + CASE WHEN {_alternatives(risk.EVICTS)} THEN {risk.EVICTS_POINTS} ELSE 0 END AS raw FROM c5),
s AS (SELECT *, greatest(CASE WHEN len(list_filter(v, lambda x: x IN {_in(risk.CRITICAL)})) > 0 THEN 7 WHEN len(v) > 0 THEN 5 ELSE 1 END, floor(least(10, greatest(1, raw)) + 0.5)) AS x FROM c4)
SELECT doc_id, kind AS clause_type, array_to_string(v, ',') AS violations, CAST(x AS DOUBLE) AS risk_score,
       CASE WHEN x <= 3 THEN 'low' WHEN x <= 6 THEN 'medium' WHEN x <= 8 THEN 'high' ELSE 'critical' END AS risk_level, len(v) > 0 AS unenforceable FROM s"""


@query(RISK_SQL)
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("doc_id") % len(values) + 1).cast("int"))
    law = F.array(*(F.struct(F.lit(n).alias("section"), F.lit(t).alias("text"), F.lit(r).alias("relevance")) for n, t, r in SECTIONS))
    clauses = tables.table(spark, sf_dir, "documents").select(
        "doc_id",
        pick(TYPES).alias("clause_type"),
        F.concat(F.coalesce("text", F.lit("")), F.lit(" "), pick(WORDINGS)).alias("text"),
        law.alias("statutes"),
    )
    return risk.scored(clauses).select("doc_id", "clause_type", F.array_join("violations", ",").alias("violations"), "risk_score", "risk_level", "unenforceable")
