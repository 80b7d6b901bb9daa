"""What a reader of an analysed lease is shown: points to negotiate, summaries, missing protections, sources.

Clauses have lease_id, seq, clause_type, risk_score and text; other columns are
named in each function.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.functions.numbers import half_up
from clausegrid.operators.portfolio import risk_level

LEAST_NEGOTIABLE, HIGH, MEDIUM = 4, 8, 6
RELEVANT_LAW = 0.45
#: Clauses that a task takes, about, where leases are dealt.
CLAUSES_A_TASK = 1 << 18

# What to ask for, the other side's likely answer, and the reply, by clause type.
POINTS = {
    "entry_rights": (
        "Amend entry rights clause to explicitly require 24-hour written notice for all non-emergency entry, consistent with RTA s.27.",
        "Landlord may argue they need flexible access for inspections and repairs.",
        "The 24-hour notice requirement is mandated by Ontario RTA s.27 and cannot be contracted out of. Refusing this amendment means the current clause is unenforceable.",
    ),
    "security_deposit": (
        "Limit deposit to one month's rent (last month's rent only) and specify the conditions and timeline for return.",
        "Landlord may claim the extra deposit is for damage protection.",
        "Ontario RTA s.105 prohibits security deposits beyond last month's rent. Any amount collected beyond one month's rent is unlawfully retained and can be recovered via LTB application.",
    ),
    "early_termination": (
        "Remove or cap early termination penalties. Any penalty should not exceed two months' rent and should not apply if subletting is unreasonably withheld.",
        "Landlord may argue they need protection against lost income.",
        "Ontario law requires landlords to mitigate losses upon early termination. Uncapped penalties are likely unenforceable. The proposed language is a fair compromise.",
    ),
    "dispute_resolution": (
        "Remove mandatory arbitration clause. Tenants must retain the right to access the Landlord and Tenant Board.",
        "Landlord may prefer private arbitration to avoid LTB backlogs.",
        "Mandatory arbitration that ousts LTB jurisdiction is unenforceable in Ontario. The Residential Tenancies Act s.168 grants exclusive jurisdiction to the LTB over most tenancy disputes.",
    ),
    "rent_increase": (
        "Limit rent increases to the Ontario annual guideline and require 90 days written notice.",
        "Landlord may want flexibility to raise rent above guideline for capital improvements.",
        "Above-guideline increases require a separate LTB application (RTA s.126). The lease cannot pre-authorize above-guideline amounts.",
    ),
    "liability_indemnification": (
        "Remove blanket liability waiver. Tenant should not be liable for landlord's negligence.",
        "Landlord may argue they need liability protection for common areas and third-party claims.",
        "A blanket indemnification that covers the landlord's own negligence is against public policy. The proposed language is balanced and consistent with general tort law.",
    ),
    "subletting_assignment": (
        "Confirm sublet/assignment rights and specify that consent will not be unreasonably withheld.",
        "Landlord may want to maintain control over who occupies the unit.",
        "RTA s.97 grants tenants the right to sublet with consent. The Landlord cannot arbitrarily refuse. Unreasonable refusal entitles the tenant to file an LTB application.",
    ),
    "maintenance_repairs": (
        "Confirm landlord's statutory repair obligation and set a reasonable response timeline.",
        "Landlord may object to the specific timelines.",
        "The maintenance obligation is statutory and cannot be waived. The timeline is reasonable and protects both parties by creating clear expectations.",
    ),
}
DEFAULT_ANSWER = "The landlord may argue the current clause is standard practice."
DEFAULT_REPLY = "Standard practice does not override statutory tenant protections under the RTA."

# What every lease should have, in order: clause type and severity.
PROTECTIONS = (
    (1, "rent_payment", "high"),
    (2, "entry_rights", "high"),
    (3, "quiet_enjoyment", "high"),
    (4, "security_deposit", "high"),
    (5, "subletting_assignment", "medium"),
    (6, "maintenance_repairs", "high"),
    (7, "early_termination", "high"),
    (8, "rent_increase", "high"),
    (9, "renewal_terms", "low"),
    (10, "alterations", "low"),
    (11, "utilities", "high"),
    (12, "standard_boilerplate", "medium"),
    (13, "standard_boilerplate", "medium"),
)

# Pairs of clause types that are known to conflict: kind of conflict and severity.
KNOWN_PAIRS = (
    ("entry_rights|quiet_enjoyment", "entry_vs_quiet_enjoyment", "high"),
    ("liability_indemnification|maintenance_repairs", "maintenance_vs_indemnification", "high"),
    ("early_termination|renewal_terms", "termination_vs_renewal", "medium"),
    ("rent_increase|security_deposit", "rent_increase_vs_deposit", "medium"),
    ("early_termination|subletting_assignment", "subletting_vs_termination", "high"),
)
# Wordings that grant and that restrict.
GRANTS = (
    r"(?i)(?:landlord|tenant)\s+(?:may|shall|has\s+the\s+right|is\s+entitled|can|will)\s+(?:enter|access|inspect|terminate|increase|sublet|assign|renew)",
    r"(?i)right\s+to\s+(?:enter|access|terminate|sublet|assign|renew|increase)",
    r"(?i)permitted\s+to",
    r"(?i)allowed\s+to",
    r"(?i)entitled\s+to",
    r"(?i)may\s+(?:enter|terminate|sublet|increase)",
)
RESTRICTS = (
    r"(?i)(?:shall|will)\s+not\s+(?:enter|access|terminate|sublet|assign|renew|increase)",
    r"(?i)no\s+right\s+to",
    r"(?i)prohibited\s+from",
    r"(?i)forbidden\s+to",
    r"(?i)not\s+permitted\s+to",
    r"(?i)not\s+allowed\s+to",
    r"(?i)without\s+(?:written\s+)?consent",
    r"(?i)landlord.*sole.*discretion.*deny",
)

# Labels of a score among its peers: scores up to, percentile from, label.
PEER_LABELS = (
    (3, 70, "Lower risk than most comparable clauses"),
    (3, 40, "Typical low-risk clause for this type"),
    (3, 0, "Unusually low risk — may be missing tenant-protective language"),
    (6, 80, "Higher risk than average — this clause is more restrictive than most"),
    (6, 50, "Moderate risk, comparable to average leases"),
    (6, 30, "Below-average risk for this clause type"),
    (6, 0, "Lower risk than most comparable clauses of this type"),
    (10, 90, "Critically high risk — among the most restrictive clauses in our database"),
    (10, 70, "High risk — significantly more restrictive than typical leases"),
    (10, 50, "Above-average risk for this clause type"),
    (10, 0, "Elevated risk, but not unusual for this clause type"),
)


def _words(kind: Column) -> Column:
    return F.regexp_replace(kind, "_", " ")


def peer_label(percentile: Column, score: Column) -> Column:
    """What a percentile among peers says about a score."""
    out = F.lit(None).cast("string")
    for most, least, label in reversed(PEER_LABELS):
        out = F.when((score <= most) & (percentile >= least), label).otherwise(out)
    return out


def negotiation_points(clauses: DataFrame) -> DataFrame:
    """Adds negotiable, priority, ask, response, rebuttal and walk_away; blank, boilerplate and low-risk clauses have no point."""
    score, kind = F.col("risk_score"), F.col("clause_type")
    blank = F.coalesce(F.trim("text") == "", F.lit(True))
    yes = ~blank & (kind != "standard_boilerplate") & (score >= LEAST_NEGOTIABLE)
    pick = lambda k, default: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for n, p in POINTS.items() for x in (n, p[k]))), kind), default)
    ask = pick(0, F.concat(F.lit("Request amendment of the "), _words(kind), F.lit(" clause to align with Ontario RTA requirements.")))
    return clauses.withColumns(
        {
            "negotiable": yes,
            "priority": F.when(~yes, "low").when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low"),
            "ask": F.when(yes, ask).otherwise(""),
            "response": F.when(yes, pick(1, F.lit(DEFAULT_ANSWER))).otherwise(""),
            "rebuttal": F.when(yes, pick(2, F.lit(DEFAULT_REPLY))).otherwise(""),
            "walk_away": yes & (score >= HIGH),
        }
    )


def legal_argument(kind: Column, statutes: Column, decisions: Column) -> Column:
    """The first relevant statute and the first relevant decision for tenants, as a sentence each.

    statutes: (act, section, title, text, relevance); decisions: (case, day, principle, outcome, relevance).
    """
    law = F.get(F.filter(statutes, lambda s: s["relevance"] >= RELEVANT_LAW), F.lit(0))
    case = F.get(F.filter(decisions, lambda d: (d["relevance"] >= RELEVANT_LAW) & (d["outcome"] == "tenant_favour")), F.lit(0))
    by_law = F.concat(F.lit("Under "), law["act"], F.lit(" s."), law["section"], F.lit(" ("), law["title"], F.lit("), "), F.rtrim(F.substring(law["text"], 1, 200)), F.lit("..."))
    by_case = F.concat(F.lit("The LTB has ruled in favour of tenants on similar provisions: "), case["case"], F.lit(" ("), F.substring(case["day"], 1, 4), F.lit(") — "), case["principle"])
    none = F.concat(F.lit("This "), _words(kind), F.lit(" clause raises fairness concerns. We recommend reviewing it with a paralegal. No specific statute text was retrieved to ground a more precise legal argument."))
    return F.coalesce(F.nullif(F.concat_ws(" Furthermore, ", by_law, by_case), F.lit("")), none)


def contradiction_flags(text: Column) -> Column:
    """What a comparison needs of a clause's text: grants, restricts, and a digest of it without blanks at its ends."""
    any_ = lambda patterns: reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns))
    return F.struct(any_(GRANTS).alias("grants"), any_(RESTRICTS).alias("restricts"), F.sha2(F.trim(text).cast("binary"), 256).alias("digest"))


def conflicts(pairs: DataFrame) -> DataFrame:
    """Adds has_contradiction, kind and severity. Needs id_a, id_b, type_a, type_b, and flags_a, flags_b of contradiction_flags().

    A known pair of types conflicts if either text grants and either restricts;
    another one only if one grants what the other restricts. A clause never
    conflicts with itself or with the same text.
    """
    spark = pairs.sparkSession
    known = F.broadcast(spark.createDataFrame(list(KNOWN_PAIRS), "_key string, _kind string, _severity string"))
    flag = lambda side, name: F.col(f"flags_{side}.{name}")
    keyed = pairs.withColumn("_key", F.concat_ws("|", F.array_sort(F.array("type_a", "type_b")))).join(known, "_key", "left")
    either = (flag("a", "grants") | flag("b", "grants")) & (flag("a", "restricts") | flag("b", "restricts"))
    across = (flag("a", "grants") & flag("b", "restricts")) | (flag("a", "restricts") & flag("b", "grants"))
    apart = (F.col("id_a") != F.col("id_b")) & (flag("a", "digest") != flag("b", "digest"))
    has = apart & F.when(F.col("_kind").isNotNull(), either).otherwise(across)
    named = {"has_contradiction": has, "kind": F.when(has, F.coalesce("_kind", F.lit("generic"))), "severity": F.when(has, F.coalesce("_severity", F.lit("medium")))}
    return keyed.withColumns(named).drop("_key", "_kind", "_severity")


def detected_contradictions(pairs: DataFrame) -> DataFrame:
    """As conflicts(), of pairs that have text_a and text_b."""
    flagged = pairs.withColumns({f"flags_{s}": contradiction_flags(F.col(f"text_{s}")) for s in "ab"})
    return conflicts(flagged).drop("flags_a", "flags_b")


def model_contradictions(answers: DataFrame, least: float = 0.65) -> DataFrame:
    """Adds has_contradiction and severity to a model's answers: only sure ones count. Needs answer, confidence."""
    has = F.col("answer") & (F.col("confidence") >= least)
    return answers.withColumns({"has_contradiction": has, "severity": F.when(has, F.when(F.col("confidence") >= 0.85, "high").when(F.col("confidence") >= least, "medium"))})


def protections(leases: DataFrame) -> DataFrame:
    """Present and missing places of PROTECTIONS and their share. Needs lease_id, types (an array), supported; others have none and share 0."""
    row = lambda p: F.struct(F.lit(p[0]).alias("place"), F.lit(p[1]).alias("type"))
    every = F.array(*(row(p) for p in PROTECTIONS))
    have = F.transform(F.filter(every, lambda p: F.array_contains("types", p["type"])), lambda p: p["place"])
    none = F.array().cast("array<int>")
    out = leases.withColumn("present", F.when(F.col("supported"), have).otherwise(none))
    missing = F.array_except(F.array(*(F.lit(p[0]) for p in PROTECTIONS)), "present")
    return out.withColumns({"missing": F.when(F.col("supported"), missing).otherwise(none), "coverage": half_up(F.size("present") / len(PROTECTIONS), 2)})


# How a summary goes on, by risk level.
OPENINGS = (
    ("low", "it appears to be relatively tenant-friendly with no major red flags"),
    ("medium", "it contains several provisions worth reviewing carefully"),
    ("high", "it contains significant provisions that may restrict your rights or be difficult to enforce"),
    ("critical", "it contains critical provisions that may directly contradict Ontario tenant protection law"),
)


def summary(reports: DataFrame) -> DataFrame:
    """Adds summary, four sentences. Needs jurisdiction, overall, level, red_flags, missing, contradictions, negotiable, clauses."""
    n = lambda c: F.col(c).cast("string")
    many = lambda c, one, more: F.when(F.col(c) > 1, more).otherwise(one)
    opening = reduce(lambda out, x: F.when(F.col("level") == x[0], x[1]).otherwise(out), OPENINGS[:3], F.lit(OPENINGS[3][1]))
    first = F.concat(F.lit("This lease in "), "jurisdiction", F.lit(" scores "), n("overall"), F.lit("/10 overall risk — "), opening, F.lit(" across "), n("clauses"), F.lit(" analyzed clauses."))
    flags = F.when(F.col("red_flags") > 0, F.concat(n("red_flags"), F.lit(" high-risk clause"), many("red_flags", "", "s"), F.lit(" (red flag"), many("red_flags", "", "s"), F.lit(")")))
    clashes = F.when(F.col("contradictions") > 0, F.concat(n("contradictions"), F.lit(" internal contradiction"), many("contradictions", "", "s"), F.lit(" between clauses")))
    found = F.concat_ws(" and ", flags, clashes)
    second = F.when(found == "", "No red flags or internal contradictions were detected.").otherwise(F.concat(F.lit("The analysis identified "), found, F.lit(".")))
    absent = F.concat(n("missing"), F.lit(" required Ontario tenancy protection"), many("missing", " is", "s are"), F.lit(" absent from this lease — though statutory protections still apply by law, their absence from the lease weakens your written record."))
    third = F.when(F.col("missing") > 0, absent).otherwise("All required Ontario tenancy protections appear to be addressed in this lease.")
    asked = F.concat(n("negotiable"), F.lit(" clause"), many("negotiable", "", "s"), F.lit(" "), many("negotiable", "has been", "have been"), F.lit(" flagged for negotiation — review the negotiation points section before signing."))
    fourth = F.when(F.col("negotiable") > 0, asked).otherwise("No clauses were identified as requiring negotiation based on the risk thresholds.")
    return reports.withColumn("summary", F.concat_ws(" ", first, second, third, fourth))


def shown_by_default(points: DataFrame) -> DataFrame:
    """Points of high or medium priority; of a lease without any, all. Needs lease_id, priority."""
    urgent = F.col("priority").isin("high", "medium")
    some = F.max(F.when(urgent, 1).otherwise(0)).over(Window.partitionBy("lease_id"))
    return points.withColumn("_some", some).where(urgent | (F.col("_some") == 0)).drop("_some")


def printed(clauses: DataFrame) -> DataFrame:
    """Clauses whose number stands in the lease: those that were numbered for want of one are left out. Needs number."""
    return clauses.where(~F.col("number").startswith("synthetic"))


def leading_number(number: Column) -> Column:
    """The number that a clause number starts with, null without one: 10.2 sorts after 9."""
    return F.nullif(F.regexp_extract(number, r"^\s*(\d+)", 1), F.lit("")).cast("int")


def severity_rank(severity: Column) -> Column:
    """0 for critical, 1 for important, 2 for minor, 9 for others."""
    return F.when(severity == "critical", 0).when(severity == "important", 1).when(severity == "minor", 2).otherwise(9)


def by_lease(clauses: DataFrame) -> DataFrame:
    """The clauses, those of a lease in one task; tasks are as many as it takes, so that what one holds does not grow with the table."""
    parts = max(clauses.sparkSession.sparkContext.defaultParallelism, clauses.count() // CLAUSES_A_TASK + 1)
    return clauses.repartition(parts, "lease_id")


def _by_names(rows: DataFrame, names: Column) -> DataFrame:
    """A row for each name, named, and one for all names together, which is not."""
    named = F.transform(names, lambda x: F.struct(F.lit(True).alias("named"), x.alias("name")))
    every = F.array(F.struct(F.lit(False).alias("named"), F.lit("").alias("name")))
    return rows.withColumn("_by", F.explode(F.concat(every, F.coalesce(named, F.array().cast("array<struct<named: boolean, name: string>>"))))).select(*rows.columns, "_by.*")


def clause_sources(clauses: DataFrame, sources: DataFrame, k: int = 3) -> DataFrame:
    """lease_id, seq, source, place: the k best sources that name a clause or its type; of a lease that has none for it, the best of all.

    sources: lease_id, source, relevance, about (an array of clause places and
    types as text); a source may have several rows. Only the k best of each
    name meet the clauses. Nothing is shuffled again if both are dealt by_lease().
    """
    key, order = ["lease_id", "named", "name"], [F.desc("relevance"), "source"]
    about = _by_names(sources.select("lease_id", "source", "relevance", "about"), F.col("about")).groupBy(*key, "source").agg(F.max("relevance").alias("relevance"))
    first = about.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("place") <= k).drop("place")
    asked = _by_names(clauses.select("lease_id", "seq", "clause_type"), F.array(F.col("seq").cast("string"), "clause_type"))
    # A join by name would deal both sides anew; sorted together, the sources of a name, k at most, come before its clauses.
    both = first.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    so_far = Window.partitionBy(*key).orderBy("asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.collect_list(F.when(~F.col("asks"), F.struct("source", "relevance"))).over(so_far)
    met = both.withColumn("known", known).where("asks and name is not null").select("lease_id", "seq", "named", F.inline("known"))
    met = met.where("lease_id is not null").groupBy("lease_id", "seq", "named", "source").agg(F.max("relevance").alias("relevance"), F.count(F.lit(1)).alias("clauses"))
    # Sources that name the clause come first, and then the others are left out; without a place they can't be told to be of one clause.
    best = Window.partitionBy("lease_id", "seq", F.col("seq").isNull() & F.col("named")).orderBy(F.desc("named"), *order)
    hits = met.withColumns({"place": F.row_number().over(best), "best": F.first("named").over(best)}).where((F.col("place") <= k) & (F.col("named") == F.col("best")))
    # Clauses in the same place share the sources that name them, and have the best of all each.
    times = F.when(F.col("named"), 1).otherwise(F.col("clauses").cast("int"))
    return hits.withColumn("_time", F.explode(F.array_repeat(F.lit(1), times))).select("lease_id", "seq", "source", "place")


def dashboard(leases: DataFrame) -> DataFrame:
    """all, and how many complete leases there are of each level. Needs status, score."""
    done = leases.where("status = 'complete'").withColumn("level", risk_level(F.col("score")))
    counts = done.agg(*(F.count_if(F.col("level") == x).alias(x) for x in ("low", "medium", "high", "critical")))
    return leases.agg(F.count(F.lit(1)).alias("every")).join(F.broadcast(counts))


def walk_aways(points: DataFrame) -> DataFrame:
    """lease_id and labels: the types of clauses to walk away over, in order, joined with " and "."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("seq", _words(F.col("clause_type")).alias("name")))), lambda x: x["name"])
    return points.where("walk_away").groupBy("lease_id").agg(F.array_join(names, " and ").alias("labels"))


def proposals(points: DataFrame) -> DataFrame:
    """lease_id and body: a letter that asks for the points in order, numbered. Needs number, heading, ask, seq."""
    line = F.concat(F.lit("Clause "), "number", F.lit(" — "), "heading", F.lit(": "), "ask")
    rows = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    listed = F.array_join(F.transform(rows, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"])), "\n")
    return points.groupBy("lease_id").agg(F.concat(F.lit("The following clauses require amendment:\n\n"), listed).alias("body"))
