"""A lease's report as one row, how it is shown, and the letter that asks for changes.

A report holds all that was found about one lease, so a lease's clauses meet in
its row; leases are independent of each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions.cleaning import title_case
from clausegrid.functions.numbers import clamp
from clausegrid.operators import alignment, portfolio, reports
from clausegrid.operators.reports import _words

#: Clauses of this score or more are red flags.
RED_FLAG = 6
# What a clause of a type should say instead; entry rights go on if the clause was longer than 100 signs.
COUNTER_LANGUAGE = {
    "entry_rights": "The Landlord shall provide the Tenant with at least twenty-four (24) hours written notice before entering the rental unit, specifying the reason for entry and the time of entry (which must be between 8:00 a.m. and 8:00 p.m.). Emergency entry is permitted without notice only where there is an immediate threat to life or property. ",
    "security_deposit": "The Tenant has paid a last month's rent deposit equal to one (1) month's rent at the commencement of this tenancy. This deposit shall be applied to the final month of the tenancy. No other deposit, damage deposit, or security fee is payable. The Landlord shall pay interest on this deposit annually in accordance with the Residential Tenancies Act, 2006, s.106.",
    "early_termination": "If the Tenant vacates the rental unit before the expiry of the fixed term, the Tenant's liability is limited to the lesser of: (a) two (2) months' rent; or (b) the actual rent lost by the Landlord until a replacement tenant is found, less any amount the Landlord saved by the early vacation. The Landlord must make reasonable efforts to re-rent the unit to mitigate losses.",
    "dispute_resolution": "Any dispute arising from this tenancy shall be resolved in accordance with the Residential Tenancies Act, 2006. Either party may apply to the Landlord and Tenant Board for resolution. Nothing in this agreement limits either party's right to file an LTB application. Mediation may be used voluntarily as a first step, but is not mandatory.",
    "rent_increase": "Rent increases shall not exceed the annual rent increase guideline published by the Ontario Ministry of Municipal Affairs and Housing. The Landlord shall provide at least ninety (90) days written notice of any rent increase. No more than one rent increase shall occur in any twelve (12) month period.",
    "liability_indemnification": "The Tenant shall be responsible for damages caused by the Tenant's own negligence or intentional acts. The Landlord shall not be indemnified for damages caused by the Landlord's own negligence, failure to maintain the unit, or breach of the Residential Tenancies Act, 2006. Nothing in this clause limits either party's rights under the RTA.",
    "subletting_assignment": "The Tenant may sublet or assign the rental unit with the prior written consent of the Landlord. The Landlord shall not arbitrarily or unreasonably withhold consent. If the Landlord withholds consent, the Landlord shall provide written reasons within 7 days. The parties acknowledge the Tenant's rights under RTA s.97.",
    "maintenance_repairs": "The Landlord shall maintain the rental unit and residential complex in a good state of repair, fit for habitation, and in compliance with all applicable health, safety, and maintenance standards, as required by the Residential Tenancies Act s.20 and Ontario Regulation 517/06. The Landlord shall respond to repair requests within 24 hours for urgent matters and 7 business days for non-urgent matters.",
}
LONG_ENTRY, REST_UNCHANGED = 100, "All other provisions of this clause remain unchanged."
OTHER_LANGUAGE = ("[The ", " clause should be amended to comply with the Residential Tenancies Act, 2006. Consult a paralegal for specific replacement language.]")
# How a letter begins and ends, by tone; unknown tones are formal.
LETTER_OPENINGS = {
    "cooperative": "I hope this message finds you well. I'm reaching out ahead of signing to discuss a few clauses in our lease agreement. I want to ensure we start the tenancy on a clear and positive footing, and I believe addressing these points now will prevent misunderstandings for both of us down the road.",
    "assertive": 'I am writing regarding several provisions in the proposed lease agreement for the above premises. After reviewing the agreement against the Ontario Residential Tenancies Act, R.S.O. 2006, c. 17 (the "RTA"), I have identified clauses that are inconsistent with mandatory statutory protections. Pursuant to RTA s.3(1), any provision that purports to negate or modify a tenant\'s rights under the Act is void. I am requesting the following amendments as a condition of signing.',
    "formal": "I am writing with respect to the residential tenancy agreement for the above-noted premises. Upon careful review, I have identified provisions that require amendment prior to execution in order to bring the agreement into conformity with applicable Ontario tenancy law. I respectfully request that the following amendments be incorporated into the final agreement.",
}
LETTER_CLOSINGS = {
    "cooperative": "I am very much looking forward to this tenancy and hope we can resolve these points quickly. Please don't hesitate to call me if you'd like to discuss any of this in person. I've attached a formal Lease Amendment Addendum for your convenience.\n\nWarm regards",
    "assertive": "Please confirm your agreement to the proposed amendments in writing within seven (7) days. I have prepared a Lease Amendment Addendum (attached) which may be signed alongside the original lease. Should you require clarification on any of the statutory references, I am happy to provide them.\n\nYours truly",
    "formal": "I have prepared a Lease Amendment Addendum setting out the proposed replacement language for each affected clause. Please review and advise whether the amendments are acceptable at your earliest convenience.\n\nRespectfully",
}
LETTER_LINES = ("Proposed Lease Amendments — ", "Lease Amendment Addendum — ", "Re: Proposed Amendments to Lease Agreement — ", "The following clauses require amendment:", "This clause is amended to comply with the Ontario Residential Tenancies Act. ")
ADDENDUM_INTRO = (
    'This Lease Amendment Addendum ("Addendum") is entered into between ',
    ' (the "Landlord") and ',
    ' (the "Tenant") with respect to the residential tenancy agreement for the premises municipally known as ',
    ' (the "Agreement"). This Addendum supplements and amends the Agreement. In the event of any conflict between this Addendum and the Agreement, this Addendum shall prevail. All other terms and conditions of the Agreement remain in full force and effect.',
)
# Where each risk level begins and ends on the ruler of scores.
BANDS = {"low": (0.0, 3.0), "medium": (3.0, 5.5), "high": (5.5, 8.0), "critical": (8.0, 10.0)}
# A replay's length, the least share of a step and the bounds of its delay, in ms.
REPLAY_MS, LEAST_STEP_MS, DELAY_MS = 15_000, 100, (80, 1200)


def _by(column: Column, values: dict[str, str], default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), column), default)


def counter_language(kind: Column, text: Column) -> Column:
    """What a clause of this type should say instead; other types get a hint."""
    other = F.concat(F.lit(OTHER_LANGUAGE[0]), _words(kind), F.lit(OTHER_LANGUAGE[1]))
    more = F.when((kind == "entry_rights") & (F.length(text) > LONG_ENTRY), REST_UNCHANGED).otherwise("")
    return F.concat(_by(kind, COUNTER_LANGUAGE, other), more)


def band_position(score: Column, level: Column) -> Column:
    """How far a score stands within the band of its level, from 0 to 100; unknown levels count as critical."""
    edge = lambda k: _by(level, {n: b[k] for n, b in BANDS.items()}, F.lit(BANDS["critical"][k]))
    return clamp((score - edge(0)) / (edge(1) - edge(0)) * 100, F.lit(0.0), F.lit(100.0))


def replay_delay(duration_ms: Column, total_ms: Column) -> Column:
    """How long a step is shown in a replay, in ms: by its share of the whole, within bounds; null durations count as 0."""
    share = F.greatest(F.coalesce(duration_ms, F.lit(0)), F.lit(LEAST_STEP_MS)) / F.greatest(total_ms, F.lit(1))
    return clamp(share * REPLAY_MS, F.lit(float(DELAY_MS[0])), F.lit(float(DELAY_MS[1])))


def letters(leases: DataFrame, items: DataFrame) -> DataFrame:
    """lease_id, subject, body, addendum_title, addendum_intro and addendum, the changed clauses.

    Leases need lease_id, tenant, landlord, address, tone; items lease_id, seq,
    number, heading, ask, section (of the first violation, or null), argument,
    counter. A lease without items has no letter. An assertive letter argues each
    clause; a clause without wording of its own is changed as it was asked for.
    """
    section = F.when(F.col("section").isNotNull() & (F.col("section") != ""), F.concat(F.lit(" ("), "section", F.lit(")"))).otherwise("")
    line = F.concat(F.lit("Clause "), "number", F.lit(" — "), "heading", F.lit(": "), "ask", section)
    reason = F.concat(F.lit("Regarding Clause "), "number", F.lit(" ("), "heading", F.lit("): "), F.coalesce("argument", F.lit("")))
    proposed = F.coalesce(F.nullif(F.trim("counter"), F.lit("")), F.concat(F.lit(LETTER_LINES[4]), "ask"))
    rows = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"), reason.alias("reason"), "number", "heading", proposed.alias("text"))))
    joined = items.groupBy("lease_id").agg(rows.alias("i")).join(leases, "lease_id")
    tone = F.when(F.col("tone").isin(*LETTER_OPENINGS), F.col("tone")).otherwise("formal")
    listed = F.array_join(F.transform("i", lambda x, n: F.concat((n + 1).cast("string"), F.lit(". "), x["line"])), "\n")
    argued = F.when(tone == "assertive", F.concat(F.array_join(F.transform("i", lambda x: x["reason"]), "\n\n"), F.lit("\n\n"))).otherwise("")
    greeting = F.concat(F.lit("Dear "), "landlord", F.lit(",\n\n"), F.lit(LETTER_LINES[2]), "address", F.lit("\n\n"), _by(tone, LETTER_OPENINGS, F.lit("")))
    body = F.concat(greeting, F.lit("\n\n" + LETTER_LINES[3] + "\n\n"), listed, F.lit("\n\n"), argued, _by(tone, LETTER_CLOSINGS, F.lit("")), F.lit(",\n"), "tenant")
    return joined.select(
        "lease_id",
        F.concat(F.lit(LETTER_LINES[0]), "address").alias("subject"),
        body.alias("body"),
        F.concat(F.lit(LETTER_LINES[1]), "address").alias("addendum_title"),
        F.concat(F.lit(ADDENDUM_INTRO[0]), "landlord", F.lit(ADDENDUM_INTRO[1]), "tenant", F.lit(ADDENDUM_INTRO[2]), "address", F.lit(ADDENDUM_INTRO[3])).alias("addendum_intro"),
        F.transform("i", lambda x: F.struct(x["number"].alias("number"), x["heading"].alias("heading"), x["text"].alias("text"))).alias("addendum"),
    )


def report_rows(leases: DataFrame, clauses: DataFrame, contradictions: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each lease: its risk, the counts of levels, red_flags, contradictions, missing, points, sources and summary.

    Leases need lease_id, jurisdiction, missing (an array); clauses lease_id,
    seq, number, clause_type, risk_score, heavy, void and text;
    contradictions lease_id, id_a, id_b, kind, severity, has_contradiction;
    sources lease_id, seq, key, reference, url. Red flags go by falling score,
    then by clause; of contradictions those that are some, of points those that
    are negotiable; each source once, where it was first used. A lease without
    clauses has score 0.
    """
    asked = reports.negotiation_points(clauses)
    own = F.struct("seq", "number", "clause_type", "risk_score", portfolio.risk_level(F.col("risk_score")).alias("risk_level"), "void")
    falling = lambda a, b: F.when(a["risk_score"] != b["risk_score"], F.when(a["risk_score"] > b["risk_score"], -1).otherwise(1)).when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)
    point = F.struct("seq", "clause_type", "priority", "ask", counter_language(F.col("clause_type"), F.col("text")).alias("counter"), "walk_away")
    per = asked.groupBy("lease_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("risk_score") >= RED_FLAG, own)), falling).alias("red_flags"),
        F.array_sort(F.collect_list(F.when(F.col("negotiable"), point))).alias("points"),
        F.count(F.lit(1)).cast("int").alias("clauses"),
    )
    clashes = contradictions.where("has_contradiction").groupBy("lease_id").agg(F.array_sort(F.collect_list(F.struct("id_a", "id_b", "kind", "severity"))).alias("contradictions"))
    used = sources.groupBy("lease_id", "key").agg(F.min(F.struct("seq", "reference", "url")).alias("s")).groupBy("lease_id").agg(F.array_sort(F.collect_list(F.struct("s.seq", "key", "s.reference", "s.url"))).alias("sources"))
    risk = portfolio.overall_risk(clauses).select("lease_id", "overall", "level")
    levels = portfolio.risk_distribution(clauses).select("lease_id", F.struct("low", "medium", "high", "critical").alias("levels"))
    joined = reduce(lambda a, b: a.join(b, "lease_id", "left"), (per, clashes, used, risk, levels), leases)
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(joined.schema[c].dataType))
    rows = joined.withColumns({c: empty(c) for c in ("red_flags", "points", "contradictions", "sources", "missing")} | {"clauses": F.coalesce("clauses", F.lit(0)), "overall": F.coalesce("overall", F.lit(0.0)), "level": F.coalesce("level", F.lit("low"))})
    counts = rows.select("lease_id", "jurisdiction", "overall", "level", "clauses", *(F.size(a).alias(b) for a, b in (("red_flags", "red_flags"), ("missing", "missing"), ("contradictions", "contradictions"), ("points", "negotiable"))))
    said = reports.summary(counts).select("lease_id", "summary")
    return rows.join(said, "lease_id")


def shown_contradictions(contradictions: DataFrame, clauses: DataFrame) -> DataFrame:
    """lease_id, n, label_a, label_b, kind and severity: the heading or number of each clause, or what the kind says.

    Contradictions need lease_id, n, id_a, id_b, kind, severity; clauses
    lease_id, id, number, heading, with an id once in a lease. A clause that is
    not found is called after its part of a kind like "a_vs_b", else Clause A and
    Clause B. Without a kind it is a direct_conflict, without a severity medium.
    """
    label = F.coalesce(F.nullif("heading", F.lit("")), F.concat(F.lit("Clause "), F.coalesce("number", F.lit(""))))
    kind = F.coalesce("kind", F.lit(""))
    parts = F.split(kind, "_vs_")
    from_kind = lambda n, other: F.when(kind.contains("_vs_"), title_case(_words(F.get(parts, F.lit(n))))).otherwise(other)
    out = contradictions
    for side, n in (("a", 0), ("b", 1)):
        names = clauses.select(F.col("lease_id").alias("_lease"), F.col("id").alias("_id"), label.alias(f"_label_{side}"))
        out = out.join(names, (F.col("lease_id") == F.col("_lease")) & (F.col(f"id_{side}") == F.col("_id")), "left").drop("_lease", "_id")
        out = out.withColumn(f"label_{side}", F.coalesce(f"_label_{side}", from_kind(n, f"Clause {side.upper()}"))).drop(f"_label_{side}")
    return out.select("lease_id", "n", "label_a", "label_b", F.coalesce(F.nullif("kind", F.lit("")), F.lit("direct_conflict")).alias("kind"), F.coalesce("severity", F.lit("medium")).alias("severity"))


def shown_missing(missing: DataFrame) -> DataFrame:
    """Adds name, shown_severity and suggested to missing protections. Needs clause_type, protection_name, severity, suggested_addition; any may be null."""
    named = F.coalesce("clause_type", "protection_name", F.lit("missing protection"))
    severity = F.when(F.col("severity") == "critical", "critical").when(F.col("severity").isin("high", "important"), "important").otherwise("minor")
    suggested = F.coalesce("suggested_addition", F.concat(F.lit("Include a clause addressing "), _words(F.coalesce("clause_type", F.lit("this protection"))), F.lit(".")))
    return missing.withColumns({"name": title_case(_words(named)), "shown_severity": severity, "suggested": suggested})


def shown_points(points: DataFrame) -> DataFrame:
    """Adds id and label to a lease's points and fills what is not given. Needs n (from 0), clause_id, clause_type, priority, negotiable, walk_away, ask."""
    label = F.when(F.coalesce("clause_type", F.lit("")) != "", title_case(_words(F.col("clause_type")))).otherwise(F.concat(F.lit("Clause "), F.col("n") + 1))
    return points.withColumns(
        {
            "id": F.coalesce("clause_id", F.concat(F.lit("neg-"), "n")),
            "label": label,
            "priority": F.coalesce("priority", F.lit("medium")),
            "negotiable": F.coalesce("negotiable", F.lit(True)),
            "walk_away": F.coalesce("walk_away", F.lit(False)),
            "ask": F.coalesce("ask", F.lit("")),
        }
    )


def shown_clauses(clauses: DataFrame) -> DataFrame:
    """The clauses that are printed, with what is not given filled and compliant, what they could say instead.

    Needs number, heading, risk_score, risk_level, suggested and sections, the
    sections of their violations in order.
    """
    kept = reports.printed(clauses.withColumn("number", F.coalesce("number", F.lit(""))))
    wording = alignment.compliant_wording(F.coalesce("sections", F.array().cast("array<string>")))
    return kept.withColumns(
        {
            "heading": F.coalesce("heading", F.lit("")),
            "risk_score": F.coalesce("risk_score", F.lit(0.0)),
            "risk_level": F.coalesce("risk_level", F.lit("low")),
            "compliant": F.coalesce(F.nullif("suggested", F.lit("")), wording["wording"]),
        }
    )


def shown_lease(leases: DataFrame) -> DataFrame:
    """Adds shown_address, shown_city and file_name. Needs address, unit, city, file_path; any may be null."""
    given = F.coalesce("address", F.lit(""))
    unit = F.coalesce("unit", F.lit(""))
    address = F.when(given == "", "Rental Unit").when(unit != "", F.concat(unit, F.lit(" – "), given)).otherwise(given)
    return leases.withColumns({"shown_address": address, "shown_city": F.coalesce("city", F.lit("")), "file_name": F.element_at(F.split(F.coalesce("file_path", F.lit("")), "/"), -1)})


def with_points(clauses: DataFrame, points: DataFrame) -> DataFrame:
    """Clauses with ask, counter and argument of their first point; without one, empty. Needs clause_id; points clause_id, n, ask, counter, argument."""
    first = points.groupBy("clause_id").agg(F.min(F.struct("n", "ask", "counter", "argument")).alias("p"))
    filled = {c: F.coalesce(F.col(f"p.{c}"), F.lit("")) for c in ("ask", "counter", "argument")}
    return clauses.join(first, "clause_id", "left").withColumns(filled).drop("p")


def cards(leases: DataFrame) -> DataFrame:
    """Adds title, subtitle and attention to leases as a dashboard shows them. Needs status, score, display_title, address, city, file_path; any may be null.

    The title is the one given, else the address, else the file's name without
    its extension; the subtitle the city, else the file's name. Complete leases
    of high or critical risk need attention.
    """
    file = F.element_at(F.split(F.coalesce("file_path", F.lit("")), "/"), -1)
    risky = portfolio.risk_level(F.col("score")).isin("high", "critical")
    attention = (F.col("status") == "complete") & F.col("score").isNotNull() & risky
    return leases.withColumns({"title": F.coalesce("display_title", "address", F.regexp_replace(file, r"\.[^.]+$", "")), "subtitle": F.coalesce("city", file), "attention": F.coalesce(attention, F.lit(False))})


def top_card(leases: DataFrame) -> DataFrame:
    """The complete lease with the highest score, ties to the smaller id; no row without one. Needs id, status, score."""
    return leases.where((F.col("status") == "complete") & F.col("score").isNotNull()).orderBy(F.desc("score"), "id").limit(1)
