"""Deterministic risk scores of clauses from a catalogue of rules.

A rule is data: groups of phrases of which each needs one present, phrases of
which none may be, the sections that it looks at and words of the section's
text. The catalogue makes Column expressions here and SQL text for the oracle
from the same rows. A phrase that starts with ``~`` is a pattern.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions.texts import found
from clausegrid.operators.portfolio import risk_level

RELEVANT = 0.5

Group = tuple[str, ...]


@dataclass(frozen=True)
class Rule:
    """``every`` group has a phrase in the text and ``none`` has; ``sections`` ending in * are prefixes; ``law`` words stand in the section."""

    name: str
    every: tuple[Group, ...]
    none: Group = ()
    sections: Group = ()
    law: Group = ()
    points: float = 0.0


# Phrases that several rules share.
FULL_DAY = ("24 hour", "24-hour", "twenty-four hour")
WRITTEN = ("written notice", "notice in writing")
EMERGENCY = ("emergency", "urgent repair", "urgent maintenance")
SERVICES = ("heat", "hydro", "water", "gas", "electricity", "utilities")
POST_DATED = ("post-dated", "postdated", "post dated")
OPTIONAL = ("not required", "voluntarily", "optional", "may be provided")
NO_REFUND = ("non-refundable", "nonrefundable")

# Wordings that comply with a section, which is then not looked at further.
COMPLIANT = (
    Rule("full_notice", (FULL_DAY, WRITTEN), sections=("26", "27", "26.*", "27.*")),
    Rule("defers", (("in accordance with", "pursuant to", "as required by", "as permitted by"), ("residential tenancies act", "rta", "the act")), sections=("26", "27")),
    Rule("emergency", (EMERGENCY,), sections=("26", "26.*")),
    Rule("last_month", (("last month",),), NO_REFUND, ("105", "106*")),
    Rule("clean", (("ordinary cleanliness", "reasonable cleanliness", "clean and tidy"),), sections=("20",)),
    Rule("cleaning_only", (("clean",),), ("responsible for all repair", "responsible for maintenance", "plumbing", "electrical"), ("20",)),
    Rule("guideline", (("guideline", "in accordance with", "as permitted by"),), sections=("116", "120", "128")),
    Rule("no_cheques", (), (*POST_DATED, "automatic payment", "pre-authorized"), ("108",)),
    Rule("cheques_optional", (OPTIONAL,), sections=("108",)),
    Rule("enjoyment", (("quiet enjoyment", "reasonable enjoyment"),), ("any time", "at landlord's convenience"), ("22", "22.*")),
    Rule("services_included", (("included", "landlord provides", "landlord shall provide", "is responsible for"), SERVICES), sections=("29", "30", "31")),
    Rule("continues", (("month-to-month", "month to month"), ("continue", "continuation", "convert")), sections=("38",)),
    Rule(
        "consent",
        (("with written consent", "with the written consent", "with consent", "subject to landlord", "not to be unreasonably withheld", "not unreasonably withheld", "shall not arbitrarily"),),
        ("no assignment", "no subletting", "not permitted", "prohibited"),
        ("95", "97", "95.*", "97.*"),
    ),
    Rule("yearly", (("once per year", "once a year", "once per 12 month", "annually", "once every 12 month"), ("guideline", "in accordance")), sections=("119", "119.*")),
)

# Violations that a relevant section shows, in order; the first one counts.
VIOLATIONS = (
    Rule("entry_without_notice", (("enter", "access"), ("without notice", "any time")), ("emergency", "urgent", "in accordance", "except", "unless", "pursuant to"), law=("24", "notice")),
    Rule(
        "entry_without_notice",
        (("enter", "access"), ("notice",)),
        ("24 hour", "24-hour", "written notice", "emergency", "urgent", "in accordance", "except", "unless", "pursuant to"),
        ("26*", "27*"),
        ("24", "notice"),
    ),
    Rule("non_refundable_deposit", (NO_REFUND, ("deposit",)), law=("deposit",)),
    Rule(
        "rent_increase_without_guideline",
        (("rent increase", "increase rent", "~increas.*rent"), ("any amount", "~landlord.*may.*increas", "sole discretion", "~(^|[^0-9a-z_])(30|60)\\s*day")),
        ("guideline", "in accordance"),
        law=("guideline", "90"),
    ),
    Rule("waiver_of_rights", (("waive", "forfeit", "give up"), ("right", "protection")), law=("waiv", "contract out")),
    Rule("mandatory_arbitration", (("arbitration", "~waive.*court", "~no.*court"),), law=("board",)),
    Rule("post_dated_cheques", (POST_DATED,), OPTIONAL, ("108",)),
    Rule(
        "maintenance_offloaded",
        (
            ("tenant",),
            ("responsible for", "bear all", "bears all", "shall maintain", "shall repair", "all repair", "all maintenance", "all costs", "sole responsibility", "at the tenant's expense", "at tenant's expense"),
            ("repair", "maintenance", "plumbing", "electrical", "furnace", "hvac", "appliance", "structural"),
        ),
        sections=("20",),
    ),
    Rule("rta_waiver", (("supersede", "overrides", "provincial law", "~waive.*rta", "~rta.*waive"),), sections=("4",)),
    Rule("daily_late_fee", (("~\\$\\s*\\d+.*(per\\s*day|for\\s*each\\s*day|per\\s*diem)", "~(per\\s*day|for\\s*each\\s*day).*\\$\\s*\\d+", "~\\d+\\s*dollars?\\s*per\\s*day"),), sections=("59", "134")),
    Rule("pet_fines", (("fine", "penalty", "fee"), ("pet", "animal")), sections=("14",)),
    Rule("excess_deposit", (("deposit", "security"), (*NO_REFUND, "~\\$\\s*[2-9][\\d,]{3,}", "~(two|three|four|five|[2-5])\\s+month")), sections=("105", "106*")),
    Rule("early_termination_fee", (("lease-break", "lease break", "break fee", "liquidated damage", "~early termination.*(fee|penalt|charge|pay)", "~(fee|penalt|charge|pay).*early termination"),), sections=("37", "134")),
    Rule("surveillance_in_unit", (("camera", "surveillance", "cctv", "monitor", "recording device"), ("unit", "interior", "inside", "premises", "bedroom", "bathroom")), sections=("28",)),
    Rule("guest_surcharge", (("per night", "per-night", "~\\$\\s*\\d+.*per\\s*(guest|visitor|person)", "~per\\s*(guest|visitor|person).*\\$\\s*\\d+"),), sections=("134",)),
    Rule("assignment_fee", (("assign", "sublet", "sublease"), ("fee", "charge", "administrative", "processing"), ("~\\$\\s*\\d+",)), sections=("97",)),
    Rule(
        "vital_services_cutoff",
        (("tenant", "renter"), ("responsible for", "must ensure", "at tenant's cost", "at the tenant's cost", "not liable if", "may discontinue", "may disconnect", "cut off"), SERVICES),
        sections=("29", "30", "31"),
    ),
    Rule("quiet_enjoyment_violation", (("inspect", "enter", "access"), ("monthly", "quarterly", "regular inspection", "periodic inspection")), ("emergency", "in accordance"), ("22", "22.*")),
    Rule("quiet_enjoyment_violation", (("inspect", "enter", "access"), ("any time", "at landlord's discretion", "at landlord's convenience")), ("24 hour", "24-hour", "emergency", "in accordance"), ("22", "22.*")),
    Rule(
        "assignment_prohibition",
        (
            (
                "no assignment",
                "no subletting",
                "may not assign",
                "may not sublet",
                "not permitted to assign",
                "not permitted to sublet",
                "prohibited from subletting",
                "prohibited from assigning",
                "~(assignment|subletting).*(prohibited|forbidden|not allowed)",
            ),
        ),
        ("with consent", "with written consent", "subject to approval", "subject to landlord"),
        ("95", "97", "95.*", "97.*"),
    ),
    Rule(
        "unlawful_renewal_obligation",
        (("must give", "shall give", "required to give"), ("notice",), ("not renew", "intention to vacate", "vacate at end", "intent to vacate", "not continue")),
        sections=("38", "38.*"),
    ),
    Rule("unlawful_renewal_obligation", (("automatically renew",), ("fixed term",)), ("month-to-month",), ("38", "38.*")),
    Rule(
        "multiple_rent_increases",
        (
            ("rent increase", "increase rent", "~increas.*rent", "~rent.*increas", "rent shall be adjusted", "rent will be adjusted", "rent is adjusted", "rent adjusted"),
            ("monthly", "quarterly", "semi-annual", "biannual", "every six month", "cpi", "consumer price", "inflation index"),
        ),
        ("once per 12 month", "once every 12 month", "once per year", "once a year"),
        ("119", "119.*"),
    ),
    Rule(
        "service_reduction_no_rent_decrease",
        (
            ("may remove", "may discontinue", "reserves the right to change", "may change", "subject to change", "may modify", "amenities may", "services may", "right to remove", "right to discontinue", "right to reassign"),
            ("parking", "laundry", "storage", "locker", "amenities", "services", "facilities", "cable", "internet"),
        ),
        ("rent will be reduced", "rent reduction", "rent shall be reduced"),
        ("121", "125", "121.*", "125.*"),
    ),
    Rule(
        "retaliation_or_coercion",
        (("waive", "forfeit", "relinquish"), ("right to complain", "right to apply", "ltb", "board", "tribunal")),
        sections=("137", "138", "139", "137.*", "138.*", "139.*"),
    ),
    Rule(
        "retaliation_or_coercion",
        (("terminat", "evict"), ("any complaint", "any request", "any application", "if tenant")),
        sections=("137", "138", "139", "137.*", "138.*", "139.*"),
    ),
)
DAYS_OR_HOURS = ("~within\\s+\\d+\\s*(hour|day)",)
MAJOR_SYSTEMS = ("furnace", "plumbing", "electrical", "hvac")
ENDING = ("terminat", "vacat", "leave")
GIVES_NOTICE = ("must give", "shall give", "required to give", "obligated to give")

# Violations that the text shows by itself, in order; several rows of one name are alternatives.
TEXT_VIOLATIONS = (
    Rule("self_help_eviction", (("change the locks", "change locks", "alter the locks", "remove the tenant", "remove tenant's belongings", "seize the tenant", "tenant's belongings will be"),)),
    Rule("self_help_eviction", (("vacate",), (*DAYS_OR_HOURS, "immediately"))),
    Rule("self_help_eviction", (("leave the premises",), DAYS_OR_HOURS)),
    Rule("unlawful_termination", (("verbal", "verbally", "oral notice"), ("notice", "terminat", "vacate"))),
    Rule("unlawful_termination", (("~(^|[^0-9a-z_])([1-9]|[1-5]\\d)\\s*days?\\s*(written\\s+)?notice",), ("terminat", "vacate", "end the tenancy"))),
    Rule("rta_waiver", (("waive", "waiver"), ("all rights", "any rights", "right to dispute", "right to appeal", "right to apply", "rights under", "rta rights", "statutory rights"))),
    Rule("rta_waiver", (("by signing",), ("waive", "forfeit", "relinquish"))),
    Rule("maintenance_offloaded", (("tenant", "renter"), MAJOR_SYSTEMS, ("responsible", "bear", "cost", "repair", "maintain", "expense"))),
    Rule("early_termination_fee", (("lease-break", "lease break", "break fee"),)),
    Rule("early_termination_fee", (("liquidated damage",), ("terminat", "vacat"))),
    Rule("early_termination_fee", (("early termination",), ("fee", "penalt", "charge"), ("pay", "shall", "must"))),
    Rule("early_termination_fee", (("~(two|three|four|[2-4])\\s+month",), ENDING, ("fee", "penalt", "pay"))),
    Rule("surveillance_in_unit", (("camera", "surveillance", "cctv", "monitoring device", "recording device"), ("unit", "interior", "inside", "premises", "bedroom", "bathroom", "living"))),
    Rule("guest_surcharge", (("~\\$\\s*\\d+.*per\\s*(guest|visitor|person|night)", "~per\\s*(guest|visitor|person|night).*\\$\\s*\\d+"), ("charge", "fee", "billed", "pay", "owe"))),
    Rule("guest_surcharge", (("per night",), ("guest", "visitor"), ("~\\$\\s*\\d+",), ("charge", "fee", "billed", "pay", "owe"))),
    Rule("assignment_fee", (("assign", "sublet", "sublease"), ("fee", "charge", "administrative", "processing"), ("~\\$\\s*\\d+",))),
    Rule(
        "vital_services_cutoff",
        (
            ("tenant", "renter"),
            ("responsible for", "must ensure", "may disconnect", "may cut off", "not liable if", "at tenant's expense", "at the tenant's expense", "tenant shall pay for"),
            ("heat", "hydro", "water", "gas", "electricity"),
        ),
        ("directly to", "utility provider"),
    ),
    Rule(
        "assignment_prohibition",
        (
            (
                "no assignment",
                "no subletting",
                "may not assign",
                "may not sublet",
                "not permitted to assign",
                "not permitted to sublet",
                "~(assignment|subletting).*(prohibited|forbidden|not allowed)",
                "~(assignment|subletting).*not.*(permit|allow)",
            ),
        ),
        ("with consent", "with written consent", "subject to", "with approval", "not unreasonably", "not arbitrarily"),
    ),
    Rule(
        "unlawful_renewal_obligation",
        (GIVES_NOTICE, ("~(^|[^0-9a-z_])([3-9]\\d|[1-9]\\d{2})\\s*day",), ("not renew", "intention to vacate", "intent not to continue", "will not be continuing", "will not renew")),
    ),
    Rule("unlawful_renewal_obligation", (("automatically renew",), ("fixed term", "one year", "1 year", "~\\d+.year.term")), ("month-to-month",)),
    Rule(
        "retaliation_or_coercion",
        (
            ("waive", "waiver", "forfeit"),
            ("right to complain", "right to apply", "right to contact", "right to file", "ltb", "landlord and tenant board", "any government", "any authority"),
        ),
    ),
    Rule(
        "retaliation_or_coercion",
        (("terminat", "evict", "penalt"), ("if tenant complains", "any complaint made", "any application to", "for making any request", "for exercising")),
    ),
)
CRITICAL = ("rent_increase_without_guideline", "waiver_of_rights", "rta_waiver", "vital_services_cutoff", "multiple_rent_increases", "retaliation_or_coercion")

# Points that wordings add by themselves.
BONUSES = (
    Rule("no_refund", (NO_REFUND, ("deposit", "fee", "cleaning")), points=4),
    Rule("daily", (("~\\$\\s*\\d+.*per\\s*day", "~per\\s*day.*\\$\\s*\\d+", "~per day.*(penalty|fee|late)", "~(penalty|fee|late).*per day"),), points=4),
    Rule(
        "repairs",
        (
            (
                "100%",
                "all repairs",
                "all maintenance",
                "all costs",
                "sole responsibility",
                "bear all",
                "tenant's expense",
                "tenant shall repair",
                "tenant is responsible for repair",
                "responsible for all repair",
                "responsible for any repair",
            ),
            ("repair", "maintenance", "appliance"),
        ),
        points=3,
    ),
    Rule("systems", (("furnace", "plumbing", "electrical", "hvac", "boiler", "water heater"), ("tenant", "renter"), ("responsible", "repair", "cost", "maintain", "expense", "bear")), points=3),
    Rule("cameras", (("camera", "surveillance", "cctv", "monitoring device", "recording device"), ("unit", "premises", "living", "inside", "interior", "bedroom", "bathroom")), points=4),
    Rule("guests", (("~\\$\\s*\\d+.*per\\s*(guest|person|visitor)", "~per\\s*(guest|person|visitor).*\\$\\s*\\d+"),), points=4),
    Rule("cleaning_fee", (("cleaning fee",), ("regardless",)), points=3),
    Rule("lease_break", (("lease-break", "lease break", "break fee", "liquidated damage", "~early termination.*(fee|penalt|charge)", "~(fee|penalt|charge).*early termination"),), points=5),
    Rule("assignment_fee", (("assign", "sublet", "sublease"), ("fee", "administrative", "processing"), ("~\\$\\s*\\d+",)), points=4),
)

# Clause types by kind, and wordings that restrict a tenant or are unusual.
PLAIN_TYPES = ("standard_boilerplate", "utilities", "parking_storage", "guest_policy")
HIGH_TYPES = ("entry_rights", "early_termination", "dispute_resolution", "liability_indemnification", "security_deposit")
RESTRICTIVE = (
    "landlord.*not.*liable",
    "tenant.*waive",
    "waiver.*right",
    "no.*right.*to",
    "prohibit.*tenant",
    "tenant.*shall.*not",
    "tenant.*must.*not",
    "forfeit",
    "penalty",
    "without.*notice",
    "at.*landlord.*discretion",
    "sole.*discretion.*landlord",
    "non.refundable",
    "waive.*court",
    "mandatory.*arbitration",
    "class.*action.*waiver",
)
UNUSUAL = (
    "absolutely.*no.*right",
    "under.*no.*circumstances",
    "without.*exception",
    "irrevocably",
    "permanently.*waive",
    "forever.*waive",
    "unconditionally",
    "sole.*and.*absolute.*discretion",
    "with.*or.*without.*cause",
    "without.*reason",
)
#: A text bonus with alternatives: it counts once if any of them holds.
EVICTS, EVICTS_POINTS = (
    (
        Rule("locks", (("change the locks", "change locks", "alter the locks", "remove the tenant", "tenant's belongings will be"),)),
        Rule("locks", (("vacate",), (*DAYS_OR_HOURS, "immediately"))),
        Rule("locks", (("leave the premises",), DAYS_OR_HOURS)),
    ),
    5,
)
# Wordings that keep a cap from applying, by clause type.
PET_BANS = ("no pet", "no animals", "pets are not permitted")
PET_ENFORCED = ("fine", "penalt", "evict", "terminat", "fee", "charge")
RENT_PROHIBITED = ("post-dated", "postdated", "late fee", "late charge", "penalty", "interest on late", *NO_REFUND[:1])
CLEANLINESS = ("ordinary cleanliness", "reasonable cleanliness", "clean and tidy")
MORE_THAN_CLEANING = ("responsible for all repair", "responsible for all maintenance", "plumbing", "electrical", "structural")
TENANT_WEIGHT, LANDLORD_WEIGHT = 0.5, -0.3
DEFERS = ("residential tenancies act", "pursuant to the act", "as required by the act", "in accordance with the residential tenancies")


class Spark:
    """The catalogue's conditions as Columns."""

    @staticmethod
    def any_(text: Column, phrases: Group) -> Column:
        return reduce(lambda a, b: a | b, (found(text, text, p[1:]) if p[0] == "~" else text.contains(p) for p in phrases), F.lit(False))

    @classmethod
    def section(cls, number: Column, sections: Group) -> Column:
        return reduce(lambda a, b: a | b, (number.startswith(s[:-1]) if s.endswith("*") else number == s for s in sections), F.lit(not sections))

    @classmethod
    def holds(cls, rule: Rule, text: Column) -> Column:
        """The rule's phrases, whatever the section."""
        parts = [cls.any_(text, g) for g in rule.every] + ([~cls.any_(text, rule.none)] if rule.none else [])
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    @classmethod
    def concerns(cls, rule: Rule, number: Column, law: Column) -> Column:
        """Whether the rule looks at a section with this number and text."""
        return cls.section(number, rule.sections) & (cls.any_(law, rule.law) if rule.law else F.lit(True))


def _sum(conditions: list[Column], points: list[float]) -> Column:
    return sum((F.when(c, p).otherwise(0.0) for c, p in zip(conditions, points, strict=True)), F.lit(0.0))


def scored(clauses: DataFrame) -> DataFrame:
    """Adds violations, risk_score, risk_level, unenforceable and confidence to clauses.

    Needs text, clause_type and statutes, an array of (section, text,
    relevance), and takes decisions, an array of (outcome, relevance), where
    the clauses have it. Violations that sections show come first; those that
    the text shows follow, each kind once, unless a section has shown it. A
    blank text scores 1 with confidence 0. Without any section the score is
    capped at 5 after the level was set.
    """
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    rows = clauses.withColumn("_t", low).withColumn("_s", F.filter("statutes", lambda s: s["relevance"] >= RELEVANT))
    t = F.col("_t")

    # What the text holds is found once; each section then only asks which of it concerns it.
    rows = rows.withColumns({"_ok": F.array(*(Spark.holds(r, t) for r in COMPLIANT)), "_bad": F.array(*(Spark.holds(r, t) for r in VIOLATIONS))})

    def violation(s: Column) -> Column:
        number, law = s["section"], F.lower(s["text"])
        out = F.lit(None).cast("string")
        for k, rule in reversed(list(enumerate(VIOLATIONS))):
            out = F.when(F.col("_bad")[k] & Spark.concerns(rule, number, law), rule.name).otherwise(out)
        complies = reduce(lambda a, b: a | b, (F.col("_ok")[k] & Spark.concerns(r, number, law) for k, r in enumerate(COMPLIANT)))
        return F.when(~complies, out)

    rows = rows.withColumn("_v", F.filter(F.transform("_s", violation), lambda v: v.isNotNull())).drop("_ok", "_bad")
    alternatives: dict[str, list[Rule]] = {}
    for rule in TEXT_VIOLATIONS:
        alternatives.setdefault(rule.name, []).append(rule)
    by_text = F.array(*(F.when(reduce(lambda a, b: a | b, (Spark.holds(r, t) for r in rules)), name) for name, rules in alternatives.items()))
    blank = F.trim("_t") == ""
    by_text = F.filter(by_text, lambda v: v.isNotNull() & ~F.array_contains("_v", v))
    rows = rows.withColumn("violations", F.when(blank, F.array().cast("array<string>")).otherwise(F.concat("_v", by_text))).drop("_v")
    kind, n = F.col("clause_type"), F.size("violations")
    defers = Spark.any_(t, DEFERS)
    base = F.when(kind.isin(*PLAIN_TYPES), 1.0).otherwise(3.0)
    base = base + F.least(F.lit(2.0), 0.7 * _sum([found(t, t, p) for p in RESTRICTIVE], [1.0] * len(RESTRICTIVE)))
    base = base + F.when(reduce(lambda a, b: a | b, (found(t, t, p) for p in UNUSUAL)), 1.5).otherwise(0.0) + F.when(kind.isin(*HIGH_TYPES) & ~defers, 1.0).otherwise(0.0)
    if "decisions" in clauses.columns:
        won = lambda side: F.size(F.filter("decisions", lambda d: (d["relevance"] >= RELEVANT) & (d["outcome"] == side)))
        base = base + TENANT_WEIGHT * won("tenant_favour") + LANDLORD_WEIGHT * won("landlord_favour")
    rows = rows.withColumn("_x", F.greatest(F.lit(1.0), F.least(F.lit(10.0), base)))
    x = F.col("_x")
    x = F.when((kind == "entry_rights") & Spark.any_(t, ("24 hour", "24-hour")) & Spark.any_(t, WRITTEN), F.least(x, F.lit(3.0))).otherwise(x)
    x = F.when((kind == "entry_rights") & Spark.any_(t, EMERGENCY), F.greatest(F.lit(1.0), x - 1)).otherwise(x)
    x = F.when((kind == "security_deposit") & t.contains("last month") & ~Spark.any_(t, NO_REFUND), F.least(x, F.lit(2.0))).otherwise(x)
    x = F.when((kind == "pets") & Spark.any_(t, PET_BANS) & ~Spark.any_(t, PET_ENFORCED), F.least(x, F.lit(3.0))).otherwise(x)
    x = F.when((kind == "rent_payment") & ~Spark.any_(t, RENT_PROHIBITED), F.least(x, F.lit(4.0))).otherwise(x)
    x = F.when((kind == "maintenance_repairs") & Spark.any_(t, CLEANLINESS) & ~Spark.any_(t, MORE_THAN_CLEANING), F.least(x, F.lit(3.0))).otherwise(x)
    rows = rows.withColumn("_x", F.when(defers, F.greatest(F.lit(1.0), x - 1)).otherwise(x))
    bonus = _sum([Spark.holds(r, t) for r in BONUSES], [r.points for r in BONUSES])
    bonus = bonus + F.when(reduce(lambda a, b: a | b, (Spark.holds(r, t) for r in EVICTS)), float(EVICTS_POINTS)).otherwise(0.0)
    raw = F.col("_x") + F.least(F.lit(4.0), 3.0 * n) + bonus
    floor = F.when(F.exists("violations", lambda v: v.isin(*CRITICAL)), 7.0).when(n > 0, 5.0).otherwise(1.0)
    rows = rows.withColumn("_x", F.greatest(floor, F.floor(F.least(F.lit(10.0), F.greatest(F.lit(1.0), raw)) + 0.5)))
    relevant = F.size("_s")
    return rows.withColumns(
        {
            "risk_level": F.when(blank, "low").otherwise(risk_level(F.col("_x"))),
            "risk_score": F.when(blank, 1.0).when(F.size("statutes") == 0, F.least(F.lit(5.0), "_x")).otherwise(F.col("_x")),
            "unenforceable": ~blank & (n > 0) & (relevant > 0),
            "confidence": F.when(blank, 0.0).when(F.size("statutes") == 0, 0.3).when(relevant >= 2, 0.8).when(relevant == 1, 0.6).otherwise(0.4),
        }
    ).drop("_t", "_s", "_x")
