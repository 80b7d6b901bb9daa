"""Screening whole documents: personal data, kind, jurisdiction, outcome.

Word boundaries are written as lookarounds over ASCII word signs, which is what
``\\b`` means to engines that treat letters beyond ASCII as no word signs.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions.texts import found, replaced

# Personal data and what stands for it, in order; \b is a boundary of ASCII words.
PERSONAL = (
    (r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", "[NAME]"),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
    (r"\b[A-Z]\d[A-Z]\s*\d[A-Z]\d\b", "[POSTAL]"),
    (r"(?i)\b\d{1,6}\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}\s+(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Boulevard|Blvd|Crescent|Cres|Court|Ct|Lane|Ln|Way|Place|Pl)\b", "[ADDRESS]"),
    (r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[PHONE]"),
    (r"\$\s*[\d,]+(?:\.\d{2})?", "$[AMOUNT]"),
    (r"(?i)(?:Unit|Apt|Suite|Apartment)\s*#?\s*\d+[A-Z]?", "[UNIT]"),
    (r"\b\d{3}[-\s]?\d{3}[-\s]?\d{3}\b", "[ID_NUMBER]"),
)
# What a text must hold, without boundaries, where the pattern in turn is found.
PERSONAL_SIGNS = (
    r"[A-Z][a-z]+ [A-Z][a-z]",
    r"@",
    r"[A-Z]\d[A-Z]\s*\d[A-Z]\d",
    r"\d\s+[A-Za-z]{2}",
    r"\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    r"\$",
    r"[TtEe]\s*#?\s*\d",
    r"\d{3}[-\s]?\d{3}[-\s]?\d{3}",
)

# Signs of documents that are no leases, and of leases; \b as above.
RESUME = (
    r"(?i)\bcurriculum\s+vitae\b",
    r"(?i)sume\b",
    r"(?i)\bwork\s+experience\b",
    r"(?i)\bemployment\s+history\b",
    r"(?i)\bprofessional\s+experience\b",
    r"(?i)\b(bachelor|master|phd|m\.sc|b\.sc|b\.eng|honours)\b",
    r"(?i)\bgpa\b",
    r"(?i)\breferences\s+available\b",
    r"(?i)\blinkedin\.com/in/",
    r"(?i)\bskills\s*&?\s*achievements\b",
    r"(?i)\bcanvassing\s+(volunteer|coordinator)\b",
)
INVOICE = (
    r"(?i)\binvoice\s*(number|#|no\.?)\b",
    r"(?i)\bbill\s+to\b",
    r"(?i)\btotal\s+(due|amount|payable)\b",
    r"(?i)\bpayment\s+due\s+date\b",
    r"(?i)\bpurchase\s+order\b",
)
OTHER_CONTRACT = (
    r"(?i)\bemployment\s+agreement\b",
    r"(?i)\bservice\s+agreement\b",
    r"(?i)\bconsulting\s+agreement\b",
    r"(?i)\bnon.?disclosure\s+agreement\b",
    r"(?i)\bconfidentiality\s+agreement\b",
    r"(?i)\bshareholder\s+agreement\b",
    r"(?i)\bpurchase\s+and\s+sale\s+agreement\b",
)
LEASE = (
    r"(?i)\b(landlord|lessor)\b",
    r"(?i)\b(tenant|lessee|renter)\b",
    r"(?i)\b(rental\s+unit|leased\s+premises|the\s+premises|rental\s+premises)\b",
    r"(?i)\b(monthly\s+rent|base\s+rent|rent\s+payment|rent\s+due|rent\s+of)\b",
    r"(?i)\b(tenancy\s+agreement|lease\s+agreement|rental\s+agreement|residential\s+lease)\b",
    r"(?i)\b(security\s+deposit|damage\s+deposit|last\s+month.?s\s+rent)\b",
    r"\b(landlord\s+and\s+tenant\s+board|LTB)\b",
    r"\b(residential\s+tenancies\s+act|RTA)\b",
    r"(?i)\b(term\s+of\s+(the\s+)?(tenancy|lease)|tenancy\s+term)\b",
    r"(?i)\b(notice\s+to\s+(vacate|terminate)|eviction\s+notice)\b",
    r"(?i)\b(occupancy|right\s+to\s+occupy|right\s+of\s+entry)\b",
)

# Province names in order, legislation of one province, signs of other countries, postal letters.
PROVINCES = (
    ("ontario", "CA-ON"),
    ("on ", "CA-ON"),
    (" on,", "CA-ON"),
    ("british columbia", "CA-BC"),
    (" bc,", "CA-BC"),
    ("bc ", "CA-BC"),
    ("alberta", "CA-AB"),
    (" ab,", "CA-AB"),
    ("ab ", "CA-AB"),
    ("nova scotia", "CA-NS"),
    ("new brunswick", "CA-NB"),
    ("manitoba", "CA-MB"),
    ("saskatchewan", "CA-SK"),
    ("quebec", "CA-QC"),
    ("québec", "CA-QC"),
    ("prince edward island", "CA-PE"),
    ("newfoundland", "CA-NL"),
    ("northwest territories", "CA-NT"),
    ("nunavut", "CA-NU"),
    ("yukon", "CA-YT"),
)
ONTARIO_ACTS = (
    r"(?i)residential\s+tenancies\s+act",
    r"\bRTA\b",
    r"(?i)rent\s+control\s+act",
    r"(?i)landlord\s+and\s+tenant\s+board",
    r"\bLTB\b",
    r"(?i)ontario\s+standard\s+lease",
    r"(?i)ontario\s+regulation",
)
ABROAD = (
    r"(?i)laws?\s+of\s+the\s+state\s+of",
    r"(?i)laws?\s+of\s+england",
    r"(?i)laws?\s+of\s+the\s+united\s+kingdom",
    r"(?i)laws?\s+of\s+australia",
    r"(?i)\bzip\s+code\b",
    r"(?i)\bsocial\s+security\s+number\b",
)
POSTAL = r"\b([A-Z])[0-9][A-Z]\s*[0-9][A-Z][0-9]\b"
POSTAL_LETTERS = {"B": "CA-NS", "T": "CA-AB", "V": "CA-BC", "R": "CA-MB", "S": "CA-SK", "G": "CA-QC", "H": "CA-QC", "J": "CA-QC"}

_BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_START, _END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def java(pattern: str) -> str:
    """The pattern with \\b as a boundary of ASCII words, at a word's start or end.

    Where the sign behind or before it is plainly one of a word, only the other
    side is looked at; a start of capitals or digits is looked for before its boundary.
    """
    pattern = re.sub(r"^((?:\(\?i\))?)\\b(?=(\(\[A-Z\]\)|\[A-Z\]|\\d)(?![?*]|\{0))", lambda m: f"{m[1]}(?={m[2].strip('()')}){_START}", pattern)
    pattern = re.sub(r"\\b(?=[A-Za-z](?![?*{])|(\([A-Za-z][^()]*\))(?![?*{]))", lambda m: r"\b" if m[1] and re.search(r"\|[^A-Za-z]|[|(][A-Za-z][?*{]", m[1]) else _START, pattern)
    pattern = re.sub(r"(?<=(?<!\\)[A-Za-z])\\b", lambda m: _END, pattern)
    pattern = re.sub(r"(\[A-Z\]|\[0-9\]|\[a-z\]\+|\\d(?:\{\d\})?)\\b", lambda m: m[1] + _END, pattern)
    return pattern.replace(r"\b", _BOUNDARY)


def _any(text: Column, low: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (found(text, low, java(p), p) for p in patterns))


def _hits(text: Column, low: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, (F.when(found(text, low, java(p), p), 1).otherwise(0) for p in patterns))


def scrubbed(text: Column) -> Column:
    """The text with personal data replaced, names first."""
    for (pattern, by), sign in zip(PERSONAL, PERSONAL_SIGNS, strict=True):
        text = replaced(text, java(pattern), by.replace("$", r"\$"), lambda t, sign=sign: t.rlike(sign))
    return text


def kinds(docs: DataFrame) -> DataFrame:
    """Adds kind: resume, invoice, other_contract, unknown or lease, by signs in this order. Needs text."""
    rows = docs.withColumn("_low", F.lower("text"))
    text, low = F.col("text"), F.col("_low")
    hits = lambda patterns: _hits(text, low, patterns)
    kind = F.when(hits(RESUME) >= 2, "resume").when(hits(INVOICE) >= 2, "invoice").when(_any(text, low, OTHER_CONTRACT), "other_contract").when(hits(LEASE) < 2, "unknown").otherwise("lease")
    return rows.withColumn("kind", kind).drop("_low")


def _province(low: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, code in reversed(PROVINCES):
        out = F.when(low.contains(name), code).otherwise(out)
    return out


# Where a text says which law governs it, in order.
GOVERNING_LAW = (
    r"(?i)governing\s+law[^\n.]{0,300}",
    r"(?i)this\s+(?:agreement|lease)\s+(?:shall\s+be\s+)?governed\s+by[^\n.]{0,300}",
    r"(?i)applicable\s+law[^\n.]{0,300}",
    r"(?i)jurisdiction[^\n.]{0,150}",
)


def jurisdictions(docs: DataFrame) -> DataFrame:
    """doc_id, code, votes, confidence, ambiguous and supported.

    The province with the most votes counts: from a clause on governing law
    (3), legislation (2 each), postal codes (2) and names (1); of equals the one
    that was voted for first. Signs of another country come first and give
    INTL. A second one with at least 0.7 of the votes makes it ambiguous.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_low", F.lower("_text"))
    text, low = F.col("_text"), F.col("_low")
    # What is used more than once is a column, so that a text is searched for it once.
    law = F.lower(F.coalesce(*(F.nullif(F.when(found(text, low, p), F.regexp_extract(text, p, 0)), F.lit("")) for p in GOVERNING_LAW)))
    codes = F.when(text.rlike(POSTAL.replace(r"\b", "")), F.regexp_extract_all(text, F.lit(java(POSTAL)), 1)).otherwise(F.array().cast("array<string>"))
    docs = docs.withColumns({"_law": law, "_letters": codes, "_acts": _hits(text, low, ONTARIO_ACTS)})
    letters, acts = F.col("_letters"), F.col("_acts")
    other = F.element_at(F.create_map(*(F.lit(x) for kv in POSTAL_LETTERS.items() for x in kv)), F.element_at(letters, 1))
    postal = F.when(F.exists(letters, lambda x: x.isin("M", "K", "L", "N", "P")), "CA-ON").when(F.size(letters) > 0, other)
    vote = lambda place, code, n: F.struct(F.lit(place).alias("place"), code.alias("code"), n.cast("int").alias("n"))
    cast = F.array(vote(0, _province(F.col("_law")), F.lit(3)), vote(1, F.when(acts > 0, "CA-ON"), acts * 2), vote(2, postal, F.lit(2)), vote(3, _province(low), F.lit(1)))
    votes = docs.select("doc_id", _any(text, low, ABROAD).alias("abroad"), F.filter(cast, lambda v: v["code"].isNotNull()).alias("cast"))
    given = F.transform("cast", lambda v: v["code"])
    sums = F.transform(F.array_distinct(given), lambda c: F.struct(F.aggregate(F.filter("cast", lambda v: v["code"] == c), F.lit(0), lambda s, v: s + v["n"]).alias("n"), (-F.array_position(given, c)).alias("place"), c.alias("code")))
    best = votes.select("doc_id", "abroad", F.reverse(F.array_sort(sums)).alias("by"))
    first, second = F.get("by", F.lit(0)), F.get("by", F.lit(1))
    total = F.aggregate("by", F.lit(0), lambda s, x: s + x["n"])
    unsure = F.coalesce(second["n"] >= first["n"] * 0.7, F.lit(False))
    none = F.size("by") == 0
    sure = F.when(F.col("abroad"), 0.5).when(none, 0.1).when(unsure, 0.3).otherwise(F.least(F.lit(0.95), first["n"] / total + 0.3))
    code = F.when(F.col("abroad"), "INTL").otherwise(F.coalesce(first["code"], F.lit("UNKNOWN")))
    return best.select(
        "doc_id",
        code.alias("code"),
        F.when(F.col("abroad"), 0).otherwise(F.coalesce(first["n"], F.lit(0))).alias("votes"),
        F.floor(sure * 100 + 0.5).cast("int").alias("confidence_pct"),
        (unsure & ~F.col("abroad")).alias("ambiguous"),
        (code == "CA-ON").alias("supported"),
    )


def outcomes(decisions: DataFrame) -> DataFrame:
    """Adds outcome: payment orders first, then who applied and what became of it. Needs case_number and text."""
    t = F.lower("text")
    landlord = t.rlike(r"landlord\s+shall\s+pay|landlord\s+must\s+pay|ordered\s+to\s+pay\s+the\s+tenant")
    tenant = t.rlike(r"tenant\s+shall\s+pay|tenant\s+must\s+pay|ordered\s+to\s+pay\s+the\s+landlord")
    granted, dismissed = t.rlike(java(r"is\s+granted\b")), t.rlike(java(r"is\s+dismissed\b"))
    first = F.upper(F.substring("case_number", 1, 1))
    tenant_side = F.when(granted, "tenant_favour").when(dismissed, "landlord_favour").otherwise("mixed")
    landlord_side = F.when(granted, "landlord_favour").when(dismissed, "tenant_favour").otherwise("mixed")
    by_applicant = F.when(first == "T", tenant_side).when(first == "L", landlord_side).otherwise("mixed")
    return decisions.withColumn("outcome", F.when(landlord & ~tenant, "tenant_favour").when(tenant & ~landlord, "landlord_favour").otherwise(by_applicant))
