"""Reading what comes in: files, decisions, pages of HTML, addresses, and checks of what a user sends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.functions.cleaning import non_ascii_share, trimmed
from clausegrid.functions.dates import case_day, decision_day
from clausegrid.operators.screening import java

LARGEST_FILE = 25 << 20
SHORTEST_TEXT, SHORTEST_DECISION, SHORTEST_ANALYSIS = 50, 200, 100

# Words by which a decision is about a clause type.
DECISION_TYPES = (
    ("security_deposit", ("deposit", "section 105", "s. 105", "s.105", "key deposit", "section 106")),
    ("entry_rights", ("entry without notice", "section 26", "s. 26", "section 27", "s. 27", "landlord enter")),
    ("maintenance_repairs", ("maintenance", "disrepair", "good repair", "section 20", "s. 20", "regulation 516")),
    ("early_termination", ("N12", "N4", "N13", "own use eviction", "section 48")),
    ("rent_increase", ("above guideline", "AGI", "section 116", "s. 116", "rent increase notice")),
    ("quiet_enjoyment", ("quiet enjoyment", "substantial interference", "section 22", "s. 22")),
)
# The clause type of a statute's section, single ones and ranges (first, last, type).
SECTION_TYPES = (
    (12, 12, "standard_boilerplate"),
    (20, 20, "maintenance_repairs"),
    (22, 22, "quiet_enjoyment"),
    (26, 27, "entry_rights"),
    (29, 29, "alterations"),
    (42, 58, "renewal_terms"),
    (59, 84, "early_termination"),
    (95, 95, "subletting_assignment"),
    (97, 97, "subletting_assignment"),
    (105, 107, "security_deposit"),
    (116, 120, "rent_increase"),
)
# What stands before an address, in order of trust; its first group is the address.
ADDRESSES = (
    r"(?i)full address of (?:the )?rental unit[^\n:]*:?[ \t]*\n?[ \t]*([^\n]{10,120})",
    r"(?i)(?:^|\n)[ \t]*(?:rental unit|premises|rental premises|property address|unit address)[ \t]*:[ \t]*([^\n]{10,120})",
    r"(?i)(?:located at|situated? at|known as|being and described as)\s+([^\n]{10,120})",
)
STREET = r"(?i)(?:^|\n)\s*(\d{1,5}[- ]?[A-Za-z0-9]?[,\s]+[A-Za-z][A-Za-z\s.'‑-]{3,50}(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Boulevard|Blvd|Way|Crescent|Cres|Court|Ct|Lane|Ln|Place|Pl)[^\n]{0,60})"
POSTAL_CODE = r"(?i)([A-Z]\d[A-Z][ -]?\d[A-Z]\d)"
UNIT = r"(?i)\b(unit|apt\.?|apartment|suite|#)\s*([0-9A-Za-z-]+)"
CITY = r"(?i),\s*([A-Za-z][A-Za-z\s]{1,30}?)(?:,\s*|\s+)(?:ON|Ontario)\b"
_NOISE = ((r"(?i),\s*Ontario\b", ""), (r",?\s*\bON\b", ""), (r"(?i)[A-Z]\d[A-Z][ -]?\d[A-Z]\d", ""), (r",\s*,", ","), (r"\s{2,}", " "), (r",\s*$", ""))


def is_pdf(content: Column) -> Column:
    """Whether a file starts as a PDF does and is not too large; null content is not."""
    return F.coalesce((F.substring(content, 1, 5) == F.lit(b"%PDF-")) & (F.length(content) <= LARGEST_FILE), F.lit(False))


def accepted_files(files: DataFrame) -> DataFrame:
    """Files (path, content) that are PDFs of an accepted size."""
    return files.where(is_pdf(F.col("content")))


def long_enough(text: Column, least: int = SHORTEST_TEXT) -> Column:
    """Whether the text has at least ``least`` signs between white space at its ends."""
    return F.length(trimmed(F.coalesce(text, F.lit("")))) >= least


def text_confidence(pages: DataFrame) -> DataFrame:
    """file and confidence of the text of its pages: less for signs beyond ASCII and for very short pages. Needs file, page, text."""
    text = F.coalesce("text", F.lit(""))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", text.alias("text")))), lambda x: x["text"]), "\n")
    per = pages.groupBy("file").agg(joined.alias("text"), F.avg(F.length(text)).alias("mean"))
    sure = 1.0 - non_ascii_share(F.col("text")) * 0.8 - F.when(F.col("mean") >= 50, 0.0).otherwise(0.3)
    return per.select("file", F.when(trimmed(F.col("text")) == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))).alias("confidence"))


def section_type(number: Column) -> Column:
    """The clause type of a section's number, by its leading digits; null for others."""
    whole = F.regexp_extract(number, r"^(\d+)(?:[.(].*)?$", 1).try_cast("int")
    return reduce(lambda out, x: F.when(whole.between(x[0], x[1]), x[2]).otherwise(out), SECTION_TYPES, F.lit(None).cast("string"))


def decision_types(text: Column) -> Column:
    """The clause types that a decision is about, unknown without any."""
    low = F.lower(text)
    some = lambda words: reduce(lambda a, b: a | b, (low.contains(w.lower()) for w in words))
    found = F.filter(F.array(*(F.when(some(words), name) for name, words in DECISION_TYPES)), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown")))


def decisions(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """case_number, day, types, url and body of decision files (name, text) that say enough, and the columns named in ``keep``.

    A first line ``#meta: date=... types=... url=...`` counts before what the
    name and the body tell.
    """
    first = F.regexp_extract("text", r"^(#meta:[^\n]*)", 1)
    has = first != ""
    meta = lambda key: F.nullif(F.regexp_extract(first, key + r"=([^\s;]+)", 1), F.lit(""))
    body = trimmed(F.when(has, F.regexp_replace("text", r"^[^\n]*\n?", "")).otherwise(F.col("text")))
    case = F.regexp_replace("name", r"\.txt$", "")
    stated = F.filter(F.split(meta("types"), ","), lambda t: t.isin(*(n for n, _ in DECISION_TYPES)))
    address = F.regexp_extract(F.lower(case), r"^(20\d{2}onltb\d+)$", 1)
    built = F.when(address != "", F.concat(F.lit("https://www.canlii.org/en/on/onltb/doc/"), address, F.lit("/"), address, F.lit(".html"))).otherwise("https://www.canlii.org/en/on/onltb/")
    rows = files.select(
        *keep,
        case.alias("case_number"),
        F.coalesce(F.try_to_timestamp(meta("date"), F.lit("yyyy-MM-dd")).cast("date"), F.when(case.rlike(r"^20\d{2}"), case_day(case)), decision_day(F.lit(None).cast("string"), case)).alias("day"),
        F.when(F.size(stated) > 0, stated).otherwise(decision_types(body)).alias("types"),
        F.coalesce(meta("url"), built).alias("url"),
        body.alias("body"),
    )
    return rows.where(long_enough(F.col("body"), SHORTEST_DECISION))


_BLOCK = r"(?is)<(?:h[1-6]|p)\b[^>]*>.*?</(?:h[1-6]|p)>"


def html_sections(pages: DataFrame) -> DataFrame:
    """page_id, section, heading and text of the sections of HTML pages: a heading and the paragraphs up to the next one.

    Tags go, the five named entities are read, white space becomes single
    blanks. Paragraphs before the first heading have none.
    """
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(?:script|style)\b.*?</(?:script|style)>", " "), r"(?s)<!--.*?-->", " ")
    block = pages.select("page_id", F.posexplode(F.regexp_extract_all(plain, F.lit(_BLOCK), 0)).alias("n", "block"))
    text = F.regexp_replace("block", r"(?s)<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    text = trimmed(F.regexp_replace(text, r"\s+", " "))
    head = F.col("block").rlike(r"(?i)^<h")
    before = Window.partitionBy("page_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = block.select("page_id", "n", text.alias("text"), head.alias("head")).where("text <> ''")
    rows = rows.withColumns({"section": F.sum(F.col("head").cast("int")).over(before).cast("int"), "heading": F.last(F.when(F.col("head"), F.col("text")), ignorenulls=True).over(before)})
    parts = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("n", "text"))))
    return rows.groupBy("page_id", "section", "heading").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def addresses(docs: DataFrame) -> DataFrame:
    """doc_id, address, unit, city and postal_code of a lease's text; all empty where no address is found."""
    text = F.replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t]+", " "), F.lit("\r\n"), F.lit("\n"))
    rows = docs.select("doc_id", F.when(F.length("text") >= 20, text).otherwise("").alias("t"))
    get = lambda p, t: F.nullif(trimmed(F.regexp_extract(t, p, 1)), F.lit(""))
    raw = F.coalesce(*(get(p, F.col("t")) for p in ADDRESSES), get(STREET, F.substring("t", 1, 3000)), F.lit(""))
    rows = rows.select("doc_id", raw.alias("raw"))
    r = F.col("raw")
    postal = F.regexp_replace(F.upper(F.regexp_extract(r, POSTAL_CODE, 1)), r"^(.{3})[ -]?(.{3})$", "$1 $2")
    unit = F.when(r.rlike(java(UNIT)), F.concat_ws(" ", F.element_at(F.split(F.regexp_extract(r, java(UNIT), 0), r"\s+"), 1), F.regexp_extract(r, java(UNIT), 2))).otherwise("")
    full = reduce(lambda t, s: F.regexp_replace(t, java(s[0]), s[1]), _NOISE, r)
    return rows.select("doc_id", F.substring(trimmed(full), 1, 120).alias("address"), unit.alias("unit"), trimmed(F.regexp_extract(r, java(CITY), 1)).alias("city"), postal.alias("postal_code"))


def valid_request(kind: str, value: Column) -> Column:
    """Whether a value that a user sends has the shape of its kind; null has not."""
    shapes = {
        "uuid": value.rlike(r"^[0-9a-f-]{36}$"),
        "title": (F.length(trimmed(value)) > 0) & (F.length(value) <= 200),
        "comment": F.length(value) <= 1000,
        "message": F.length(trimmed(value)).between(1, 500),
        "tone": value.isin("cooperative", "assertive", "formal"),
        "day": F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).isNotNull(),
    }
    return F.coalesce(shapes[kind], F.lit(False))
