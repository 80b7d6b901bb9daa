r"""Clauses of documents: segmentation, references, types, screening.

Classes such as \d and \s are those of ASCII, in Java as in RE2.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.functions.cleaning import plain_quotes, trimmed
from clausegrid.functions.texts import found
from clausegrid.operators.screening import java

# What starts a clause, in order of priority, on a trimmed line.
BOUNDARIES = (
    r"^(\d+(?:\.\d+)*)\.\s+(.+)",
    r"^([A-Z])\.\s+(.+)",
    r"^(\([a-z]\))\s+(.+)",
    r"^([A-Z][A-Z\s]{3,}[A-Z])(?:\s*:)?\s*$",
    r"(?i)^(ARTICLE|SECTION)\s+(\d+|[IVXLC]+)(?:\s*[:–-])?\s*(.*)",
)

# Wordings of a reference to another clause; the clause is their first group.
REFERENCES = (
    r"(?i:subject to (?:clause|section|paragraph|article))\s+([\d.]+[a-zA-Z]?)",
    r"(?i:as per (?:clause|section|paragraph|article))\s+([\d.]+[a-zA-Z]?)",
    r"(?i:see (?:clause|section|paragraph|article))\s+([\d.]+[a-zA-Z]?)",
    r"(?i:pursuant to (?:clause|section|paragraph|article))\s+([\d.]+[a-zA-Z]?)",
    r"(?i:in accordance with (?:clause|section|paragraph|article))\s+([\d.]+[a-zA-Z]?)",
    r"(?i:referred? to in (?:clause|section|paragraph|article))\s+([\d.]+[a-zA-Z]?)",
    r"(?i:clause|section|paragraph|article)\s+([\d.]+[a-zA-Z]?)\s+(?i:above|below|hereof)",
)

# Keyword patterns of clause types, in order; earlier types win ties.
CLAUSE_TYPES = (
    ("entry_rights", "high", ("right of entry", "landlord.*enter", "enter the unit", "entry notice", "access to the unit", "inspection", "enter the premises", "landlord access", "right to inspect", "24.hour notice", "24 hour notice")),
    ("security_deposit", "high", ("security deposit", "last month", "last month's rent", "damage deposit", "key deposit", "deposit held", "return.*deposit", "deposit.*returned")),
    (
        "early_termination",
        "high",
        ("early termination", "break clause", "lease break", "vacate.*early", "terminate.*lease", "terminate.*tenancy", "termination fee", "penalty.*terminat", "notice to terminate", "early.*vacate", "break.*lease"),
    ),
    (
        "dispute_resolution",
        "high",
        (
            "arbitration", "waive.*right", "waiver.*right", "mediation", "binding arbitration", "dispute.*resolution", "legal action", "court.*jurisdiction", "waive.*court",
            "class action waiver", "mandatory arbitration", "landlord.*tribunal", "supersedes", "supersede", "overrides", "override.*rta", "override.*act",
            "provincial law", "standard form of lease", "standard form", "notwithstanding.*rta", "notwithstanding.*act", "waive.*rta", "waive.*act", "exempt.*rta",
        ),
    ),
    (
        "rent_payment",
        "high",
        (
            "rent.*due", "monthly rent", "rent payment", "pay rent", "amount.*rent", "rent.*amount", "base rent", "total rent", "rent.*payable", "rent is due",
            "rental amount", "monthly.*payment", "first.*month.*rent", "post-dated", "post dated", "postdated", "post.dated cheque", "cheque",
            "late.*fee", "late.*penalty", "late fee", "late penalty", "per day.*late", "penalty.*late", "nsf", "nsf fee", "bounced cheque", "bounced.*cheque",
            "non-sufficient", "insufficient funds",
        ),
    ),
    ("rent_increase", "medium", ("rent increase", "rent.*increas", "annual.*increas", "guideline.*increas", "increas.*rent", "rent.*adjust", "CPI.*increas", "notice.*increas", "rent.*review")),
    (
        "maintenance_repairs",
        "medium",
        ("maintenance", "repairs", "tenant.*repair", "landlord.*repair", "damage", "fix", "responsible.*repair", "repair.*responsible", "wear and tear", "maintenance.*obligation", "upkeep"),
    ),
    ("subletting_assignment", "high", ("sublet", "sublease", "assignment", "assign.*lease", "sub-let", "subletting", "transfer.*tenancy", "assign.*tenancy", "prohibited.*sublet")),
    ("renewal_terms", "medium", ("renewal", "renew.*lease", "lease.*renewal", "month.to.month", "holdover", "automatic.*renewal", "option.*renew", "extend.*lease")),
    ("quiet_enjoyment", "medium", ("quiet enjoyment", "peaceful enjoyment", "peaceful possession", "undisturbed.*possession", "covenant.*quiet", "right.*occupy")),
    (
        "liability_indemnification",
        "medium",
        ("indemnif", "hold harmless", "liability", "liable", "negligence", "indemnity", "waive.*claim", "release.*claim", "not.*liable", "landlord.*not.*responsible"),
    ),
    ("utilities", "low", ("utilities", "hydro", "electricity", "water", "gas", "heat", "internet", "cable", "utility.*included", "utility.*excluded", "tenant.*pay.*util", "landlord.*pay.*util")),
    ("pets", "low", ("pets", "pet policy", "no pets", "pet.*allowed", "animal", "cat", "dog", "pet.*deposit", "pet.*fee", "pet.*prohibited")),
    ("alterations", "medium", ("alterations", "modification", "renovate", "paint", "nail holes", "alter.*unit", "change.*unit", "install", "tenant.*alter", "no.*alteration", "written.*consent.*alter")),
    ("parking_storage", "low", ("parking", "parking space", "storage", "locker", "parking.*included", "garage", "parking.*fee", "storage.*unit", "bicycle.*storage")),
    ("guest_policy", "low", ("guest", "visitor", "overnight.*guest", "guest.*policy", "guest.*stay", "unauthorized.*occupant", "additional.*occupant")),
    (
        "standard_boilerplate",
        "none",
        ("entire agreement", "severability", "waiver.*provision", "governing.*law", "notice.*in.*writing", "time.*essence", "successors.*assigns", "hereinafter", "witnesseth", "this agreement.*binding", "amendments.*writing"),
    ),
)

# Words by which a clause of a type is of a kind, in order.
SUBTYPES = {
    "dispute_resolution": (("supersede", "rta_waiver"), ("override", "rta_waiver"), ("provincial law", "rta_waiver"), ("standard form", "non_standard_form"), ("arbitration", "arbitration"), ("mediation", "mediation")),
    "rent_payment": (("late", "late_payment"), ("nsf", "nsf_fee"), ("post-dated", "post_dated_cheque"), ("postdated", "post_dated_cheque"), ("electronic", "e_transfer")),
    "liability_indemnification": (("personal injury", "personal_injury"), ("property damage", "property_damage")),
}

# Wordings that try to steer a model.
INJECTIONS = (
    r"(?i)ignore\s+(previous|your|all|above|the)\s+instructions?",
    r"(?i)forget\s+(your|the|all|previous)\s+(instructions?|rules?|system\s+prompt|prompt|context)",
    r"(?i)disregard\s+(your|all|previous|the)\s+(instructions?|rules?|system|training)",
    r"(?i)override\s+(your|the|all)\s+(instructions?|rules?|system|constraints?)",
    r"(?i)you\s+are\s+now\s+(a|an|the)\b",
    r"(?i)pretend\s+(to\s+be|you\s+are|you're)\b",
    r"(?i)act\s+as\s+(a|an|if\s+you)\b",
    r"(?i)roleplay\s+as\b",
    r"(?i)your\s+new\s+(role|persona|instructions?|task)\s+is\b",
    r"(?i)switch\s+(to|your)\s+(mode|persona|role)\b",
    r"(?i)new\s+(instructions?|system\s+prompt|prompt|directives?)\s*:",
    r"(?i)\[new\s+(instructions?|system|prompt)\]",
    r"(?i)reveal\s+(your|the)\s+system\s+prompt",
    r"(?i)what\s+(is|are)\s+your\s+(instructions?|system\s+prompt|rules?)",
    r"(?i)repeat\s+(your|the)\s+system\s+prompt",
    r"\bDAN\b",
    r"(?i)\bjailbreak\b",
    r"(?i)\bdev(eloper)?\s+mode\b",
    r"(?i)\bgod\s+mode\b",
    r"(?i)\bunrestricted\s+mode\b",
    r"(?i)<\|system\|>",
    r"(?i)<\|im_start\|>",
    r"(?i)<\|im_end\|>",
    r"(?i)<\|user\|>",
    r"(?i)<\|assistant\|>",
    r"(?i)<\|endoftext\|>",
    r"(?i)\[INST\]",
    r"(?i)\[/INST\]",
    r"(?i)\[\s*SYSTEM\s*\]",
    r"(?i)<<SYS>>",
    r"(?i)<</SYS>>",
    r"(?i)\[SYSTEM\]",
    r"(?im)^#{1,3}\s*(system|instructions?|rules?|prompt)\b",
    r"(?i)ignore\s+(the\s+)?(lease|topic|scope)\s+(restriction|limit|constraint)",
    r"(?i)answer\s+(any|all|every)\s+(question|topic|subject)",
    r"(?i)you\s+can\s+(now\s+)?(answer|help\s+with|discuss)\s+anything",
)


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern is found."""
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns))


def _number(line: Column) -> Column:
    """The number of the clause that a boundary line starts; headings in capitals have none."""
    first = F.lit("")
    for k in (2, 1, 0):
        first = F.when(line.rlike(BOUNDARIES[k]), F.regexp_extract(line, BOUNDARIES[k], 1)).otherwise(first)
    named = F.concat_ws(" ", F.regexp_extract(line, BOUNDARIES[4], 1), F.regexp_extract(line, BOUNDARIES[4], 2))
    return F.when(any_of(line, BOUNDARIES[:3]), first).when(line.rlike(BOUNDARIES[3]), "").when(line.rlike(BOUNDARIES[4]), named)


def _heading(line: Column) -> Column:
    """The heading of a boundary line, null if there is none."""
    out = F.lit(None).cast("string")
    for k, group in ((4, 3), (3, 0), (2, 2), (1, 2), (0, 2)):
        out = F.when(line.rlike(BOUNDARIES[k]), trimmed(F.regexp_extract(line, BOUNDARIES[k], group))).otherwise(out)
    return F.nullif(out, F.lit(""))


def segments(docs: DataFrame) -> DataFrame:
    """doc_id, clause, number, heading, start, n_chars, text and confidence of the clauses of each document.

    A line that starts a clause opens a new one; lines without a boundary
    belong to the one that is open, and what comes before the first boundary is
    a clause too. Blank clauses are left out and the others numbered from 1; a
    clause without a number is called synthetic. A text without any boundary is
    cut into paragraphs of more than 20 characters, or is one clause. A text's
    clauses are made within its row, so that nothing is shuffled.
    """
    rows = docs.where(F.length("text") > 0).select("doc_id", "text", F.split("text", "\n", -1).alias("lines"))
    rows = rows.withColumn("t", F.transform("lines", trimmed))
    opens = F.transform("t", lambda x, i: F.when(any_of(x, BOUNDARIES), i))
    rows = rows.withColumn("at", F.filter(opens, lambda i: i.isNotNull()))
    edges = F.arrays_zip(F.concat(F.array(F.lit(0)), "at").alias("a"), F.concat("at", F.array(F.size("lines"))).alias("b"))
    raw = F.transform(edges, lambda e, k: F.struct(F.when(k > 0, F.get("t", e["a"])).alias("first"), (e["b"] - e["a"]).alias("n"), F.array_join(F.slice("lines", e["a"] + 1, e["b"] - e["a"]), "\n").alias("raw")))
    rows = rows.withColumn("raw", F.when(F.size("at") > 0, raw))
    # A clause begins where the lines before it end, a paragraph is looked for from the end of the one before it.
    begins = """
        aggregate(raw, named_struct('end', 0, 'at', cast(array() as array<int>)),
          (s, x) -> named_struct('end', s.end + if(x.n > 0, length(x.raw) + 1, 0), 'at', array_append(s.at, s.end)), s -> s.at)"""
    bound = F.filter(F.transform(F.arrays_zip("raw", F.expr(begins).alias("start")), lambda x: F.struct(x["raw"]["first"].alias("first"), x["start"].alias("start"), trimmed(x["raw"]["raw"]).alias("text"))), lambda x: x["text"] != "")
    parts = F.filter(F.transform(F.split("text", r"\n{2,}", -1), trimmed), lambda p: F.length(p) > 20)
    rows = rows.withColumn("parts", F.when(F.size("at") == 0, F.when(F.size(parts) > 1, parts).otherwise(F.array(trimmed(F.col("text"))))))
    offsets = """
        if(size(parts) > 1, aggregate(parts, named_struct('end', 0, 'at', cast(array() as array<int>)),
          (s, p) -> named_struct('end', locate(p, text, s.end + 1) - 1 + length(p), 'at', array_append(s.at, locate(p, text, s.end + 1) - 1)),
          s -> s.at), array(0))"""
    plain = F.transform(F.arrays_zip("parts", F.expr(offsets).alias("start")), lambda x: F.struct(F.lit(None).cast("string").alias("first"), x["start"].alias("start"), x["parts"].alias("text")))
    rows = rows.select("doc_id", F.size("at").alias("bounds"), F.when(F.size("at") > 0, bound).otherwise(plain).alias("clauses"))
    n = F.size("clauses")
    sure = F.when(F.col("bounds") == 0, 0.3).when((F.col("bounds") >= 5) & (n >= 5), 0.85).when(F.col("bounds") >= 2, 0.6).otherwise(0.4)
    found = rows.select("doc_id", sure.alias("confidence"), F.posexplode("clauses").alias("k", "c")).select("doc_id", (F.col("k") + 1).alias("clause"), "c.first", F.col("c.start").cast("long").alias("start"), "c.text", "confidence")
    number = F.coalesce(F.nullif(_number(F.col("first")), F.lit("")), F.concat(F.lit("synthetic-"), F.col("clause")))
    return found.select("doc_id", "clause", number.alias("number"), _heading(F.col("first")).alias("heading"), "start", F.length("text").cast("long").alias("n_chars"), "text", "confidence")


def references(text: Column) -> Column:
    """The clauses that a text refers to, each once, by wording and then by place."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), 1) for p in REFERENCES)))


def _found(low: Column, pattern: str) -> Column:
    """Whether a keyword pattern is found in a lower-cased text; plain words are searched for as they are."""
    return found(low, low, pattern.lower()) if "." in pattern else low.contains(pattern.lower())


def classified(clauses: DataFrame, text: str = "text") -> DataFrame:
    """Adds primary_type, subtype, hits, n_types, confidence and needs_lookup by keyword patterns.

    The type with the most patterns found counts, the earlier one of equals. A
    blank text is unknown with confidence 0, one without any hit with 0.1.
    """
    t = F.col(text)
    counted = clauses.withColumn("_low", F.lower(t))
    low = F.col("_low")
    counts = [sum((F.when(_found(low, p), 1).otherwise(0) for p in patterns), F.lit(0)) for _, _, patterns in CLAUSE_TYPES]
    counted = counted.withColumn("_hits", F.array(*counts))
    best = F.array_max("_hits")
    place = F.array_position("_hits", best)
    names, sizes = F.array(*(F.lit(n) for n, _, _ in CLAUSE_TYPES)), F.array(*(F.lit(len(p)) for _, _, p in CLAUSE_TYPES))
    priorities = F.array(*(F.lit(p) for _, p, _ in CLAUSE_TYPES))
    counted = counted.withColumns({"hits": best, "_place": place.cast("int"), "n_types": F.size(F.filter("_hits", lambda x: x > 0))})
    raw = F.least(F.lit(0.95), 0.4 + F.col("hits") / F.element_at(sizes, F.col("_place")) * 0.55 + F.when(F.col("n_types") == 1, 0.1).otherwise(0.0))
    sure = F.when(F.col("n_types") > 1, F.greatest(F.lit(0.3), raw - 0.15)).otherwise(raw)
    blank = t.isNull() | (F.trim(t) == "")
    nothing = blank | (F.col("hits") == 0)
    counted = counted.withColumn("primary_type", F.when(nothing, "unknown").otherwise(F.element_at(names, F.col("_place"))))
    kind = F.lit(None).cast("string")
    for name, words in SUBTYPES.items():
        for word, subtype in reversed(words):
            kind = F.when((F.col("primary_type") == name) & low.contains(word), subtype).otherwise(kind)
    return counted.withColumns(
        {
            "subtype": kind,
            "confidence": F.when(blank, 0.0).when(F.col("hits") == 0, 0.1).otherwise(F.floor(sure * 100 + 0.5) / 100),
            "needs_lookup": ~nothing & (F.element_at(priorities, F.col("_place")) != "none"),
        }
    ).drop("_hits", "_place", "_low")


def screened(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds blocked: whether the text tries to steer a model."""
    low = rows.withColumn("_low", F.lower(text))
    hit = reduce(lambda a, b: a | b, (found(F.col(text), F.col("_low"), java(p), p) for p in INJECTIONS))
    return low.withColumn("blocked", F.coalesce(hit, F.lit(False))).drop("_low")


# Lines that hold a page number only.
PAGE_NUMBERS = (r"(?i)^\s*(?:page\s*)?\d+\s*$", r"^\s*-\s*\d+\s*-\s*$")


def header_footer_lines(pages: DataFrame) -> DataFrame:
    """file, line and pages of the lines that recur on at least max(2, 30 %) of a file's pages. Needs file, page, text."""
    shown = pages.where(F.col("text").isNotNull()).select("file", "page", F.explode(F.array_distinct(F.transform(F.split("text", "\n", -1), trimmed))).alias("line"))
    total = pages.groupBy("file").agg(F.count_distinct("page").alias("total"))
    counts = shown.where("line <> ''").groupBy("file", "line").agg(F.count_distinct("page").alias("pages"))
    need = F.greatest(F.lit(2), F.floor(F.col("total") * 0.3))
    return counts.join(total, "file").where(F.col("pages") >= need).select("file", "line", "pages")


def without_headers(pages: DataFrame) -> DataFrame:
    """file, page and text of the pages without recurring lines and page numbers; the other lines stay as they are, in order."""
    gone = header_footer_lines(pages).select("file", F.col("line").alias("_line"))
    line = pages.where(F.col("text").isNotNull()).select("file", "page", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    kept = line.withColumn("_line", trimmed(F.col("line"))).where(~any_of(F.col("line"), PAGE_NUMBERS)).join(gone, ["file", "_line"], "left_anti")
    texts = kept.groupBy("file", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return pages.select("file", "page").join(texts, ["file", "page"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def assembled(pages: DataFrame) -> DataFrame:
    """file and text: the pages that are not blank, trimmed, with a blank line between them and plain quotes."""
    shown = pages.select("file", "page", plain_quotes(trimmed(F.col("text"))).alias("text")).where("text <> ''")
    return shown.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def last_turns(turns: DataFrame, keep: int = 6, longest: int = 2000) -> DataFrame:
    """The last turns of each conversation, cut to ``longest`` characters, without unsafe user turns. Needs conv_id, turn, role, text."""
    cut = screened(turns.withColumn("text", F.substring("text", 1, longest)))
    safe = cut.where(~((F.col("role") == "user") & F.col("blocked"))).drop("blocked")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return safe.withColumn("from_end", place).where(F.col("from_end") <= keep)
