"""Structure of statutes, forms, decisions and printed pages, all within Spark's own functions.

A text or page is a row; what depends on the lines before is a fold over the
row's own array, so that no line leaves its row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.functions.cleaning import form_slug, nfkc, trimmed
from clausegrid.operators.intake import SHORTEST_ANALYSIS, section_type
from clausegrid.operators.screening import java

LONGEST_CHUNK, LONGEST_SUMMARY, LONGEST_PRINCIPLE = 2000, 2000, 500
#: Sentences in which a principle is looked for.
PRINCIPLE_SENTENCES = 10
#: Blocks that start further apart than this stand in columns of their own.
COLUMN_GAP = 100

# The sections of the standard form by number, with their clause types.
FORM_SECTIONS = (
    ("Parties to the Agreement", "standard_boilerplate"),
    ("Rental Unit", "standard_boilerplate"),
    ("Contact Information", "standard_boilerplate"),
    ("Term of Tenancy Agreement", "renewal_terms"),
    ("Rent", "rent_payment"),
    ("Services and Utilities", "utilities"),
    ("Rent Discounts", "rent_payment"),
    ("Rent Deposit", "security_deposit"),
    ("Key Deposit", "security_deposit"),
    ("Smoking", "alterations"),
    ("Tenant's Insurance", "liability_indemnification"),
    ("Changes to the Rental Unit", "alterations"),
    ("Maintenance and Repairs", "maintenance_repairs"),
    ("Assignment and Subletting", "subletting_assignment"),
    ("Additional Terms", "standard_boilerplate"),
    ("Changes to this Agreement", "standard_boilerplate"),
    ("Signatures", "standard_boilerplate"),
)
# Words in a heading and the clause types that they stand for, in this order.
HEADING_TYPES = (
    ("rent", "rent_payment"),
    ("payment", "rent_payment"),
    ("deposit", "security_deposit"),
    ("last month", "security_deposit"),
    ("entry", "entry_rights"),
    ("access", "entry_rights"),
    ("maintenance", "maintenance_repairs"),
    ("repair", "maintenance_repairs"),
    ("termination", "early_termination"),
    ("notice", "early_termination"),
    ("subletting", "subletting_assignment"),
    ("assignment", "subletting_assignment"),
    ("increase", "rent_increase"),
    ("utilities", "utilities"),
    ("pet", "pets"),
    ("smoking", "alterations"),
    ("alteration", "alterations"),
    ("quiet enjoyment", "quiet_enjoyment"),
    ("parking", "parking_storage"),
    ("storage", "parking_storage"),
)
FORM_HEADING = r"^(\d{1,2})\.\s+(.+)$"
# Headings that begin and end the analysis of a decision, and how a sentence cites the law.
ANALYSIS = r"(?i)^(analysis|reasons?(\s+for\s+(decision|order|this\s+decision))?|findings?(\s+and\s+analysis)?|analysis\s+and\s+reasons?|determination|reasons?\s+and\s+analysis|reasons?\s+for\s+ruling)$"
AFTER_ANALYSIS = r"(?i)^(order|it\s+is\s+ordered|summary\s+of\s+order|schedule|appendix|background|introduction|issue|issues?\s+to\s+be\s+determined)$"
CITES = r"(?i)section\s+\d+|s\.\s*\d+|\bRTA\b|\bAct\b|subsection"
#: Shorter headings without a number end the analysis too; paragraphs of the analysis, and of a text without one, are longer than these.
SHORT_HEADING, ANALYSIS_PARAGRAPH, ANY_PARAGRAPH, PREAMBLE = 80, 30, 50, 3
SENTENCE_END = r"(?<=[.!?])\s+"


def heading_type(heading: Column) -> Column:
    """The clause type of the first word of HEADING_TYPES that the heading holds."""
    low = F.lower(heading)
    return F.coalesce(*(F.when(low.contains(w), kind) for w, kind in HEADING_TYPES), F.lit("standard_boilerplate"))


def sentence_chunks(text: Column, longest: int = LONGEST_CHUNK) -> Column:
    """A text of at most ``longest`` signs as it is; a longer one as whole sentences, as many to a chunk as fit."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(s: Column, x: Column) -> Column:
        full = (s["open"] != "") & (F.length(s["open"]) + F.length(x) + 1 > longest)
        done = F.when(full, F.array_append(s["done"], trimmed(s["open"]))).otherwise(s["done"])
        return F.struct(done.alias("done"), F.when(full | (s["open"] == ""), x).otherwise(trimmed(F.concat(s["open"], F.lit(" "), x))).alias("open"))

    packed = F.aggregate(F.split(text, SENTENCE_END), start, add, lambda s: F.when(s["open"] != "", F.array_append(s["done"], trimmed(s["open"]))).otherwise(s["done"]))
    return F.when(F.length(text) <= longest, F.array(text)).otherwise(packed)


def form_sections(docs: DataFrame) -> DataFrame:
    """doc_id, section (0 for what stands before the first), number, title, clause_type and text of forms.

    A line "n. heading" opens section n only if n follows the section that is
    open and is one of the form's; all other numbered lines belong to the open
    section. Blank lines go, lines are joined by blanks; null and blank texts
    have no section. Needs doc_id, text.
    """
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r"), trimmed), lambda x: x != "")
    rows = docs.select("doc_id", lines.alias("lines"))
    numbers = F.transform("lines", lambda x: F.coalesce(F.nullif(F.regexp_extract(x, FORM_HEADING, 1), F.lit("")).cast("int"), F.lit(0)))
    # The place of each accepted heading: the fold holds no more than the form's sections.
    step = f"""
        aggregate(transform(numbers, (n, i) -> named_struct('n', n, 'i', i)), cast(array() as array<int>),
          (at, x) -> if(x.n = size(at) + 1 and x.n <= {len(FORM_SECTIONS)}, array_append(at, x.i), at))"""
    rows = rows.withColumn("numbers", numbers).withColumn("at", F.expr(step))
    bounds = F.concat(F.array(F.lit(0)), F.col("at"), F.array(F.size("lines")))
    part = rows.withColumn("bounds", bounds).select("doc_id", "lines", "bounds", F.posexplode(F.slice("bounds", 1, F.size("bounds") - 1)).alias("section", "start"))
    stop = F.element_at("bounds", F.col("section") + 2)
    part = part.where(stop > F.col("start")).select("doc_id", "section", F.array_join(F.slice("lines", F.col("start") + 1, stop - F.col("start")), " ").alias("text"))
    known = F.array(F.struct(F.lit("preamble").alias("title"), F.lit("standard_boilerplate").alias("kind")), *(F.struct(F.lit(t).alias("title"), F.lit(k).alias("kind")) for t, k in FORM_SECTIONS))
    named = part.withColumn("known", F.element_at(known, F.col("section") + 1))
    return named.select("doc_id", "section", form_slug(F.col("section"), F.col("known.title")).alias("number"), F.col("known.title").alias("title"), F.col("known.kind").alias("clause_type"), "text")


def chunked_sections(sections: DataFrame) -> DataFrame:
    """Sections cut into chunks of whole sentences; the chunks after the first get .1, .2 and so on behind their number."""
    rows = sections.select(*(c for c in sections.columns if c != "text"), F.posexplode(sentence_chunks(F.col("text"))).alias("chunk", "text"))
    return rows.withColumn("number", F.when(F.col("chunk") == 0, F.col("number")).otherwise(F.concat_ws(".", "number", "chunk")))


def statute_chunks(sections: DataFrame, longest: int = LONGEST_CHUNK) -> DataFrame:
    """Long sections cut before "(n)", and parts that are still too long into whole sentences, numbered as chunked_sections does."""
    parts = F.filter(F.transform(F.split("text", r"(?=\(\d+\))"), trimmed), lambda x: x != "")
    pieces = F.when(F.length("text") <= longest, F.array("text")).otherwise(F.flatten(F.transform(parts, lambda x: sentence_chunks(x, longest))))
    rows = sections.select(*(c for c in sections.columns if c != "text"), F.posexplode(pieces).alias("chunk", "text"))
    return rows.withColumn("number", F.when(F.col("chunk") == 0, F.col("number")).otherwise(F.concat_ws(".", "number", "chunk")))


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def html_text(block: Column) -> Column:
    """The text of a piece of HTML: tags as blanks, the named entities read, single blanks."""
    text = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), _ENTITIES, F.regexp_replace(block, r"(?s)<[^>]*>", " "))
    return trimmed(F.regexp_replace(text, r"\s+", " "))


def analyses(pages: DataFrame) -> DataFrame:
    """page_id, summary, principle and found (analysis or paragraphs) of decisions whose summary says enough.

    The analysis is what stands between the first heading that begins one and
    the first later one that ends it: by its wording, or as a short one without
    a number. Its paragraphs of more than 30 signs are the summary; a decision
    without any is summed up by its paragraphs of more than 50 signs from the
    fourth on, or all of three or fewer. A summary is cut at the last blank
    within 2000 signs. The principle is the first of ten sentences that cites the
    law, else the first. Navigation, headers, footers, scripts and comments do
    not count; a null page has no summary. Needs page_id, html.
    """
    plain = reduce(lambda t, tag: F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}>", " "), ("script", "style", "nav", "header", "footer"), F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<!--.*?-->", " "))
    raw = F.regexp_extract_all(nfkc(F.col("plain")), F.lit(r"(?is)<(?:h[1-4]|p)\b[^>]*>.*?</(?:h[1-4]|p)>"), 0)
    pages = pages.select("page_id", plain.alias("plain"))

    def block(x: Column) -> Column:
        return F.struct(x.rlike(r"(?i)^<h").alias("head"), html_text(x).alias("text"))

    def kind(b: Column) -> Column:
        title = F.regexp_replace(b["text"], r"\.+$", "")
        ends = title.rlike(AFTER_ANALYSIS) | ((F.length(title) < SHORT_HEADING) & ~title.rlike(r"^\d+\."))
        return F.when(~b["head"], "p").when(title.rlike(ANALYSIS), "begin").when(ends, "end").otherwise("head")

    rows = pages.select("page_id", F.filter(F.transform(raw, block), lambda b: b["text"] != "").alias("b"))
    rows = rows.withColumn("k", F.transform("b", kind)).withColumn("first", F.array_position("k", "begin").cast("int"))
    after = F.when(F.col("first") > 0, F.slice("k", F.col("first") + 1, F.greatest(F.size("k") - F.col("first"), F.lit(0))))
    rows = rows.withColumn("last", F.array_position(after, "end").cast("int"))
    length = F.when(F.col("last") > 0, F.col("last") - 1).otherwise(F.greatest(F.size("b") - F.col("first"), F.lit(0)))
    texts = lambda blocks, least: F.transform(F.filter(blocks, lambda b: ~b["head"] & (F.length(b["text"]) > least)), lambda b: b["text"])
    inside = F.when(F.col("first") > 0, texts(F.slice("b", F.col("first") + 1, length), ANALYSIS_PARAGRAPH)).otherwise(F.array().cast("array<string>"))
    rows = rows.select("page_id", inside.alias("inside"), texts(F.col("b"), ANY_PARAGRAPH).alias("every"))
    every = F.when(F.size("every") > PREAMBLE, F.slice("every", PREAMBLE + 1, F.greatest(F.size("every") - PREAMBLE, F.lit(0)))).otherwise(F.col("every"))
    some = F.size("inside") > 0
    joined = F.array_join(F.when(some, F.col("inside")).otherwise(every), " ")
    rows = rows.select("page_id", joined.alias("joined"), F.when(some, "analysis").otherwise("paragraphs").alias("found"))
    summary = F.when(F.length("joined") > LONGEST_SUMMARY, F.regexp_replace(F.substring("joined", 1, LONGEST_SUMMARY), " [^ ]*$", "")).otherwise(F.col("joined"))
    # Rows have numbers here so that the filter below stays above: pushed down, it would read each page many times.
    rows = rows.select("page_id", "found", summary.alias("summary"), F.monotonically_increasing_id().alias("row"))
    said = F.slice(F.split("summary", SENTENCE_END), 1, PRINCIPLE_SENTENCES)
    cited = F.filter(said, lambda s: s.rlike(java(CITES)))
    principle = F.substring(F.when(F.size(cited) > 0, F.try_element_at(cited, F.lit(1))).otherwise(F.try_element_at(said, F.lit(1))), 1, LONGEST_PRINCIPLE)
    return rows.where((F.length("summary") >= SHORTEST_ANALYSIS) & (F.col("row") >= 0)).select("page_id", "summary", principle.alias("principle"), "found")


_CLASS = r"(?i)^<p\b[^>]*\bclass\s*=\s*[\"']([^\"']*)[\"']"
_TITLES = r"(?is)<td[^>]*>\s*<p\b[^>]*class\s*=\s*[\"']TOCid[\"'][^>]*>(.*?)</p>\s*</td>\s*<td[^>]*>\s*<p\b[^>]*class\s*=\s*[\"']table[\"'][^>]*>(.*?)</p>"


def statute_tree(pages: DataFrame, url: Column) -> DataFrame:
    """page_id, place, number, parent, title, clause_type, url and text of a statute's sections and subsections.

    A paragraph of class section with a number opens a section; a second one
    with the same number, or one without, only ends the section before. The
    paragraphs of class paragraph or subsection behind it belong to its
    subsection "(n)", if one of them began so, else to the section's own text. A
    section is the parent of its subsections and holds only what stands before
    them. Titles come from the table of contents, the last of equal numbers;
    ``url`` gets the nearest anchor named BK... before. Needs page_id, html;
    page_id must be unique. A null page has no section.
    """
    html = pages.withColumn("html", nfkc(F.coalesce("html", F.lit(""))))
    ids, titles = (F.transform(F.regexp_extract_all("html", F.lit(_TITLES), g), html_text) for g in (1, 2))
    contents = html.select("page_id", F.posexplode(F.arrays_zip(F.transform(ids, lambda x: F.regexp_replace(x, r"\.+$", "")).alias("number"), titles.alias("title"))).alias("n", "t"))
    contents = contents.where("t.number <> ''").groupBy("page_id", F.col("t.number").alias("number")).agg(F.max_by("t.title", "n").alias("title"))
    blocks = html.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*>|<p\b[^>]*>.*?</p>"), 0)).alias("n", "block"))
    classes = F.split(F.regexp_extract("block", _CLASS, 1), r"\s+")
    rows = blocks.select(
        "page_id",
        "n",
        F.array_contains(classes, "section").alias("opens"),
        (F.array_contains(classes, "paragraph") | F.array_contains(classes, "subsection")).alias("follows"),
        html_text(F.col("block")).alias("text"),
        F.nullif(F.regexp_extract("block", r"(?i)^<a\b[^>]*\bname\s*=\s*[\"'](BK[^\"']*)[\"']", 1), F.lit("")).alias("anchor"),
    )
    so_far = Window.partitionBy("page_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"part": F.sum(F.col("opens").cast("int")).over(so_far), "anchor": F.last("anchor", ignorenulls=True).over(so_far)})
    rows = rows.where((F.col("part") > 0) & (F.col("opens") | F.col("follows") & (F.col("text") != "")))
    own = F.nullif(F.regexp_extract("text", r"^(\d{1,3}(?:\.\d+)?)", 1), F.lit(""))
    in_part = Window.partitionBy("page_id", "part").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    key = F.nullif(F.when(~F.col("opens"), F.regexp_extract("text", r"^\((\d+)\)", 1)), F.lit(""))
    rows = rows.withColumns({"number": F.first(F.when(F.col("opens"), own)).over(in_part), "anchor": F.first("anchor").over(in_part), "key": F.last(key, ignorenulls=True).over(in_part)})
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ")
    parts = rows.where("number is not null").groupBy("page_id", "part", "number", "anchor", "key").agg(F.min("n").alias("place"), texts.alias("text"))
    once = F.min("part").over(Window.partitionBy("page_id", "number"))
    parts = parts.withColumn("first", once).where((F.col("part") == F.col("first")) & (F.col("text") != ""))
    named = parts.join(contents, ["page_id", "number"], "left")
    child = F.col("key").isNotNull()
    return named.select(
        "page_id",
        "place",
        F.when(child, F.concat("number", F.lit("("), "key", F.lit(")"))).otherwise(F.col("number")).alias("number"),
        F.when(child, F.col("number")).alias("parent"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(section_type(F.col("number")), F.lit("general")).alias("clause_type"),
        F.concat(url, F.coalesce(F.concat(F.lit("#"), "anchor"), F.lit(""))).alias("url"),
        "text",
    )


_NUMBER = r"^(\d+(?:\.\d+)?)"


def regulation_sections(pages: DataFrame) -> DataFrame:
    """page_id, place, number, title, text and found_by (class or paragraphs) of a regulation's sections.

    A paragraph of class section-e with a number opens a section, the first
    with that number counts; any of that class ends the section before.
    Paragraphs of other classes that end in -e belong to the open section. The
    last headnote since the section before is a section's title, that of the
    last paragraph with its number. A page without such sections is read by
    paragraphs: "n." or "n)" opens a section, all others belong to the open one.
    Sections without a title are called by their number. Needs page_id, html;
    page_id must be unique. A null page has no section.
    """
    html = pages.select("page_id", nfkc(F.coalesce("html", F.lit(""))).alias("html"))
    blocks = html.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<p\b[^>]*>.*?</p>"), 0)).alias("place", "block"))
    kind = F.try_element_at(F.split(F.trim(F.regexp_extract("block", _CLASS, 1)), r"\s+"), F.lit(1))
    rows = blocks.select("page_id", "place", kind.alias("kind"), html_text(F.col("block")).alias("text"))
    found = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    opens = F.col("kind") == "section-e"
    rows = rows.withColumn("number", F.when(opens, F.coalesce(found(r"^(\d+(?:\.\d+)?)\s*[.(]"), found(_NUMBER))))
    upto = Window.partitionBy("page_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("page_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"part": F.sum(opens.cast("int")).over(upto), "since": F.coalesce(F.sum(F.col("number").isNotNull().cast("int")).over(before), F.lit(0))})
    note = F.last(F.when(F.col("kind") == "headnote-e", F.nullif("text", F.lit(""))), ignorenulls=True).over(Window.partitionBy("page_id", "since").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("note", F.when(F.col("number").isNotNull(), note))
    titles = rows.where("note is not null").groupBy("page_id", "number").agg(F.max_by("note", "place").alias("title"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ")
    inside = rows.where((F.col("part") > 0) & (opens | F.col("kind").endswith("-e") & (F.col("text") != "")))
    parts = inside.groupBy("page_id", "part").agg(F.min("place").alias("place"), F.max("number").alias("number"), joined.alias("text")).where("number is not null")
    first = F.row_number().over(Window.partitionBy("page_id", "number").orderBy("place"))
    by_class = parts.withColumn("k", first).where("k = 1").join(titles, ["page_id", "number"], "left").select("page_id", "place", "number", "title", "text", F.lit("class").alias("found_by"))

    plain = rows.where("text <> ''").join(by_class.select("page_id").distinct(), "page_id", "left_anti").select("page_id", "place", "text")
    plain = plain.withColumn("number", F.when(F.col("text").rlike(r"^\d{1,3}(?:\.\d+)?\s*[.)]"), found(_NUMBER)))
    plain = plain.withColumn("part", F.sum(F.col("number").isNotNull().cast("int")).over(upto)).where("part > 0")
    by_paragraph = plain.groupBy("page_id", "part").agg(F.min("place").alias("place"), F.max("number").alias("number"), joined.alias("text"))
    by_paragraph = by_paragraph.select("page_id", "place", "number", F.lit(None).cast("string").alias("title"), "text", F.lit("paragraphs").alias("found_by"))
    return by_class.unionByName(by_paragraph).withColumn("title", F.coalesce("title", F.concat(F.lit("Section "), "number")))


def in_reading_order(blocks: DataFrame, gap: float = COLUMN_GAP) -> DataFrame:
    """Blocks with col, from 0, and place, from 1: column by column, from top to bottom.

    Where the starts of a page's blocks are more than ``gap`` apart in x, a
    column begins; a block left of zero belongs to the last one. Blocks of equal
    height keep their order. Needs file, page, n, x0, y0; null positions count
    as 0.
    """
    at = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    by_x = Window.partitionBy("file", "page").orderBy(at("x0"))
    jump = (at("x0") - F.lag(at("x0")).over(by_x.orderBy(at("x0"), "n")) > gap) & (at("x0") >= 0)
    # The first jump from below zero into the page opens no column unless its middle lies inside the page.
    middle = (at("x0") + F.lag(at("x0")).over(by_x.orderBy(at("x0"), "n"))) / 2
    opens = F.coalesce((jump & (middle > 0)).cast("int"), F.lit(0))
    rows = blocks.withColumn("_opens", opens)
    col = F.sum("_opens").over(by_x.rangeBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("col", F.when(at("x0") < 0, F.sum("_opens").over(Window.partitionBy("file", "page"))).otherwise(col).cast("int"))
    place = F.row_number().over(Window.partitionBy("file", "page").orderBy("col", at("y0"), "n"))
    return rows.withColumn("place", place).drop("_opens")
