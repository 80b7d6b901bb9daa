"""Queries of structure: forms, decisions, statutes and printed pages, made from the tables' texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.operators import parsing
from clausegrid.operators.intake import SECTION_TYPES
from clausegrid.plans.queries import _TRIM, query
from clausegrid.sources import tables

_TITLE_SQL = "['preamble', " + ", ".join("'" + t.replace("'", "''") + "'" for t, _ in parsing.FORM_SECTIONS) + "]"
_TYPE_SQL = "['standard_boilerplate', " + ", ".join(f"'{k}'" for _, k in parsing.FORM_SECTIONS) + "]"
_FORMS_SQL = rf"""
f AS (SELECT doc_id, list_transform(string_split(text, '. '), lambda x, i: CAST((i - 1 + (i - 1) // 3 + doc_id % 2) % 19 AS VARCHAR) || '. ' || x) AS made FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(string_split(replace(array_to_string(made, chr(10)), chr(13), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(array_to_string(made, chr(10)), chr(13), chr(10)), chr(10)), 1) AS j FROM f),
t AS (SELECT doc_id, j, {_TRIM.format("line")} AS line FROM u),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i, TRY_CAST(nullif(regexp_extract(line, '{parsing.FORM_HEADING}', 1), '') AS INTEGER) AS num FROM t WHERE line <> ''),
s(doc_id, n, here) AS (
  SELECT DISTINCT doc_id, 0, CAST(0 AS BIGINT) FROM l
  UNION ALL
  SELECT s.doc_id, s.n + 1, min(l.i) FROM s JOIN l ON l.doc_id = s.doc_id AND l.num = s.n + 1 AND l.i > s.here WHERE s.n < 17 GROUP BY s.doc_id, s.n),
e AS (SELECT doc_id, n, greatest(here, 1) AS here, coalesce(lead(here) OVER (PARTITION BY doc_id ORDER BY n), 1000000000) AS stop FROM s),
sections AS (
  SELECT e.doc_id, e.n AS section, string_agg(l.line, ' ' ORDER BY l.i) AS text
  FROM e JOIN l ON l.doc_id = e.doc_id AND l.i >= e.here AND l.i < e.stop GROUP BY e.doc_id, e.n),
named AS (
  SELECT doc_id, section, {_TITLE_SQL}[section + 1] AS title, {_TYPE_SQL}[section + 1] AS clause_type, text,
         'form_' || lpad(CAST(section AS VARCHAR), 2, '0') || '_' || left(regexp_replace(regexp_replace(lower({_TITLE_SQL}[section + 1]), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 40) AS number FROM sections)"""


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as forms: every sentence is a line with a number, and the numbers skip and repeat."""
    docs = tables.table(spark, sf_dir, "documents").where("text is not null")
    made = F.transform(F.split("text", r"\. ", -1), lambda x, i: F.concat(F.expr("0").cast("long") + (i + F.floor(i / 3) + F.col("doc_id") % 2) % 19, F.lit(". "), x))
    return docs.select("doc_id", F.array_join(made, "\n").alias("text"))


@query(f"WITH RECURSIVE {_FORMS_SQL} SELECT doc_id, section, number, title, clause_type, length(text) AS n_chars, md5(text) AS digest FROM named")
def form_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parsing.form_sections(_forms(spark, sf_dir))
    return found.select("doc_id", "section", "number", "title", "clause_type", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(rf"""
WITH RECURSIVE {_FORMS_SQL},
p AS (SELECT doc_id, section, number, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS x FROM named WHERE length(text) > 2000),
q AS (SELECT doc_id, section, number, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM p),
r(doc_id, section, i, chunk, size) AS (
  SELECT doc_id, section, i, 0, length(x) FROM q WHERE i = 1
  UNION ALL
  SELECT q.doc_id, q.section, q.i, CASE WHEN r.size + length(q.x) + 1 > 2000 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.size + length(q.x) + 1 > 2000 THEN length(q.x) ELSE r.size + 1 + length(q.x) END
  FROM r JOIN q ON q.doc_id = r.doc_id AND q.section = r.section AND q.i = r.i + 1),
c AS (SELECT q.doc_id, q.number, r.chunk, {_TRIM.format("string_agg(q.x, ' ' ORDER BY q.i)")} AS text FROM q JOIN r ON r.doc_id = q.doc_id AND r.section = q.section AND r.i = q.i GROUP BY ALL)
SELECT doc_id, CASE WHEN chunk = 0 THEN number ELSE number || '.' || chunk END AS number, md5(text) AS digest FROM c
UNION ALL SELECT doc_id, number, md5(text) FROM named WHERE length(text) <= 2000""")
def form_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parsing.chunked_sections(parsing.form_sections(_forms(spark, sf_dir)))
    return found.select("doc_id", "number", F.md5(F.col("text").cast("binary")).alias("digest"))


# What is put behind a page's title, by page_id: nothing, an analysis of its own, one that goes on, one that ends at once, nothing of the page.
_BEHIND = (
    "",
    "<h2>Reasons for Decision.</h2><p>The tenant paid the rent for the month in question. The Board finds that s. 26 of the RTA applies here!</p><h3>12. A numbered heading that does not end it</h3><p>Too short to count.</p><p>The landlord gave no notice of the entry at any time.</p><h4>Order</h4>",
    "<h2>Findings and analysis</h2><h3>1. The rent</h3>",
    "<h2>ANALYSIS</h2><h3>Other heading</h3>",
    "",
)


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    behind = F.element_at(F.array(*map(F.lit, _BEHIND)), (F.col("page_id") % 5 + 1).cast("int"))
    html = F.when(F.col("page_id") % 5 == 4, "<p>A page of one paragraph that says too little for a summary.</p>").otherwise(F.replace("html", F.lit("</h1>"), F.concat(F.lit("</h1>"), behind)))
    return tables.table(spark, sf_dir, "pages").select("page_id", html.alias("html"))


def _html_text_sql(x: str) -> str:
    out = f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"
    for entity, sign in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&nbsp;", "' '"), ("&amp;", "'&'")):
        out = f"replace({out}, '{entity}', {sign})"
    return _TRIM.format(rf"regexp_replace({out}, '\s+', ' ', 'g')")


def _without_sql(x: str) -> str:
    out = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "nav", "header", "footer"):
        out = rf"regexp_replace({out}, '(?is)<{tag}\b.*?</{tag}>', ' ', 'g')"
    return out


_SENTENCES_SQL = r"string_split(regexp_replace(summary, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1:10]"


@query(rf"""
WITH h AS (SELECT page_id, CASE WHEN page_id % 5 = 4 THEN '<p>A page of one paragraph that says too little for a summary.</p>' ELSE replace(html, '</h1>', '</h1>' || [{", ".join(f"'{x}'" for x in _BEHIND)}][1 + page_id % 5]) END AS html FROM pages),
r AS (SELECT page_id, regexp_extract_all({_without_sql("html")}, '(?is)<(?:h[1-4]|p)\b[^>]*>.*?</(?:h[1-4]|p)>') AS b FROM h),
x AS (SELECT page_id, unnest(b) AS block, generate_subscripts(b, 1) AS n FROM r),
t AS (SELECT page_id, n, regexp_matches(block, '(?i)^<h') AS head, {_html_text_sql("block")} AS text FROM x),
k AS (SELECT *, regexp_replace(text, '\.+$', '') AS title FROM t WHERE text <> ''),
m AS (SELECT *, head AND regexp_matches(title, '{parsing.ANALYSIS}') AS begins, head AND NOT regexp_matches(title, '{parsing.ANALYSIS}') AND (regexp_matches(title, '{parsing.AFTER_ANALYSIS}') OR (length(title) < 80 AND NOT regexp_matches(title, '^\d+\.'))) AS ends FROM k),
b AS (SELECT page_id, min(n) AS first FROM m WHERE begins GROUP BY page_id),
e AS (SELECT m.page_id, min(m.n) AS last FROM m JOIN b USING (page_id) WHERE m.ends AND m.n > b.first GROUP BY m.page_id),
i AS (SELECT m.page_id, string_agg(text, ' ' ORDER BY n) AS joined FROM m JOIN b USING (page_id) LEFT JOIN e USING (page_id) WHERE NOT head AND n > first AND n < coalesce(last, 1000000) AND length(text) > 30 GROUP BY m.page_id),
a AS (SELECT page_id, n, text, row_number() OVER (PARTITION BY page_id ORDER BY n) AS j, count(*) OVER (PARTITION BY page_id) AS c FROM m WHERE NOT head AND length(text) > 50),
f AS (SELECT page_id, string_agg(text, ' ' ORDER BY n) AS joined FROM a WHERE c <= 3 OR j > 3 GROUP BY page_id),
o AS (SELECT h.page_id, coalesce(i.joined, f.joined, '') AS joined, CASE WHEN i.joined IS NULL THEN 'paragraphs' ELSE 'analysis' END AS found FROM h LEFT JOIN i USING (page_id) LEFT JOIN f USING (page_id)),
s AS (SELECT page_id, found, CASE WHEN length(joined) > 2000 THEN regexp_replace(left(joined, 2000), ' [^ ]*$', '') ELSE joined END AS summary FROM o)
SELECT page_id, found, length(summary) AS n_chars, md5(summary) AS digest,
       left(coalesce(list_filter({_SENTENCES_SQL}, lambda x: regexp_matches(x, '{parsing.CITES}'))[1], ({_SENTENCES_SQL})[1]), 500) AS principle FROM s WHERE length(summary) >= 100""")
def decision_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as decisions: with an analysis, with one that ends at once, without any, and with too little text."""
    found = parsing.analyses(_decided(spark, sf_dir))
    return found.select("page_id", "found", F.length("summary").cast("long").alias("n_chars"), F.md5(F.col("summary").cast("binary")).alias("digest"), "principle")


# A paragraph's tag by its place on the page, from 0: sections, one that repeats a number, one without a number, subsections and what follows them.
_TAGS = ('<p class="section">{n} ', '<p class="subsection">(1) ', '<p class="paragraph">', '<p class="big subsection">({m}) ', "<p>", '<a name="BK{n}"></a><p class="section">{n}.1 ', '<p class="paragraph">', '<p class="section">{d} ')


def _tags_sql(tags: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + t.replace("{n}", "' || (i + page_id % 60) || '").replace("{m}", "' || (i % 3) || '").replace("{d}", "' || (5 + page_id % 60) || '") + "'" for t in tags) + "]"


def _tagged_sql(tags: tuple[str, ...]) -> str:
    return f"array_to_string(list_transform(parts, lambda x, j: list_transform([j - 1], lambda i: {_tags_sql(tags)}[1 + i % {len(tags)}])[1] || x), '')"


_STATUTE_HEAD = '<table><tr><td><p class="TOCid">{n}.</p></td><td> <p class="table">Title &amp; more</p></td></tr></table>'


def _tagged(tags: tuple[str, ...]):
    """The paragraphs of a page, each behind a tag that goes by its place."""
    page = F.col("page_id") % 60

    def tag(i):
        made = [F.concat(*(F.lit(p) if p not in ("{n}", "{m}", "{d}") else {"{n}": i + page, "{m}": i % 3, "{d}": 5 + page}[p] for p in _pieces(t))) for t in tags]
        return F.element_at(F.array(*made), (i % len(tags) + 1).cast("int"))

    return F.array_join(F.transform(F.slice(F.split("html", "<p>", -1), 2, 10_000), lambda x, i: F.concat(tag(i), x)), "")


def _statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as statutes: their paragraphs get the classes of sections and subsections, and a table of contents goes before."""
    head = F.concat(*(F.lit(p) if p != "{n}" else F.col("page_id") % 60 for p in _pieces(_STATUTE_HEAD)))
    return tables.table(spark, sf_dir, "pages").select("page_id", F.concat(head, _tagged(_TAGS)).alias("html"))


def _pieces(text: str) -> list[str]:
    for mark in ("{n}", "{m}", "{d}"):
        text = text.replace(mark, f"\x00{mark}\x00")
    return [p for p in text.split("\x00") if p]


_SECTION_SQL = "CASE " + " ".join(f"WHEN CAST(regexp_extract(number, '^(\\d+)', 1) AS INTEGER) BETWEEN {a} AND {b} THEN '{k}'" for a, b, k in SECTION_TYPES) + " ELSE 'general' END"


@query(rf"""
WITH s AS (SELECT page_id, list_slice(string_split(html, '<p>'), 2, 10001) AS parts FROM pages),
h AS (SELECT page_id, '{_STATUTE_HEAD.replace("{n}", "' || (page_id % 60) || '")}' || {_tagged_sql(_TAGS)} AS html FROM s),
r AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*>|<p\b[^>]*>.*?</p>') AS b FROM h),
x AS (SELECT page_id, unnest(b) AS block, generate_subscripts(b, 1) - 1 AS n FROM r),
c AS (SELECT page_id, n, regexp_extract(block, '(?i)^<p\b[^>]*\bclass\s*=\s*["'']([^"'']*)["'']', 1) AS c, {_html_text_sql("block")} AS text, nullif(regexp_extract(block, '(?i)^<a\b[^>]*\bname\s*=\s*["''](BK[^"'']*)["'']', 1), '') AS anchor FROM x),
d AS (SELECT *, c = 'section' AS opens, c IN ('paragraph', 'subsection', 'big subsection') AS follows FROM c),
p AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER w AS part, last_value(anchor IGNORE NULLS) OVER w AS near FROM d WINDOW w AS (PARTITION BY page_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
o AS (SELECT page_id, part, nullif(regexp_extract(text, '^(\d{{1,3}}(?:\.\d+)?)', 1), '') AS number, near FROM p WHERE opens),
q AS (SELECT p.page_id, p.part, p.n, p.text, o.number, o.near, last_value(CASE WHEN NOT p.opens THEN nullif(regexp_extract(p.text, '^\((\d+)\)', 1), '') END IGNORE NULLS) OVER (PARTITION BY p.page_id, p.part ORDER BY p.n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS key
  FROM p JOIN o ON o.page_id = p.page_id AND o.part = p.part WHERE p.opens OR (p.follows AND p.text <> '')),
g AS (SELECT page_id, part, number, near, key, min(n) AS place, string_agg(text, ' ' ORDER BY n) AS text FROM q WHERE number IS NOT NULL GROUP BY ALL),
f AS (SELECT *, min(part) OVER (PARTITION BY page_id, number) AS first FROM g)
SELECT page_id, CAST(place AS INTEGER) AS place, number || coalesce('(' || key || ')', '') AS number, CASE WHEN key IS NOT NULL THEN number END AS parent,
       CASE WHEN number = CAST(page_id % 60 AS VARCHAR) THEN 'Title & more' ELSE '' END AS title, {_SECTION_SQL} AS clause_type, 'act' || coalesce('#' || near, '') AS url, md5(text) AS digest
FROM f WHERE part = first""")
def statute_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parsing.statute_tree(_statutes(spark, sf_dir), F.lit("act"))
    return found.select("page_id", "place", "number", "parent", "title", "clause_type", "url", F.md5(F.col("text").cast("binary")).alias("digest"))


# A regulation's paragraphs: headnotes, sections, one that repeats a number, one without; every fourth page has no classes.
_RULES = ('<p class="headnote-e">', '<p class="section-e">{n}.(1) ', '<p class="paragraph-e">', '<p class="section-e">', '<p class="headnote-e">{m} ', '<p class="clause-e small">', '<p class="section-e">{d}.(2) ', "<p>{d}) ", '<p class="section-e">{n} ')
_PLAIN = ("<p>", "<p>{n}. ", "<p>", "<p>{m}) ")


@query(rf"""
WITH s AS (SELECT page_id, list_slice(string_split(html, '<p>'), 2, 10001) AS parts FROM pages),
h AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN {_tagged_sql(_PLAIN)} ELSE {_tagged_sql(_RULES)} END AS html FROM s),
r AS (SELECT page_id, regexp_extract_all(html, '(?is)<p\b[^>]*>.*?</p>') AS b FROM h),
x AS (SELECT page_id, unnest(b) AS block, generate_subscripts(b, 1) - 1 AS n FROM r),
c AS (SELECT page_id, n, regexp_extract(block, '(?i)^<p\b[^>]*\bclass\s*=\s*["'']([^"'' ]*)', 1) AS c, {_html_text_sql("block")} AS text FROM x),
d AS (SELECT *, c = 'section-e' AS opens, CASE WHEN c = 'section-e' THEN coalesce(nullif(regexp_extract(text, '^(\d+(?:\.\d+)?)\s*[.(]', 1), ''), nullif(regexp_extract(text, '^(\d+(?:\.\d+)?)', 1), '')) END AS number FROM c),
p AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER w AS part, sum(CAST(number IS NOT NULL AS INTEGER)) OVER w - CAST(number IS NOT NULL AS INTEGER) AS since FROM d WINDOW w AS (PARTITION BY page_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
h2 AS (SELECT page_id, n, number, (SELECT arg_max(q.text, q.n) FROM p q WHERE q.page_id = p.page_id AND q.since = p.since AND q.n < p.n AND q.c = 'headnote-e' AND q.text <> '') AS note FROM p WHERE number IS NOT NULL),
t AS (SELECT page_id, number, arg_max(note, n) AS title FROM h2 WHERE note IS NOT NULL GROUP BY ALL),
g AS (SELECT page_id, part, min(n) AS place, max(number) AS number, string_agg(text, ' ' ORDER BY n) AS text FROM p WHERE part > 0 AND (opens OR (c LIKE '%-e' AND text <> '')) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id, number ORDER BY place) AS k FROM g WHERE number IS NOT NULL),
a AS (SELECT k.page_id, place, k.number, title, text, 'class' AS found_by FROM k LEFT JOIN t ON t.page_id = k.page_id AND t.number = k.number WHERE k = 1),
f AS (SELECT page_id, n, text, CASE WHEN regexp_matches(text, '^\d{{1,3}}(?:\.\d+)?\s*[.)]') THEN regexp_extract(text, '^(\d+(?:\.\d+)?)', 1) END AS number FROM c WHERE text <> '' AND page_id NOT IN (SELECT page_id FROM a)),
o AS (SELECT *, sum(CAST(number IS NOT NULL AS INTEGER)) OVER (PARTITION BY page_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM f),
b AS (SELECT page_id, min(n) AS place, max(number) AS number, NULL AS title, string_agg(text, ' ' ORDER BY n) AS text, 'paragraphs' AS found_by FROM o WHERE part > 0 GROUP BY page_id, part)
SELECT page_id, CAST(place AS INTEGER) AS place, number, coalesce(title, 'Section ' || number) AS title, md5(text) AS digest, found_by FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def regulation_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as regulations: with classes and headnotes, or with plain paragraphs."""
    html = F.when(F.col("page_id") % 4 == 0, _tagged(_PLAIN)).otherwise(_tagged(_RULES))
    found = parsing.regulation_sections(tables.table(spark, sf_dir, "pages").select("page_id", html.alias("html")))
    return found.select("page_id", "place", "number", "title", F.md5(F.col("text").cast("binary")).alias("digest"), "found_by")


@query("""
WITH b AS (SELECT event_id // 40 AS page, event_id AS n, (event_id * 37 % 5) * (40 + user_id % 90) + value - 20 AS x0, CAST((user_id * 7) % 300 AS DOUBLE) AS y0 FROM events),
d AS (SELECT DISTINCT page, x0 FROM b),
g AS (SELECT *, lag(x0) OVER (PARTITION BY page ORDER BY x0) AS before FROM d),
c AS (SELECT page, (x0 + before) / 2 AS edge FROM g WHERE x0 - before > 100 AND (x0 + before) / 2 > 0),
k AS (SELECT b.page, b.n, b.y0, CASE WHEN x0 < 0 THEN (SELECT count(*) FROM c WHERE c.page = b.page) ELSE (SELECT count(*) FROM c WHERE c.page = b.page AND c.edge <= b.x0) END AS col FROM b)
SELECT page, n, CAST(col AS INTEGER) AS col, CAST(row_number() OVER (PARTITION BY page ORDER BY col, y0, n) AS INTEGER) AS place FROM k""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty events as the blocks of a page, their places made from their numbers."""
    x = F.expr("(event_id * 37 % 5) * (40 + user_id % 90) + value - 20")
    blocks = tables.table(spark, sf_dir, "events").select(F.lit(0).alias("file"), F.expr("event_id div 40").alias("page"), F.col("event_id").alias("n"), x.alias("x0"), F.expr("cast((user_id * 7) % 300 as double)").alias("y0"))
    return parsing.in_reading_order(blocks).select("page", "n", "col", "place")


@query(f"""
WITH h AS (SELECT event_id, ['Rent and deposit', 'Key Deposit', 'Quiet Enjoyment', 'PETS', 'Storage', 'Other', 'Last month', 'Notice of entry'][1 + event_id % 8] || ' ' || event_type AS heading FROM events)
SELECT event_id, CASE {" ".join(f"WHEN contains(lower(heading), '{w}') THEN '{k}'" for w, k in parsing.HEADING_TYPES)} ELSE 'standard_boilerplate' END AS clause_type FROM h""")
def heading_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("Rent and deposit", "Key Deposit", "Quiet Enjoyment", "PETS", "Storage", "Other", "Last month", "Notice of entry")))
    heading = F.concat(F.element_at(names, (F.col("event_id") % 8 + 1).cast("int")), F.lit(" "), F.col("event_type"))
    return tables.table(spark, sf_dir, "events").select("event_id", parsing.heading_type(heading).alias("clause_type"))


@query(f"WITH RECURSIVE {_FORMS_SQL} SELECT doc_id, section, title, clause_type, md5(text) AS digest FROM named")
def form_sections_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of forms by the table function, in SQL."""
    from clausegrid.functions.tables import registered

    session = registered(spark)
    return session.sql("SELECT f.doc_id, s.section, s.title, s.clause_type, md5(CAST(s.text AS BINARY)) AS digest FROM {forms} AS f, LATERAL form_sections(f.text) AS s", forms=_forms(spark, sf_dir))
