"""Queries over the function library and over what readers of a lease are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.functions import cleaning, dates, payloads
from clausegrid.operators import events, intake, reports, retrieval, screening
from clausegrid.plans.queries import CLAUSES_SQL, _clauses, query
from clausegrid.sources import tables

_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_WORDS = ("notice", "rent", "de", "the")
_STOPS = "[" + ", ".join(f"'{w}'" for w in cleaning.STATUTE_STOPS) + "]"
_DSTOPS = "[" + ", ".join(f"'{w}'" for w in cleaning.DECISION_STOPS) + "]"


def _md5(x: F.Column) -> F.Column:
    return F.md5(x.cast("binary"))


@query(f"""
WITH t AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.;])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s,
             string_split_regex(regexp_replace(lower(text), '[^a-z\\s]', ' ', 'g'), '\\s+') AS w FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, list_transform(s, lambda x: {" + ".join(f"CAST(contains(lower(x), '{w}') AS INTEGER)" for w in _WORDS)}) AS hits FROM t),
b AS (SELECT *, list_max(hits) AS best, {_TRIM.format("s[list_position(hits, list_max(hits))]")} AS sentence FROM h)
SELECT doc_id,
       md5({_TRIM.format("regexp_replace(translate(lower(text), '‘’‚‛′‵`“”„‟″‶–—', chr(39) || chr(39) || chr(39) || chr(39) || chr(39) || chr(39) || chr(39) || '\"\"\"\"\"\"--'), '\\s+', ' ', 'g')")}) AS normalized,
       md5({_TRIM.format("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '<\\|[^|]*\\|>', '', 'g'), '(?i)\\[/?INST\\]', '', 'g'), '(?i)<</?SYS>>', '', 'g'), '\\n{4,}', chr(10) || chr(10), 'g')")}) AS chat,
       md5({_TRIM.format("regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{4,}', repeat(chr(10), 3), 'g'), '\\[object Object\\]', '', 'g')")}) AS cleaned,
       CASE WHEN best = 0 OR sentence = '' THEN {_TRIM.format("left(text, 250)")} || CASE WHEN length(text) > 250 THEN '…' ELSE '' END WHEN length(sentence) > 300 THEN {_TRIM.format("left(sentence, 300)")} || '…' ELSE sentence END AS sentence,
       array_to_string(list_filter(list_filter(w, lambda x: length(x) > 3 AND NOT list_contains({_STOPS}, x)), lambda x, i: list_position(list_filter(w, lambda x: length(x) > 3 AND NOT list_contains({_STOPS}, x)), x) = i)[1:5], ',') AS words,
       array_to_string(list_filter(w, lambda x: length(x) > 4 AND NOT list_contains({_DSTOPS}, x))[1:4], ',') AS decision_words,
       len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n_words,
       CASE WHEN length(text) > 0 THEN floor(length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) / CAST(length(text) AS DOUBLE) * 1e6 + 0.5) ELSE 0 END AS beyond_ascii
FROM b""")
def text_cleanups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean-ups and readings of whole texts."""
    t = F.col("text")
    return tables.table(spark, sf_dir, "documents").where("text is not null").select(
        "doc_id",
        _md5(cleaning.normalized(t)).alias("normalized"),
        _md5(cleaning.safe_chat(t)).alias("chat"),
        _md5(cleaning.clean_text(t)).alias("cleaned"),
        cleaning.best_sentence(t, list(_WORDS)).alias("sentence"),
        F.array_join(cleaning.search_words(t), ",").alias("words"),
        F.array_join(cleaning.search_words(t, cleaning.DECISION_STOPS, 4, 4, once=False), ",").alias("decision_words"),
        cleaning.word_count(t).cast("long").alias("n_words"),
        F.floor(cleaning.non_ascii_share(t) * 1e6 + 0.5).cast("double").alias("beyond_ascii"),
    )


@query(r"""
WITH p AS (SELECT p_partkey AS k, p_name || ' <O''Neil>' || chr(9) || ' {' || p_type || '}' AS n, p_type || '/' || p_name || '.v' || p_size || '.pdf' AS path,
             p_brand || ' s.' || (p_partkey % 150) || ' — ' || p_name AS ref, 'Error at /tmp/' || p_brand || ', C:\temp\x: ' || p_name AS msg, (p_partkey % 40) || ['(2)', '.1', '0', '', '.x'][1 + p_partkey % 5] AS found FROM part)
SELECT k, regexp_replace(path, '[^a-zA-Z0-9._-]', '_', 'g') AS file, regexp_replace(string_split(path, '/')[-1], '\.[^.]+$', '') AS base,
       array_to_string(list_transform(regexp_extract_all(n, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda w: upper(left(w, 1)) || substring(w, 2)), '') AS title,
       'form_' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') || '_' || left(regexp_replace(regexp_replace(lower(n), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 40) AS slug,
       left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(n, '[\x00-\x1F\x7F]', ' ', 'g'), '[<>{}\[\]\\`]', '', 'g'), '\s{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g'), 120) AS name,
       regexp_extract(ref, 's\.(\S+)\s*[—–-]\s*(.+)', 1) AS section, regexp_extract(ref, 's\.(\S+)\s*[—–-]\s*(.+)', 2) AS heading,
       left(regexp_replace(msg, '(?:/[^\s,;:''"]{2,}|[A-Z]:\\[^\s,;:''"]{2,})', '[path]', 'g'), 200) AS message,
       found = CAST(k % 40 AS VARCHAR) OR (starts_with(found, CAST(k % 40 AS VARCHAR)) AND regexp_matches(substring(found, length(CAST(k % 40 AS VARCHAR)) + 1), '^(\(.*|(\.\d+)+)$')) AS met
FROM p""")
def name_cleanups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, paths, references and messages made safe or read."""
    k = F.col("p_partkey")
    parts = tables.table(spark, sf_dir, "part").select(
        k.alias("k"),
        F.concat("p_name", F.lit(" <O'Neil>\t {"), "p_type", F.lit("}")).alias("n"),
        F.concat("p_type", F.lit("/"), "p_name", F.lit(".v"), "p_size", F.lit(".pdf")).alias("path"),
        F.concat("p_brand", F.lit(" s."), k % 150, F.lit(" — "), "p_name").alias("ref"),
        F.concat(F.lit("Error at /tmp/"), "p_brand", F.lit(", C:\\temp\\x: "), "p_name").alias("msg"),
        F.concat(k % 40, F.element_at(F.array(*map(F.lit, ("(2)", ".1", "0", "", ".x"))), (k % 5 + 1).cast("int"))).alias("found"),
    )
    cited = cleaning.cited_section(F.col("ref"))
    return parts.select(
        "k",
        cleaning.safe_file_name(F.col("path")).alias("file"),
        cleaning.base_name(F.col("path")).alias("base"),
        cleaning.title_case(F.col("n")).alias("title"),
        cleaning.form_slug(F.col("k") % 100, F.col("n")).alias("slug"),
        cleaning.safe_name(F.col("n")).alias("name"),
        cited["section"].alias("section"),
        cited["title"].alias("heading"),
        cleaning.without_paths(F.col("msg")).alias("message"),
        cleaning.covers((F.col("k") % 40).cast("string"), F.col("found")).alias("met"),
    )


@query(r"""
SELECT page_id, coalesce(nullif(upper(regexp_extract(url, '(?i)/(\d{4}onltb\d+)/', 1)), ''), left(upper(regexp_replace(string_split(regexp_replace(url, '/$', ''), '/')[-1], '[^a-zA-Z0-9]', '-', 'g')), 40)) AS slug,
       CASE page_id % 4 WHEN 0 THEN 'https://www.ontario.ca/laws/statute/06r17' WHEN 1 THEN 'https://www.ontario.ca/laws/regulation/060516' WHEN 2 THEN 'https://www.ontario.ca/laws/regulation/060517' ELSE url END AS source
FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://x.org/2023onltb' || page_id || '/page' ELSE url END AS url FROM pages)""")
def source_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs and stable addresses of decisions and sources."""
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://x.org/2023onltb"), "page_id", F.lit("/page"))).otherwise(F.col("url"))
    act = F.element_at(F.array(*map(F.lit, ("Standard Form of Lease", "O. Reg. 516/06", "O. Reg. 517/06", "Act"))), (F.col("page_id") % 4 + 1).cast("int"))
    rows = tables.table(spark, sf_dir, "pages").select("page_id", url.alias("url"), act.alias("act"))
    return rows.select("page_id", cleaning.decision_slug(F.col("url")).alias("slug"), cleaning.source_url(F.col("act"), F.lit("1"), F.col("url")).alias("source"))


@query(r"""
WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderdate AS ts, o_totalprice AS p,
             [CAST(CAST(o_orderdate AS DATE) AS VARCHAR), CAST(year(o_orderdate) AS VARCHAR), '', 'soon'][1 + o_orderkey % 4] AS given, CASE WHEN o_orderkey % 3 = 0 THEN 'no 2015 ONLTB ' || o_orderkey ELSE 'no year' END AS cited,
             CASE WHEN o_orderkey % 2 = 0 THEN 'D:' || strftime(o_orderdate, '%Y%m%d') || '101112Z' WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE 'D:' || strftime(o_orderdate, '%Y%m%d') END AS stamp FROM orders),
i AS (SELECT *, p / 6.0 AS raw, pow(10.0, floor(log10(p / 6.0))) AS m FROM o),
t AS (SELECT *, m * CASE WHEN m >= raw THEN 1.0 WHEN 2 * m >= raw THEN 2.0 WHEN 2.5 * m >= raw THEN 2.5 WHEN 5 * m >= raw THEN 5.0 ELSE 10.0 END AS step FROM i)
SELECT k, CAST(d - INTERVAL 60 MONTH AS DATE) AS five_years, CAST(ts + INTERVAL 90 DAY AS DATE) AS expires,
       CASE WHEN regexp_matches(given, '^\d{4}-\d{2}-\d{2}$') THEN CAST(given AS DATE) WHEN regexp_matches(given, '^\d{4}$') THEN make_date(CAST(given AS BIGINT), 1, 1) WHEN k % 3 = 0 THEN DATE '2015-01-01' ELSE DATE '2020-01-01' END AS decided,
       CASE WHEN k % 4 < 2 THEN make_date(year(d), 1, 1) ELSE DATE '2020-01-01' END AS case_day,
       CASE WHEN k % 2 = 0 THEN strftime(ts, '%Y-%m-%dT10:11:12') WHEN k % 5 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%dT00:00:00') END AS stamped,
       CASE WHEN floor(p) % 3000 >= 1000 THEN printf('%.2fs', floor((floor(p) % 3000) / 10.0 + 0.5) / 100) ELSE CAST(CAST(floor(p) % 3000 AS BIGINT) AS VARCHAR) || 'ms' END AS label,
       step, 1 + len(list_filter(generate_series(1, 12), lambda x: x * step < p AND x * step / p * 100 <= 99)) AS ticks
FROM t""")
def date_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days read from what is known, spans with their labels and ticks."""
    k, d, p = F.col("o_orderkey"), F.to_date("o_orderdate"), F.col("o_totalprice")
    given = F.element_at(F.array(d.cast("string"), F.year(d).cast("string"), F.lit(""), F.lit("soon")), (k % 4 + 1).cast("int"))
    cited = F.when(k % 3 == 0, F.concat(F.lit("no 2015 ONLTB "), k)).otherwise("no year")
    short = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"))
    stamp = F.when(k % 2 == 0, F.concat(short, F.lit("101112Z"))).when(k % 5 == 0, "unknown").otherwise(short)
    ms = F.floor(p) % 3000
    return tables.table(spark, sf_dir, "orders").select(
        k.alias("k"),
        dates.five_years_before(d).alias("five_years"),
        F.to_date(dates.expires(F.col("o_orderdate"))).alias("expires"),
        dates.decision_day(given, cited).alias("decided"),
        dates.case_day(given).alias("case_day"),
        dates.pdf_moment(stamp).alias("stamped"),
        dates.duration_label(ms).alias("label"),
        dates.tick_interval(p).alias("step"),
        F.size(dates.ruler_ticks(p)).cast("long").alias("ticks"),
    )


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE l_linestatus END AS value, l_linenumber % 3 AS statutes, 2 + CAST(l_linenumber % 2 = 0 AS INTEGER) AS output_keys, l_linenumber % 4 AS unwrapped
FROM lineitem""")
def payload_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads in their new and their former shape, and their summaries."""
    n = F.col("l_linenumber")
    few = lambda m: F.slice(F.array(*map(F.lit, ("a", "b", "c"))), 1, (n % m).cast("int"))
    given = F.when(n % 2 == 0, F.to_json(F.struct(F.struct(F.col("l_returnflag").alias("v")).alias("new")))).otherwise(F.to_json(F.struct(F.col("l_linestatus").alias("v"))))
    asked = F.to_json(F.struct(F.lit("text").alias("raw_text"), few(3).alias("retrieved_statutes"), F.lit(1).alias("lease_id"), F.lit("x").alias("other")))
    answered = F.when(n % 2 == 0, F.to_json(F.struct(n.alias("risk_score"), few(3).alias("clauses"), F.lit("high").alias("severity"), F.lit("x").alias("note")))).otherwise(F.to_json(F.struct(n.alias("risk_score"), few(3).alias("clauses"), F.lit("x").alias("note"))))
    listed = F.when(n % 2 == 0, F.to_json(few(4))).otherwise(F.to_json(F.struct(few(4).alias("items"))))
    return tables.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        payloads.first_path(given, "$.new.v", "$.v").alias("value"),
        payloads.input_summary(asked)["retrieved_statutes_count"].cast("long").alias("statutes"),
        F.size(payloads.output_summary(answered)).alias("output_keys"),
        F.size(payloads.wrapped_array(listed, "items")).cast("long").alias("unwrapped"),
    )


_TYPES = (*reports.POINTS, "standard_boilerplate", "pets")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as clauses of ten types."""
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("l_partkey") % len(_TYPES) + 1).cast("int"))
    return _clauses(spark, sf_dir).withColumns({"clause_type": kind, "text": F.when(F.col("l_suppkey") % 11 > 0, "text").otherwise(" ")})


_TYPED_SQL = f"""
{CLAUSES_SQL},
typed AS (SELECT lease_id, seq, risk_score, l_suppkey, [{", ".join(f"'{t}'" for t in _TYPES)}][1 + l_partkey % {len(_TYPES)}] AS clause_type FROM clauses),
points AS (SELECT *, l_suppkey % 11 > 0 AND clause_type <> 'standard_boilerplate' AND risk_score >= 4 AS negotiable FROM typed),
ranked AS (SELECT *, CASE WHEN NOT negotiable THEN 'low' WHEN risk_score >= 8 THEN 'high' WHEN risk_score >= 6 THEN 'medium' ELSE 'low' END AS priority, negotiable AND risk_score >= 8 AS walk_away FROM points)"""


@query(f"""
WITH {_TYPED_SQL}
SELECT lease_id, seq, negotiable, priority, walk_away, CASE WHEN NOT negotiable THEN '' ELSE CASE clause_type {" ".join(f"WHEN '{k}' THEN '{p[0].replace("'", "''")}'" for k, p in reports.POINTS.items())}
  ELSE 'Request amendment of the ' || replace(clause_type, '_', ' ') || ' clause to align with Ontario RTA requirements.' END END AS ask FROM ranked""")
def negotiation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.negotiation_points(_typed(spark, sf_dir)).select("lease_id", "seq", "negotiable", "priority", "walk_away", "ask")


@query(f"""
WITH {_TYPED_SQL}
SELECT lease_id, seq, priority FROM (SELECT *, max(CAST(priority IN ('high', 'medium') AS INTEGER)) OVER (PARTITION BY lease_id) AS urgent FROM ranked) WHERE priority IN ('high', 'medium') OR urgent = 0""")
def default_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.shown_by_default(reports.negotiation_points(_typed(spark, sf_dir))).select("lease_id", "seq", "priority")


@query(f"""
WITH {_TYPED_SQL}
SELECT lease_id, string_agg(replace(clause_type, '_', ' '), ' and ' ORDER BY seq, clause_type) AS labels FROM ranked WHERE walk_away GROUP BY lease_id""")
def walk_away_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.walk_aways(reports.negotiation_points(_typed(spark, sf_dir)))


@query(f"""
WITH {_TYPED_SQL},
n AS (SELECT lease_id, row_number() OVER (PARTITION BY lease_id ORDER BY seq, clause_type) AS i, 'Clause ' || seq || ' — ' || clause_type || ': ask' AS line FROM ranked WHERE negotiable)
SELECT lease_id, md5('The following clauses require amendment:' || chr(10) || chr(10) || string_agg(i || '. ' || line, chr(10) ORDER BY i)) AS digest FROM n GROUP BY lease_id""")
def proposal_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = reports.negotiation_points(_typed(spark, sf_dir)).where("negotiable")
    asked = points.select("lease_id", "seq", F.col("seq").cast("string").alias("number"), F.col("clause_type").alias("heading"), F.lit("ask").alias("ask"))
    return reports.proposals(asked).select("lease_id", _md5(F.col("body")).alias("digest"))


_PLACES = ", ".join(f"CASE WHEN list_contains(types, '{t}') THEN {p} END" for p, t, _ in reports.PROTECTIONS)


@query(f"""
WITH {_TYPED_SQL},
l AS (SELECT lease_id, list(clause_type) AS types, lease_id % 4 > 0 AS supported FROM typed GROUP BY lease_id),
p AS (SELECT lease_id, supported, CASE WHEN supported THEN list_filter([{_PLACES}], lambda x: x IS NOT NULL) ELSE [] END AS present FROM l)
SELECT lease_id, array_to_string(present, ',') AS present, CASE WHEN supported THEN array_to_string(list_filter(generate_series(1, 13), lambda x: NOT list_contains(present, x)), ',') ELSE '' END AS missing,
       floor(len(present) / CAST(13 AS DOUBLE) * 100 + 0.5) / 100 AS coverage FROM p""")
def protections_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    leases = _typed(spark, sf_dir).groupBy("lease_id").agg(F.collect_set("clause_type").alias("types")).withColumn("supported", F.col("lease_id") % 4 > 0)
    return reports.protections(leases).select("lease_id", F.array_join("present", ",").alias("present"), F.array_join("missing", ",").alias("missing"), "coverage")


@query(f"""
WITH {_TYPED_SQL},
r AS (SELECT lease_id, count(*) AS n, count(*) FILTER (risk_score >= 6) AS red, count(*) FILTER (negotiable) AS neg, max(risk_score) AS top FROM ranked GROUP BY lease_id)
SELECT lease_id, md5('This lease in Ontario scores ' || CAST(top AS BIGINT) || '/10 overall risk — '
  || CASE WHEN top <= 3 THEN 'it appears to be relatively tenant-friendly with no major red flags' WHEN top <= 6 THEN 'it contains several provisions worth reviewing carefully' WHEN top <= 8 THEN 'it contains significant provisions that may restrict your rights or be difficult to enforce' ELSE 'it contains critical provisions that may directly contradict Ontario tenant protection law' END
  || ' across ' || n || ' analyzed clauses. '
  || CASE WHEN red > 0 OR lease_id % 3 > 0 THEN 'The analysis identified ' || concat_ws(' and ', CASE WHEN red > 0 THEN red || ' high-risk clause' || CASE WHEN red > 1 THEN 's' ELSE '' END || ' (red flag' || CASE WHEN red > 1 THEN 's' ELSE '' END || ')' END,
       CASE WHEN lease_id % 3 > 0 THEN (lease_id % 3) || ' internal contradiction' || CASE WHEN lease_id % 3 > 1 THEN 's' ELSE '' END || ' between clauses' END) || '.' ELSE 'No red flags or internal contradictions were detected.' END || ' '
  || CASE WHEN lease_id % 4 > 0 THEN (lease_id % 4) || ' required Ontario tenancy protection' || CASE WHEN lease_id % 4 > 1 THEN 's are' ELSE ' is' END || ' absent from this lease — though statutory protections still apply by law, their absence from the lease weakens your written record.' ELSE 'All required Ontario tenancy protections appear to be addressed in this lease.' END || ' '
  || CASE WHEN neg > 0 THEN neg || ' clause' || CASE WHEN neg > 1 THEN 's have been' ELSE ' has been' END || ' flagged for negotiation — review the negotiation points section before signing.' ELSE 'No clauses were identified as requiring negotiation based on the risk thresholds.' END) AS digest FROM r""")
def executive_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = reports.negotiation_points(_typed(spark, sf_dir))
    per = points.groupBy("lease_id").agg(F.count(F.lit(1)).alias("clauses"), F.count_if(F.col("risk_score") >= 6).alias("red_flags"), F.count_if("negotiable").alias("negotiable"), F.max("risk_score").cast("long").alias("overall"))
    per = per.withColumns({"jurisdiction": F.lit("Ontario"), "level": reports.risk_level(F.col("overall")), "contradictions": F.col("lease_id") % 3, "missing": F.col("lease_id") % 4})
    return reports.summary(per).select("lease_id", _md5(F.col("summary")).alias("digest"))


@query(f"""
WITH {_TYPED_SQL},
s AS (SELECT lease_id, l_suppkey AS source, max(risk_score) AS relevance FROM typed GROUP BY ALL),
a AS (SELECT lease_id, l_suppkey AS source, CAST(seq AS VARCHAR) AS name FROM typed WHERE seq % 2 = 0 UNION SELECT lease_id, l_suppkey, clause_type FROM typed WHERE seq % 3 = 0),
n AS (SELECT DISTINCT t.lease_id, t.seq, t.clause_type, a.source FROM typed t JOIN a ON a.lease_id = t.lease_id AND a.name IN (CAST(t.seq AS VARCHAR), t.clause_type)),
h AS (SELECT lease_id, seq, source, row_number() OVER (PARTITION BY lease_id, seq ORDER BY relevance DESC, source) AS place FROM (SELECT DISTINCT n.lease_id, n.seq, n.source, relevance FROM n JOIN s USING (lease_id, source))),
b AS (SELECT lease_id, source, row_number() OVER (PARTITION BY lease_id ORDER BY relevance DESC, source) AS place FROM s)
SELECT lease_id, seq, source, place FROM h WHERE place <= 3
UNION ALL SELECT t.lease_id, t.seq, b.source, b.place FROM typed t JOIN b USING (lease_id) WHERE b.place <= 3 AND NOT EXISTS (SELECT 1 FROM h WHERE h.lease_id = t.lease_id AND h.seq = t.seq)""")
def clause_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reports.by_lease(_typed(spark, sf_dir).select("lease_id", "seq", "clause_type", "risk_score", F.col("l_suppkey").alias("source")))
    by_place, by_type = F.when(F.col("seq") % 2 == 0, F.col("seq").cast("string")), F.when(F.col("seq") % 3 == 0, F.col("clause_type"))
    relevance = F.max("risk_score").over(Window.partitionBy("lease_id", "source"))
    return reports.clause_sources(c, c.select("lease_id", "source", relevance.alias("relevance"), F.array_compact(F.array(by_place, by_type)).alias("about")))


@query("""
SELECT count(*) AS every, count(*) FILTER (d AND p <= 3) AS low, count(*) FILTER (d AND p > 3 AND p <= 6) AS medium, count(*) FILTER (d AND p > 6 AND p <= 8) AS high, count(*) FILTER (d AND p > 8) AS critical
FROM (SELECT o_orderstatus = 'F' AS d, o_orderkey % 11 AS p FROM orders)""")
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "complete").otherwise("open").alias("status"), (F.col("o_orderkey") % 11).alias("score"))
    return reports.dashboard(rows)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth document as a question to those of its source."""
    return tables.table(spark, sf_dir, "documents").where("doc_id % 100 = 0 and text is not null").select(F.col("doc_id").alias("query_id"), F.col("source").alias("grp"), F.col("text").alias("asked"))


_KEYWORDS_SQL = f"""
w AS (SELECT doc_id AS query_id, source AS grp, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 3 AND NOT list_contains({_STOPS}, x)) AS w FROM documents WHERE doc_id % 100 = 0 AND text IS NOT NULL),
q AS (SELECT query_id, grp, list_filter(w, lambda x, i: list_position(w, x) = i)[1:5] AS words FROM w),
k AS (SELECT q.query_id, d.doc_id AS id, row_number() OVER (PARTITION BY q.query_id ORDER BY d.doc_id) AS rank FROM q JOIN documents d ON d.source = q.grp AND len(list_filter(q.words, lambda x: contains(lower(d.text), x))) > 0)"""


@query(f"""
WITH {_KEYWORDS_SQL},
f AS (SELECT doc_id - doc_id % 100 AS query_id, doc_id AS id, 0.9 - (doc_id % 100) / CAST(10 AS DOUBLE) AS score, doc_id % 100 + 1 AS rank FROM documents WHERE text IS NOT NULL AND doc_id % 100 <= (doc_id // 100) % 3 - 1),
n AS (SELECT q.query_id, count(f.id) AS n FROM q LEFT JOIN f USING (query_id) GROUP BY q.query_id),
u AS (SELECT f.query_id, id, score, false AS fallback, rank FROM f JOIN q USING (query_id)
      UNION ALL SELECT k.query_id, k.id, CAST(0.3 AS DOUBLE), true, k.rank FROM k JOIN n USING (query_id) WHERE n.n < 2 AND k.rank <= 5 AND NOT EXISTS (SELECT 1 FROM f WHERE f.query_id = k.query_id AND f.id = k.id))
SELECT query_id, id, score, fallback, rank FROM (SELECT query_id, id, score, fallback, row_number() OVER (PARTITION BY query_id ORDER BY fallback, rank) AS rank FROM u) WHERE rank <= 5""")
def keyword_topup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a query, of which there are none, one or two, with keyword hits where they are few."""
    asked, docs = _asked(spark, sf_dir), tables.table(spark, sf_dir, "documents").where("text is not null")
    place = F.col("doc_id") % 100
    found = docs.where(place <= F.expr("doc_id div 100") % 3 - 1).select((F.col("doc_id") - place).alias("query_id"), F.col("doc_id").alias("id"), (0.9 - place / 10.0).alias("score"), (place + 1).alias("rank"))
    found = found.join(asked.select("query_id"), "query_id", "left_semi")
    corpus = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("grp"), "text")
    return retrieval.topped_up(found, retrieval.keyword_hits(asked, corpus, 5), asked, 5).select("query_id", "id", "score", "fallback", "rank")


@query("""
SELECT vec_id AS query_id, CAST(CASE WHEN vec_id % 300 = 0 THEN 0.0 WHEN vec_id % 300 = 100 THEN 0.5 ELSE 0.8 END AS DOUBLE) AS confidence FROM embeddings WHERE vec_id % 100 = 0""")
def retrieval_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = tables.table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"))
    rows = asked.where("query_id % 300 > 0").select("query_id", F.explode(F.array(F.lit(0.6), F.lit(0.8))).alias("score"), (F.col("query_id") % 300 == 100).alias("fallback"))
    return retrieval.retrieval_confidence(rows, asked)


_COSINE = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))"


@query(f"""
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, b.label, round({_COSINE}, 6) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND DATE '2020-01-01' + CAST(b.vec_id % 1000 AS INTEGER) >= DATE '2021-01-01'),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM s WHERE cosine >= 0.1)
SELECT query_id, id, cosine, rank, label FROM r WHERE rank <= 3""")
def knn_date_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows since a day, with a wide column that joins after the ranking."""
    v = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.lit(0).alias("grp"), F.col("embedding").alias("vec"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("vec_id") % 1000).cast("int")).alias("day"))
    asked = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "grp", "vec")
    near = retrieval.nearest_since(asked, v, 3, 0.1, "2021-01-01")
    return retrieval.with_details(near, v, ["label"]).select("query_id", "id", "cosine", "rank", "label")


_PHRASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in retrieval.QUERY_PHRASES.items())


@query(f"""
WITH {_TYPED_SQL}
SELECT lease_id * 10 + seq AS query_id, list, CASE list WHEN 1 THEN CASE WHEN l_suppkey % 11 > 0 THEN 'text' ELSE ' ' END WHEN 2 THEN replace(clause_type, '_', ' ') || ' ' || replace(clause_type, '_', ' ') || ' tenant rights Ontario lease'
  ELSE CASE clause_type {_PHRASES} END END AS asked FROM typed, (SELECT unnest([1, 2, 3]) AS list)""")
def three_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _typed(spark, sf_dir).select((F.col("lease_id") * 10 + F.col("seq")).alias("query_id"), "clause_type", "text")
    return retrieval.built_queries(rows)


@query("""
WITH s AS (SELECT user_id AS trace, epoch_us(ts) // 1000 AS start_ms, CAST(floor(value * 10) AS BIGINT) AS duration_ms FROM events)
SELECT trace, min(start_ms) AS t0, greatest(max(start_ms + duration_ms) - min(start_ms), 1) AS span_ms, CAST(sum(duration_ms) AS BIGINT) AS total_ms, max(duration_ms) AS peak_ms FROM s GROUP BY trace""")
def trace_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("trace"), F.unix_millis("ts").alias("start_ms"), F.floor(F.col("value") * 10).alias("duration_ms"))
    return events.trace_extent(rows)


@query("""
WITH t AS (SELECT doc_id, lower(text || [' Landlord shall pay.', ' The application is granted', ' It is dismissed.', ''][1 + doc_id % 4]) AS t, ['T', 'L', 'X'][1 + doc_id % 3] AS side FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, regexp_matches(t, 'landlord\\s+shall\\s+pay|landlord\\s+must\\s+pay|ordered\\s+to\\s+pay\\s+the\\s+tenant') AS l, regexp_matches(t, 'tenant\\s+shall\\s+pay|tenant\\s+must\\s+pay|ordered\\s+to\\s+pay\\s+the\\s+landlord') AS n,
        regexp_matches(t, 'is\\s+granted\\b') AS g, regexp_matches(t, 'is\\s+dismissed\\b') AS d FROM t)
SELECT doc_id, CASE WHEN l AND NOT n THEN 'tenant_favour' WHEN n AND NOT l THEN 'landlord_favour'
  WHEN side = 'T' THEN CASE WHEN g THEN 'tenant_favour' WHEN d THEN 'landlord_favour' ELSE 'mixed' END
  WHEN side = 'L' THEN CASE WHEN g THEN 'landlord_favour' WHEN d THEN 'tenant_favour' ELSE 'mixed' END ELSE 'mixed' END AS outcome FROM f""")
def outcome_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))
    ends = pick((" Landlord shall pay.", " The application is granted", " It is dismissed.", ""))
    rows = tables.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat("text", ends).alias("text"), pick(("T", "L", "X")).alias("case_number"))
    return screening.outcomes(rows).select("doc_id", "outcome")


@query("""
SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM events""")
def run_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's number within its user's run."""
    own = Window.partitionBy("user_id")
    rows = tables.table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return rows.withColumns({"seq": F.row_number().over(own.orderBy("ts", "event_id")), "n": F.count(F.lit(1)).over(own)})


_LEASES = ("Full address of the rental unit:\n12 King Street W, Unit 4B, Toronto, ON M5V 2T6\n", "Premises: 9 Elm Ave, Ottawa, Ontario K1A 0B1\n", "known as 77 Long Road, Barrie, ON\n", "\n 5 Short Lane, Guelph, Ontario N1G2W1\n", "")
_FOUND = ", ".join(f"nullif({_TRIM.format(f"regexp_extract(t, '{p}', 1)")}, '')" for p in intake.ADDRESSES)


def _noise_sql(x: str) -> str:
    for pattern, by in intake._NOISE:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


@query(f"""
WITH d AS (SELECT doc_id, replace(regexp_replace([{", ".join("'" + x.replace(chr(10), "' || chr(10) || '") + "'" for x in _LEASES)}][1 + doc_id % 5] || text, '[ \\t]+', ' ', 'g'), chr(13) || chr(10), chr(10)) AS t FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, coalesce({_FOUND}, nullif({_TRIM.format(f"regexp_extract(left(t, 3000), '{intake.STREET.replace(chr(39), chr(39) * 2)}', 1)")}, ''), '') AS raw FROM d)
SELECT doc_id, left({_TRIM.format(_noise_sql("raw"))}, 120) AS address,
       CASE WHEN regexp_matches(raw, '{intake.UNIT}') THEN string_split_regex(regexp_extract(raw, '{intake.UNIT}', 0), '\\s+')[1] || ' ' || regexp_extract(raw, '{intake.UNIT}', 2) ELSE '' END AS unit,
       {_TRIM.format(f"regexp_extract(raw, '{intake.CITY}', 1)")} AS city, regexp_replace(upper(regexp_extract(raw, '{intake.POSTAL_CODE}', 1)), '^(.{{3}})[ -]?(.{{3}})$', '\\1 \\2') AS postal_code FROM r""")
def address_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of documents that start as leases do."""
    ahead = F.element_at(F.array(*map(F.lit, _LEASES)), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = tables.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(ahead, "text").alias("text"))
    return intake.addresses(rows)


@query("""
WITH p AS (SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)\\b.*?</(?:script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(?:h[1-6]|p)\\b[^>]*>.*?</(?:h[1-6]|p)>') AS b FROM pages),
x AS (SELECT page_id, unnest(b) AS block, generate_subscripts(b, 1) AS n FROM p),
t AS (SELECT page_id, n, regexp_matches(block, '(?i)^<h') AS head,
        regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(block, '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM x),
s AS (SELECT *, sum(CAST(head AS INTEGER)) OVER w AS section, last_value(CASE WHEN head THEN text END IGNORE NULLS) OVER w AS heading FROM t WHERE text <> '' WINDOW w AS (PARTITION BY page_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT page_id, CAST(section AS INTEGER) AS section, heading, md5(coalesce(string_agg(text, chr(10) ORDER BY n) FILTER (NOT head), '')) AS digest FROM s GROUP BY page_id, section, heading""")
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intake.html_sections(tables.table(spark, sf_dir, "pages"))
    return found.select("page_id", "section", "heading", F.md5("text").alias("digest"))


_SECTION_SQL = " ".join(f"WHEN n BETWEEN {a} AND {b} THEN '{t}'" for a, b, t in intake.SECTION_TYPES)
_DECISION_SQL = ", ".join(f"CASE WHEN {' OR '.join(f"contains(lower(text), '{w.lower()}')" for w in words)} THEN '{name}' END" for name, words in intake.DECISION_TYPES)


@query(f"""
WITH d AS (SELECT doc_id, doc_id % 130 AS n, text || [' The deposit.', ' Quiet enjoyment; N12.', ''][1 + doc_id % 3] AS text FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, list_filter([{_DECISION_SQL}], lambda x: x IS NOT NULL) AS f FROM d)
SELECT doc_id, CASE {_SECTION_SQL} END AS section_type, CASE WHEN len(f) > 0 THEN array_to_string(f, ',') ELSE 'unknown' END AS types, length({_TRIM.format("text")}) >= 50 AS long_enough FROM f""")
def decision_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause types of sections and decisions, and whether a text says enough."""
    ends = F.element_at(F.array(*map(F.lit, (" The deposit.", " Quiet enjoyment; N12.", ""))), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = tables.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat("text", ends).alias("text"))
    number = F.concat(F.col("doc_id") % 130, F.lit("(2)"))
    return rows.select("doc_id", intake.section_type(number).alias("section_type"), F.array_join(intake.decision_types(F.col("text")), ",").alias("types"), intake.long_enough(F.col("text")).alias("long_enough"))


@query("""
WITH d AS (SELECT doc_id // 10 AS file, coalesce(text, '') AS text, doc_id AS page FROM documents),
j AS (SELECT file, string_agg(text, chr(10) ORDER BY page) AS t, avg(length(text)) AS mean FROM d GROUP BY file)
SELECT file, CAST(CASE WHEN regexp_replace(t, '^\\s+|\\s+$', '', 'g') = '' THEN 0 ELSE floor(greatest(0, least(1, 1 - length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g')) / CAST(length(t) AS DOUBLE) * 0.8 - CASE WHEN mean >= 50 THEN 0 ELSE 0.3 END)) * 1e6 + 0.5) END AS DOUBLE) AS confidence FROM j""")
def text_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.table(spark, sf_dir, "documents").select(F.expr("doc_id div 10").alias("file"), F.col("doc_id").alias("page"), "text")
    return intake.text_confidence(pages).select("file", F.floor(F.col("confidence") * 1e6 + 0.5).cast("double").alias("confidence"))


@query("""
WITH r AS (SELECT event_id, epoch_us(ts) AS us, user_id % 4 = 0 AS guest, CASE WHEN user_id % 4 = 0 THEN 'g' ELSE 'u' END || user_id % 40 AS who, user_id % 30 AS lease FROM events),
c AS (SELECT *, count(*) OVER (PARTITION BY who ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY who, us ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS day,
        count(*) OVER (PARTITION BY who ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY who, us ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hour,
        count(*) OVER (PARTITION BY lease ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY lease, us ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS of_lease FROM r),
l AS (SELECT *, CASE WHEN guest THEN 10 ELSE 50 END AS d, CASE WHEN guest THEN 5 ELSE 15 END AS h, CASE WHEN guest THEN 'ip' ELSE 'user' END AS w FROM c),
x AS (SELECT *, CASE WHEN day >= d THEN 'daily_' || w || '_limit' WHEN hour >= h THEN 'hourly_' || w || '_limit' WHEN of_lease >= 30 THEN 'per_lease_limit' END AS reason FROM l)
SELECT event_id, reason, reason IS NULL AS allowed, CASE WHEN reason IS NULL THEN greatest(0, least(d - day - 1, h - hour - 1, 30 - of_lease - 1)) ELSE 0 END AS remaining FROM x""")
def chat_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of few users and guests about few leases, so that every limit is met."""
    who = F.col("user_id") % 40
    rows = tables.table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("user_id") % 4 > 0, who.cast("string")).alias("user_id"), who.cast("string").alias("ip"), (F.col("user_id") % 30).alias("lease_id"))
    return events.chat_quota(rows).select("event_id", "reason", "allowed", "remaining")


@query(f"""
WITH r AS (SELECT event_id, epoch_us(ts) AS us, user_id % 3 AS key, [{", ".join(f"'{k}'" for k in events.ROUTE_LIMITS)}, 'other'][1 + user_id % 14] AS route FROM events),
c AS (SELECT *, count(*) OVER (PARTITION BY key, route ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY key, route, us ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM r)
SELECT event_id, route, coalesce(n < CASE route {" ".join(f"WHEN '{k}' THEN {v}" for k, v in events.ROUTE_LIMITS.items())} END, true) AS allowed FROM c""")
def route_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = F.element_at(F.array(*map(F.lit, (*events.ROUTE_LIMITS, "other"))), (F.col("user_id") % 14 + 1).cast("int"))
    rows = tables.table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 3).alias("key"), route.alias("route"))
    return events.fail_open(events.route_quota(rows)).select("event_id", "route", "allowed")
