"""Queries of reports, of how they are shown, and of letters; orders stand for leases, line items for clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.operators import alignment, explanations, reporting, reports
from clausegrid.plans.queries import CLAUSES_SQL, _clauses, _level, query
from clausegrid.sources import tables

_KINDS = ("entry_rights", "rent_increase", "pets", "security_deposit", "standard_boilerplate")
_TONES = ("cooperative", "assertive", "formal", "other")


def _text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _case(x: str, values: dict[str, str], default: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {_text(v)}" for k, v in values.items()) + f" ELSE {default} END"


def _pick(values: tuple[str, ...], n) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses with types, numbers and texts."""
    rows = _clauses(spark, sf_dir)
    kind = _pick(_KINDS, F.col("l_partkey"))
    return rows.withColumns({"clause_type": kind, "number": F.col("l_partkey").cast("string"), "text": F.concat(F.lit("clause "), F.repeat(F.lit("x"), (F.col("l_partkey") % 200).cast("int")))})


_TYPED_SQL = f"""{CLAUSES_SQL},
typed AS (SELECT * REPLACE ([{", ".join(f"'{k}'" for k in _KINDS)}][1 + l_partkey % 5] AS clause_type), CAST(l_partkey AS VARCHAR) AS number, 'clause ' || repeat('x', l_partkey % 200) AS text FROM clauses)"""
_COUNTER_SQL = _case("clause_type", reporting.COUNTER_LANGUAGE, f"{_text(reporting.OTHER_LANGUAGE[0])} || replace(clause_type, '_', ' ') || {_text(reporting.OTHER_LANGUAGE[1])}")
_COUNTER_SQL = f"({_COUNTER_SQL}) || CASE WHEN clause_type = 'entry_rights' AND length(text) > 100 THEN {_text(reporting.REST_UNCHANGED)} ELSE '' END"


@query(f"WITH {_TYPED_SQL} SELECT lease_id, seq, clause_type, l_partkey, md5({_COUNTER_SQL}) AS digest FROM typed")
def counter_wordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = reporting.counter_language(F.col("clause_type"), F.col("text"))
    return _typed(spark, sf_dir).select("lease_id", "seq", "clause_type", "l_partkey", F.md5(said.cast("binary")).alias("digest"))


@query(f"""
WITH {_TYPED_SQL},
l AS (SELECT o_orderkey AS lease_id, list_filter([10, 11, 12], lambda x: (o_orderkey + x) % 4 = 0) AS missing FROM orders),
n AS (SELECT *, clause_type <> 'standard_boilerplate' AND risk_score >= 4 AS negotiable FROM typed),
p AS (
  SELECT lease_id, count(*) AS clauses, string_agg(seq || ':' || CAST(CAST(risk_score AS INTEGER) AS VARCHAR), ',' ORDER BY risk_score DESC, seq, number) FILTER (risk_score >= 6) AS flags,
         count(*) FILTER (negotiable) AS negotiable, count(*) FILTER (risk_score >= 6) AS n_flags, count(*) FILTER (void) AS n_void, max(risk_score) AS top,
         floor(sum(risk_score * CASE WHEN heavy THEN 1.5 ELSE 1.0 END) / sum(CASE WHEN heavy THEN 1.5 ELSE 1.0 END) * 10 + CAST(0.5 AS DOUBLE)) / 10 AS base,
         count(*) FILTER (risk_score > 8) AS critical FROM n GROUP BY lease_id),
s AS (SELECT lease_id, string_agg(key, ',' ORDER BY seq, key) AS sources FROM (SELECT lease_id, 'statute:' || (l_suppkey % 3) AS key, min(seq) AS seq FROM typed GROUP BY ALL) GROUP BY lease_id),
x AS (SELECT lease_id, count(*) AS clashes FROM typed WHERE l_suppkey % 2 = 0 AND l_partkey % 3 = 0 GROUP BY lease_id),
o AS (SELECT p.*, greatest(CASE WHEN top >= 8 THEN floor((0.6 * base + 0.4 * top) * 10 + CAST(0.5 AS DOUBLE)) / 10 ELSE base END, CASE WHEN n_void >= 4 THEN 9.5 WHEN n_void = 3 THEN 8.5 WHEN n_void = 2 THEN 7.5 ELSE 0 END) AS overall FROM p)
SELECT l.lease_id, coalesce(overall, 0.0) AS overall, CASE WHEN overall IS NULL THEN 'low' ELSE {_level("overall")} END AS level, coalesce(clauses, 0) AS clauses, coalesce(flags, '') AS flags,
       coalesce(negotiable, 0) AS points, len(missing) AS missing, coalesce(clashes, 0) AS contradictions, coalesce(sources, '') AS sources, coalesce(critical, 0) AS critical
FROM l LEFT JOIN o USING (lease_id) LEFT JOIN s USING (lease_id) LEFT JOIN x USING (lease_id)""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of every order, also of those without line items."""
    clauses = _typed(spark, sf_dir)
    leases = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lease_id"), F.lit("Ontario, Canada").alias("jurisdiction"), F.filter(F.array(*map(F.lit, (10, 11, 12))), lambda x: (F.col("o_orderkey") + x) % 4 == 0).alias("missing"))
    clashes = clauses.select("lease_id", F.col("seq").alias("id_a"), (F.col("seq") + 1).alias("id_b"), F.lit("generic").alias("kind"), F.lit("medium").alias("severity"), ((F.col("l_suppkey") % 2 == 0) & (F.col("l_partkey") % 3 == 0)).alias("has_contradiction"))
    sources = clauses.select("lease_id", "seq", F.concat(F.lit("statute:"), F.col("l_suppkey") % 3).alias("key"), F.lit("Act s.1").alias("reference"), F.lit("u").alias("url"))
    rows = reporting.report_rows(leases, clauses, clashes, sources)
    flags = F.array_join(F.transform("red_flags", lambda x: F.concat(x["seq"].cast("string"), F.lit(":"), x["risk_score"].cast("int").cast("string"))), ",")
    return rows.select(
        "lease_id", "overall", "level", F.col("clauses").cast("long"), flags.alias("flags"), F.size("points").cast("long").alias("points"), F.size("missing").cast("long").alias("missing"),
        F.size("contradictions").cast("long").alias("contradictions"), F.array_join(F.transform("sources", lambda x: x["key"]), ",").alias("sources"), F.coalesce("levels.critical", F.lit(0)).cast("long").alias("critical"),
    )


_HEADING_SQL = "upper(left(clause_type, 1)) || substr(replace(clause_type, '_', ' '), 2)"
_L = reporting.LETTER_LINES
_I = reporting.ADDENDUM_INTRO


@query(f"""
WITH {_TYPED_SQL},
i AS (SELECT lease_id, seq, number, {_HEADING_SQL} AS heading, 'Amend ' || clause_type AS ask, CASE WHEN l_suppkey % 2 = 0 THEN 's.' || (l_suppkey % 40) END AS section, 'It is law.' AS argument, CASE WHEN l_partkey % 2 = 0 THEN ' own words ' ELSE ' ' END AS counter FROM typed WHERE risk_score >= 6),
n AS (SELECT *, row_number() OVER (PARTITION BY lease_id ORDER BY seq, 'Clause ' || number || ' — ' || heading || ': ' || ask || coalesce(' (' || section || ')', '')) AS n FROM i),
t AS (SELECT lease_id, string_agg(n || '. Clause ' || number || ' — ' || heading || ': ' || ask || coalesce(' (' || section || ')', ''), chr(10) ORDER BY n) AS listed,
        string_agg('Regarding Clause ' || number || ' (' || heading || '): ' || argument, chr(10) || chr(10) ORDER BY n) AS argued,
        string_agg(CASE WHEN trim(counter) = '' THEN {_text(_L[4])} || ask ELSE trim(counter) END, '|' ORDER BY n) AS addendum FROM n GROUP BY lease_id),
l AS (SELECT o_orderkey AS lease_id, 'Tenant ' || o_custkey AS tenant, 'Owner ' || (o_custkey % 9) AS landlord, (o_custkey % 90) || ' King St' AS address, [{", ".join(f"'{x}'" for x in _TONES)}][1 + o_custkey % 4] AS tone FROM orders),
x AS (SELECT l.*, listed, argued, addendum, CASE WHEN tone = 'other' THEN 'formal' ELSE tone END AS k FROM l JOIN t USING (lease_id))
SELECT lease_id, {_text(_L[0])} || address AS subject, addendum,
       md5('Dear ' || landlord || ',' || chr(10) || chr(10) || {_text(_L[2])} || address || chr(10) || chr(10) || {_case("k", reporting.LETTER_OPENINGS, "''")} || chr(10) || chr(10) || {_text(_L[3])} || chr(10) || chr(10) || listed || chr(10) || chr(10)
           || CASE WHEN k = 'assertive' THEN argued || chr(10) || chr(10) ELSE '' END || {_case("k", reporting.LETTER_CLOSINGS, "''")} || ',' || chr(10) || tenant) AS body,
       md5({_text(_I[0])} || landlord || {_text(_I[1])} || tenant || {_text(_I[2])} || address || {_text(_I[3])}) AS intro FROM x""")
def proposal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A letter for every order with red flags, in the tone of its customer."""
    clauses = _typed(spark, sf_dir).where("risk_score >= 6")
    heading = F.concat(F.upper(F.substring("clause_type", 1, 1)), F.substring(F.regexp_replace("clause_type", "_", " "), 2, 100))
    items = clauses.select(
        "lease_id", "seq", "number", heading.alias("heading"), F.concat(F.lit("Amend "), "clause_type").alias("ask"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("s."), F.col("l_suppkey") % 40)).alias("section"),
        F.lit("It is law.").alias("argument"), F.when(F.col("l_partkey") % 2 == 0, " own words ").otherwise(" ").alias("counter"),
    )
    who = F.col("o_custkey")
    leases = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lease_id"), F.concat(F.lit("Tenant "), who).alias("tenant"), F.concat(F.lit("Owner "), who % 9).alias("landlord"), F.concat(who % 90, F.lit(" King St")).alias("address"), _pick(_TONES, who).alias("tone"))
    found = reporting.letters(leases, items)
    digest = lambda c: F.md5(F.col(c).cast("binary"))
    return found.select("lease_id", "subject", F.array_join(F.transform("addendum", lambda x: x["text"]), "|").alias("addendum"), digest("body").alias("body"), digest("addendum_intro").alias("intro"))


_CLASHES = ("entry_rights_vs_quiet_enjoyment", "generic", "", "renewal_vs_")


@query(f"""
WITH c AS (SELECT o_orderkey AS id, o_custkey AS lease_id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus || ' heading' END AS heading, CAST(o_orderkey % 50 AS VARCHAR) AS number FROM orders),
k AS (SELECT o_custkey AS lease_id, o_orderkey AS n, o_orderkey AS id_a, o_orderkey + 1 AS id_b, nullif([{", ".join(f"'{x}'" for x in _CLASHES)}][1 + o_orderkey % 4], '') AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 'high' END AS severity FROM orders),
t AS (SELECT k.*, a.id IS NOT NULL AS has_a, coalesce(nullif(a.heading, ''), 'Clause ' || a.number) AS la, coalesce(nullif(b.heading, ''), 'Clause ' || b.number) AS lb FROM k LEFT JOIN c a ON a.lease_id = k.lease_id AND a.id = k.id_a LEFT JOIN c b ON b.lease_id = k.lease_id AND b.id = k.id_b)
SELECT lease_id, n, la AS label_a, coalesce(lb, CASE kind WHEN 'entry_rights_vs_quiet_enjoyment' THEN 'Quiet Enjoyment' WHEN 'renewal_vs_' THEN '' ELSE 'Clause B' END) AS label_b, coalesce(kind, 'direct_conflict') AS kind, coalesce(severity, 'medium') AS severity FROM t""")
def contradiction_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as clauses; each conflicts with the next number, which seldom is the same customer's."""
    o = tables.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    clauses = o.select(key.alias("id"), F.col("o_custkey").alias("lease_id"), F.when(key % 3 == 0, "").otherwise(F.concat("o_orderstatus", F.lit(" heading"))).alias("heading"), (key % 50).cast("string").alias("number"))
    pairs = o.select(F.col("o_custkey").alias("lease_id"), key.alias("n"), key.alias("id_a"), (key + 1).alias("id_b"), F.nullif(_pick(_CLASHES, key), F.lit("")).alias("kind"), F.when(key % 2 == 0, "high").alias("severity"))
    return reporting.shown_contradictions(pairs, clauses)


@query("""
SELECT l_orderkey AS lease_id, l_linenumber AS seq, l_partkey,
       least(100.0, greatest(0.0, (s - CASE level WHEN 'low' THEN 0 WHEN 'medium' THEN 3 WHEN 'high' THEN 5.5 ELSE 8 END) / CASE level WHEN 'low' THEN 3 WHEN 'medium' THEN 2.5 WHEN 'high' THEN 2.5 ELSE CAST(2 AS DOUBLE) END * 100)) AS pct
FROM (SELECT *, round(l_discount * 100, 0) AS s, ['low', 'medium', 'high', 'critical', 'none'][1 + l_partkey % 5] AS level FROM lineitem)""")
def band_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = _pick(("low", "medium", "high", "critical", "none"), F.col("l_partkey"))
    rows = tables.table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("lease_id"), F.col("l_linenumber").alias("seq"), "l_partkey", reporting.band_position(F.round(F.col("l_discount") * 100, 0), level).alias("pct"))


@query("""
WITH s AS (SELECT user_id, event_id, CASE WHEN event_id % 11 > 0 THEN CAST(floor(abs(value) * 1000) AS BIGINT) END AS ms FROM events),
t AS (SELECT user_id, sum(ms) AS total FROM s GROUP BY user_id)
SELECT event_id, least(1200.0, greatest(80.0, greatest(coalesce(ms, 0), 100) / CAST(greatest(total, 1) AS DOUBLE) * 15000)) AS delay_ms FROM s JOIN t USING (user_id)""")
def replay_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.when(F.col("event_id") % 11 > 0, F.floor(F.abs("value") * 1000).cast("long"))
    steps = tables.table(spark, sf_dir, "events").select("user_id", "event_id", ms.alias("ms"))
    total = steps.groupBy("user_id").agg(F.sum("ms").alias("total"))
    return steps.join(total, "user_id").select("event_id", reporting.replay_delay(F.col("ms"), F.col("total")).alias("delay_ms"))


@query("""
WITH p AS (SELECT ps.l_orderkey AS clause_id, ps.l_linenumber AS n, 'ask ' || ps.l_partkey AS ask, CASE WHEN ps.l_partkey % 3 = 0 THEN NULL ELSE 'counter ' || ps.l_partkey END AS counter FROM lineitem ps WHERE l_quantity >= 40),
f AS (SELECT *, row_number() OVER (PARTITION BY clause_id ORDER BY n, ask, counter NULLS FIRST) AS k FROM p)
SELECT o_orderkey AS clause_id, coalesce(ask, '') AS ask, coalesce(counter, '') AS counter FROM orders LEFT JOIN f ON f.clause_id = o_orderkey AND k = 1""")
def clause_first_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as clauses, their large line items as points, of which the first counts."""
    part = F.col("l_partkey")
    points = tables.table(spark, sf_dir, "lineitem").where("l_quantity >= 40").select(F.col("l_orderkey").alias("clause_id"), F.col("l_linenumber").alias("n"), F.concat(F.lit("ask "), part).alias("ask"), F.when(part % 3 != 0, F.concat(F.lit("counter "), part)).alias("counter"), F.lit("").alias("argument"))
    clauses = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clause_id"))
    return reporting.with_points(clauses, points).select("clause_id", "ask", "counter")


@query("""
WITH m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN ['entry_rights', 'quiet_enjoyment'][1 + p_partkey % 2] END AS clause_type, ['critical', 'high', 'important', 'low', NULL][1 + p_partkey % 5] AS severity FROM part)
SELECT id, CASE clause_type WHEN 'entry_rights' THEN 'Entry Rights' WHEN 'quiet_enjoyment' THEN 'Quiet Enjoyment' ELSE 'Own Name' END AS name,
       CASE WHEN severity = 'critical' THEN 'critical' WHEN severity IN ('high', 'important') THEN 'important' ELSE 'minor' END AS shown_severity,
       'Include a clause addressing ' || coalesce(replace(clause_type, '_', ' '), 'this protection') || '.' AS suggested,
       CASE CASE WHEN severity = 'critical' THEN 'critical' WHEN severity IN ('high', 'important') THEN 'important' ELSE 'minor' END WHEN 'critical' THEN 0 WHEN 'important' THEN 1 ELSE 2 END AS severity_rank FROM m""")
def missing_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    rows = tables.table(spark, sf_dir, "part").select(
        key.alias("id"), F.when(key % 3 > 0, _pick(("entry_rights", "quiet_enjoyment"), key)).alias("clause_type"), F.lit("own name").alias("protection_name"),
        F.element_at(F.array(*map(F.lit, ("critical", "high", "important", "low", None))), (key % 5 + 1).cast("int")).alias("severity"), F.lit(None).cast("string").alias("suggested_addition"),
    )
    return reporting.shown_missing(rows).select("id", "name", "shown_severity", "suggested", reports.severity_rank(F.col("shown_severity")).alias("severity_rank"))


@query("""
SELECT l_orderkey AS lease_id, number, rank() OVER (PARTITION BY l_orderkey ORDER BY number, l_linenumber, l_suppkey) AS by_text,
       rank() OVER (PARTITION BY l_orderkey ORDER BY CAST(regexp_extract(number, '^(\\d+)', 1) AS INTEGER), number, l_linenumber, l_suppkey) AS by_number, l_linenumber AS seq, l_suppkey
FROM (SELECT *, (l_partkey % 14) || '.' || (l_suppkey % 3) AS number FROM lineitem)""")
def clause_number_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause numbers in order of their signs, in which 10 comes before 2, and of their leading numbers."""
    from pyspark.sql.window import Window

    number = F.concat(F.col("l_partkey") % 14, F.lit("."), F.col("l_suppkey") % 3)
    rows = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("lease_id"), number.alias("number"), F.col("l_linenumber").alias("seq"), "l_suppkey")
    place = lambda *by: F.rank().over(Window.partitionBy("lease_id").orderBy(*by, "number", "seq", "l_suppkey")).cast("long")
    return rows.withColumns({"by_text": place(), "by_number": place(reports.leading_number(F.col("number")))})


_VIOLATED = ("pet_fines", "guest_surcharge", "odd_violation")


@query(f"""
WITH c AS (SELECT *, round(l_discount * 100, 0) AS s, l_partkey % 3 > 0 AS law FROM lineitem),
x AS (SELECT *, CASE l_suppkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['{_VIOLATED[0]}'] WHEN 2 THEN ['{_VIOLATED[2]}', '{_VIOLATED[1]}'] ELSE ['{_VIOLATED[2]}'] END AS v, l_tax * 10 >= 0.5 AS rel FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  'This clause scores ' || CAST(s AS BIGINT) || '/10 risk' || CASE WHEN s <= 3 THEN {_text(explanations.MEANINGS[0][1])} WHEN s <= 6 THEN {_text(explanations.MEANINGS[1][1])} WHEN s <= 8 THEN {_text(explanations.MEANINGS[2][1])} ELSE {_text(explanations.MEANINGS[3][1])} END || CASE WHEN law THEN '' ELSE {_text(explanations.NO_STATUTES)} END AS explanation,
  CASE l_suppkey % 4 WHEN 1 THEN md5({_text(explanations.TEMPLATES[_VIOLATED[0]])}) WHEN 2 THEN md5({_text(explanations.TEMPLATES[_VIOLATED[1]])}) END AS suggested,
  CASE WHEN len(v) = 0 AND law AND NOT rel THEN 'Clause assessed on language patterns. Score: ' || CAST(s AS BIGINT) || '/10.'
       ELSE concat_ws('. ', CASE WHEN len(v) > 0 THEN 'Statutory violations found: ' || replace(array_to_string(v, '; '), '_', ' ') END,
                      CASE WHEN law AND rel THEN 'Assessed against: ' || CASE WHEN l_partkey % 2 = 0 THEN 'Form — Terms' ELSE 'RTA s.' || (l_partkey % 90) END WHEN NOT law THEN {_text(explanations.NO_STATUTES_REASON)} END) END AS reasons
FROM x""")
def risk_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored clauses with violations and statutes of changing relevance."""
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    none = F.array().cast("array<string>")
    violations = F.when(supplier % 4 == 0, none).when(supplier % 4 == 1, F.array(F.lit(_VIOLATED[0]))).when(supplier % 4 == 2, F.array(F.lit(_VIOLATED[2]), F.lit(_VIOLATED[1]))).otherwise(F.array(F.lit(_VIOLATED[2])))
    form = part % 2 == 0
    statute = F.struct(F.when(form, "Form").otherwise("RTA").alias("act"), F.when(form, "form_15_terms").otherwise((part % 90).cast("string")).alias("section"), F.when(form, "Terms").alias("title"), (F.col("l_tax") * 10).alias("relevance"))
    rows = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("plain text").alias("text"), F.round(F.col("l_discount") * 100, 0).alias("risk_score"), violations.alias("violations"), F.filter(F.array(statute), lambda s: part % 3 > 0).alias("statutes"))
    found = explanations.explained(rows)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "explanation", F.md5(F.col("suggested").cast("binary")).alias("suggested"), "reasons")


@query("""
WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'complete' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 7 > 0 THEN floor(o_totalprice / 50000) END AS score,
             CASE WHEN o_orderkey % 5 = 0 THEN 'Title ' || o_orderkey END AS display_title, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey || ' King St' END AS address, CASE WHEN o_orderkey % 4 = 0 THEN 'Toronto' END AS city, 'a/b/lease.v' || (o_orderkey % 9) || '.pdf' AS file_path FROM orders)
SELECT id, coalesce(display_title, address, 'lease.v' || (id % 9)) AS title, coalesce(city, 'lease.v' || (id % 9) || '.pdf') AS subtitle, status = 'complete' AND score IS NOT NULL AND score > 6 AS attention FROM c""")
def lease_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    leases = tables.table(spark, sf_dir, "orders").select(
        key.alias("id"), F.when(F.col("o_custkey") % 2 == 0, "complete").otherwise("pending").alias("status"), F.when(key % 7 > 0, F.floor(F.col("o_totalprice") / 50000)).alias("score"),
        F.when(key % 5 == 0, F.concat(F.lit("Title "), key)).alias("display_title"), F.when(key % 3 == 0, F.concat(key, F.lit(" King St"))).alias("address"), F.when(key % 4 == 0, "Toronto").alias("city"), F.concat(F.lit("a/b/lease.v"), key % 9, F.lit(".pdf")).alias("file_path"),
    )
    return reporting.cards(leases).select("id", "title", "subtitle", "attention")


@query(f"""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 6 = 0 THEN 'synthetic-' || l_linenumber WHEN l_partkey % 6 = 1 THEN NULL ELSE CAST(l_linenumber AS VARCHAR) END AS number, CASE WHEN l_suppkey % 3 > 0 THEN round(l_discount * 100, 0) END AS s, CASE WHEN l_suppkey % 5 = 0 THEN 'own words' ELSE '' END AS own, 'RTA S.' || (l_partkey % 150) AS section FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(number, '') AS number, coalesce(s, 0.0) AS risk_score, coalesce(CASE WHEN s > 5 THEN 'high' END, 'low') AS risk_level,
  md5(CASE WHEN own <> '' THEN own ELSE CASE {" ".join(f"WHEN contains(lower(section), '{k}') THEN {_text(alignment.COMPLIANT[k])}" for k in sorted(alignment.COMPLIANT, key=len, reverse=True))} END END) AS compliant
FROM c WHERE coalesce(number, '') NOT LIKE 'synthetic%'""")
def clauses_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as clauses with gaps, of which those that were numbered for want of a number are not shown."""
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    score = F.when(supplier % 3 > 0, F.round(F.col("l_discount") * 100, 0))
    rows = tables.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(part % 6 == 0, F.concat(F.lit("synthetic-"), "l_linenumber")).when(part % 6 != 1, F.col("l_linenumber").cast("string")).alias("number"), F.lit(None).cast("string").alias("heading"),
        score.alias("risk_score"), F.when(score > 5, "high").alias("risk_level"), F.when(supplier % 5 == 0, "own words").otherwise("").alias("suggested"), F.array(F.concat(F.lit("RTA S."), part % 150)).alias("sections"),
    )
    found = reporting.shown_clauses(rows)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "number", "risk_score", "risk_level", F.md5(F.col("compliant").cast("binary")).alias("compliant"))
