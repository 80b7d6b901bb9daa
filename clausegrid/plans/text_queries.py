"""Further queries of the catalogue: texts, ranked lists, and rules over lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.operators import documents, parsing, portfolio, reports, retrieval, rules, screening, sweeps
from clausegrid.plans.queries import _COS, _TRIM, CLAUSES_SQL, _clauses, query
from clausegrid.sources import tables


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


def _hits(patterns: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(regexp_matches(text, '{_sql(p)}') AS INTEGER)" for p in patterns)


def _some(patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches(text, '{_sql(p)}')" for p in patterns) + ")"


def _scrub_sql() -> str:
    out = "text"
    for pattern, by in screening.PERSONAL:
        out = f"regexp_replace({out}, '{_sql(pattern)}', '{by}', 'g')"
    return out


@query(f"SELECT doc_id, md5({_scrub_sql()}) AS digest, length({_scrub_sql()}) AS n_chars FROM documents")
def pii_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = tables.table(spark, sf_dir, "documents").select("doc_id", screening.scrubbed(F.col("text")).alias("t"))
    return clean.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").cast("long").alias("n_chars"))


@query(f"""
SELECT doc_id, CASE WHEN {_hits(screening.RESUME)} >= 2 THEN 'resume' WHEN {_hits(screening.INVOICE)} >= 2 THEN 'invoice'
  WHEN {_some(screening.OTHER_CONTRACT)} THEN 'other_contract' WHEN {_hits(screening.LEASE)} < 2 THEN 'unknown' ELSE 'lease' END AS kind FROM documents""")
def doc_type_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.kinds(tables.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "kind")


_PROVINCE_SQL = "CASE " + " ".join(f"WHEN contains(lower(text), '{n}') THEN '{c}'" for n, c in screening.PROVINCES) + " END"
_POSTAL_SQL = "CASE " + " ".join(f"WHEN letters[1] = '{k}' THEN '{v}'" for k, v in screening.POSTAL_LETTERS.items()) + " END"


_LAW = ", ".join(f"nullif(regexp_extract(text, '{p}'), '')" for p in screening.GOVERNING_LAW)


@query(f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT *, regexp_extract_all(text, '{screening.POSTAL}', 1) AS letters, {_hits(screening.ONTARIO_ACTS)} AS acts, {_some(screening.ABROAD)} AS abroad, coalesce({_LAW}) AS law FROM t),
v AS (
  SELECT doc_id, 0 AS place, {_PROVINCE_SQL.replace("lower(text)", "lower(law)")} AS code, 3 AS n FROM p
  UNION ALL SELECT doc_id, 1, 'CA-ON', 2 * acts FROM p WHERE acts > 0
  UNION ALL SELECT doc_id, 2, CASE WHEN len(list_filter(letters, lambda x: x IN ('M', 'K', 'L', 'N', 'P'))) > 0 THEN 'CA-ON' ELSE {_POSTAL_SQL} END, 2 FROM p WHERE len(letters) > 0
  UNION ALL SELECT doc_id, 3, {_PROVINCE_SQL}, 1 FROM p),
s AS (SELECT doc_id, code, sum(n) AS n, min(place) AS place FROM v WHERE code IS NOT NULL GROUP BY doc_id, code),
b AS (SELECT *, row_number() OVER w AS r, lead(n) OVER w AS second, sum(n) OVER (PARTITION BY doc_id) AS total FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY n DESC, place))
SELECT p.doc_id, CASE WHEN abroad THEN 'INTL' ELSE coalesce(code, 'UNKNOWN') END AS code, CASE WHEN abroad THEN 0 ELSE coalesce(n, 0) END AS votes,
       CASE WHEN abroad THEN 50 WHEN code IS NULL THEN 10 WHEN second >= n * 0.7 THEN 30 ELSE CAST(floor(least(CAST(0.95 AS DOUBLE), n / CAST(total AS DOUBLE) + CAST(0.3 AS DOUBLE)) * 100 + 0.5) AS INTEGER) END AS confidence_pct,
       NOT abroad AND coalesce(second >= n * 0.7, false) AS ambiguous, NOT abroad AND coalesce(code = 'CA-ON', false) AS supported
FROM p LEFT JOIN b ON b.doc_id = p.doc_id AND r = 1""")
def jurisdiction_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.jurisdictions(tables.table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(rf"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, string_split(regexp_replace(text, '(\(\d+\))', chr(2) || '\1', 'g'), chr(2)) AS parts FROM t WHERE length(text) > 2000),
p AS (SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS part FROM m),
w AS (SELECT doc_id, part, {_TRIM.format("raw")} AS text FROM p),
s AS (SELECT doc_id, part, CASE WHEN length(text) > 2000 THEN string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) ELSE [text] END AS x FROM w WHERE text <> ''),
q AS (SELECT doc_id, part, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM s),
r(doc_id, part, i, chunk, size) AS (
  SELECT doc_id, part, i, 0, length(x) FROM q WHERE i = 1
  UNION ALL
  SELECT q.doc_id, q.part, q.i, CASE WHEN r.size + length(q.x) + 1 > 2000 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.size + length(q.x) + 1 > 2000 THEN length(q.x) ELSE r.size + 1 + length(q.x) END
  FROM r JOIN q ON q.doc_id = r.doc_id AND q.part = r.part AND q.i = r.i + 1),
c AS (SELECT q.doc_id, q.part, r.chunk, {_TRIM.format("string_agg(q.x, ' ' ORDER BY q.i)")} AS text FROM q JOIN r ON r.doc_id = q.doc_id AND r.part = q.part AND r.i = q.i GROUP BY ALL),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, chunk) - 1 AS n, text FROM c)
SELECT doc_id, doc_id || CASE WHEN n > 0 THEN '.' || n ELSE '' END AS number, length(text) AS n_chars, md5(text) AS digest FROM n
UNION ALL SELECT doc_id, CAST(doc_id AS VARCHAR), length(text), md5(text) FROM t WHERE length(text) <= 2000""")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("number"), F.coalesce("text", F.lit("")).alias("text"))
    found = parsing.statute_chunks(docs)
    return found.select("doc_id", "number", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


_REFS = ", ".join("regexp_extract_all(text, '{}', 1)".format(p) for p in documents.REFERENCES)


@query(f"""
WITH f AS (SELECT doc_id, flatten([{_REFS}]) AS f FROM documents)
SELECT doc_id, array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), ',') AS refs FROM f""")
def cross_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.array_join(documents.references(F.col("text")), ",").alias("refs"))


_KINDS = ("entry_rights", "quiet_enjoyment", "pets", "renewal_terms", "early_termination")
_A = f"[{', '.join(repr(k) for k in _KINDS)}][1 + doc_id % 5]"


def _any_sql(text: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '{p}')" for p in patterns) + ")"


@query(f"""
WITH d AS (SELECT source, doc_id, {_A} AS kind, text || [' The landlord may enter.', ' No right to sublet.', ''][1 + doc_id % 3] AS text FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, lag(doc_id) OVER w AS id_a, lag(kind) OVER w AS type_a, lag(text) OVER w AS text_a FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
f AS (SELECT *, {_any_sql("text_a", reports.GRANTS)} AS ga, {_any_sql("text", reports.GRANTS)} AS gb, {_any_sql("text_a", reports.RESTRICTS)} AS ra, {_any_sql("text", reports.RESTRICTS)} AS rb,
        CASE list_sort([kind, type_a]) WHEN ['entry_rights', 'quiet_enjoyment'] THEN 'entry_vs_quiet_enjoyment' WHEN ['early_termination', 'renewal_terms'] THEN 'termination_vs_renewal' END AS known FROM p WHERE id_a IS NOT NULL),
h AS (SELECT *, trim(text_a, ' ') <> trim(text, ' ') AND CASE WHEN known IS NOT NULL THEN (ga OR gb) AND (ra OR rb) ELSE (ga AND rb) OR (ra AND gb) END AS has FROM f)
SELECT id_a, doc_id AS id_b, has AS has_contradiction, CASE WHEN has THEN coalesce(known, 'generic') END AS kind,
       CASE WHEN has THEN CASE known WHEN 'entry_vs_quiet_enjoyment' THEN 'high' ELSE 'medium' END END AS severity FROM h""")
def contradiction_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the one before it in its source."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))
    docs = tables.table(spark, sf_dir, "documents").where("text is not null")
    docs = docs.select("source", "doc_id", pick(_KINDS).alias("kind"), F.concat("text", pick((" The landlord may enter.", " No right to sublet.", ""))).alias("text"))
    flags = docs.select("source", F.struct("doc_id", "kind", reports.contradiction_flags(F.col("text")).alias("flags")).alias("own"), "doc_id")
    # The row before is the greatest one so far; only flags and digests are dealt into ranges, no texts.
    before = sweeps.running(sweeps.in_ranges(flags, ["source"], ["doc_id"]), ["source"], ["doc_id"], "before", F.col("own"), "max", own=False).where("before is not null")
    side = lambda row, s: (F.col(f"{row}.doc_id").alias(f"id_{s}"), F.col(f"{row}.kind").alias(f"type_{s}"), F.col(f"{row}.flags").alias(f"flags_{s}"))
    return reports.conflicts(before.select(*side("before", "a"), *side("own", "b"))).select("id_a", "id_b", "has_contradiction", "kind", "severity")


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ranked lists for every hundredth vector: by its own vector and the two that follow it."""
    v = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.lit(0).alias("grp"))
    asked = v.where("id % 100 < 3").select(F.col("id").alias("query_id"), "vec", "grp")
    near = retrieval.nearest(asked, v, 5, -1.0, by_cells=True)
    return near.select(F.expr("query_id - query_id % 100").alias("query_id"), (F.col("query_id") % 100).alias("list"), "id", "rank", F.col("cosine").alias("score"))


@query(f"""
WITH s AS (SELECT a.vec_id - a.vec_id % 100 AS query_id, a.vec_id % 100 AS list, b.vec_id AS id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 < 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY score DESC, id) AS rank FROM s),
f AS (SELECT query_id, id, round(0.7 * sum(CAST(1.0 AS DOUBLE) / (60 + rank)) / (3 / CAST(61 AS DOUBLE)) + 0.3 * max(score), 4) AS score FROM r WHERE rank <= 5 GROUP BY ALL)
SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 5""")
def multi_query_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fused(_lists(spark, sf_dir), 3, 5).select("query_id", "id", "score", "rank")


@query(f"""
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, a.label = b.label AS hit, round({_COS}, 6) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM s),
q AS (SELECT query_id, max(CAST(hit AS INTEGER)) AS hit FROM r WHERE rank <= 5 GROUP BY query_id)
SELECT avg(hit) AS hit_rate, avg(hit) >= 0.8 AS passes FROM q""")
def retrieval_hitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of every hundredth vectors with one of their label among the five nearest others."""
    v = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"), F.lit(0).alias("grp"))
    asked = v.where("id % 100 = 0")
    near = retrieval.nearest(asked.select(F.col("id").alias("query_id"), "grp", "vec"), v, 6, -1.0, by_cells=True).where("id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    five = near.withColumn("place", place).where("place <= 5")
    named = five.join(v.select("id", "label"), "id").join(asked.select(F.col("id").alias("query_id"), F.col("label").alias("want")), "query_id")
    hits = named.groupBy("query_id").agg(F.max((F.col("label") == F.col("want")).cast("double")).alias("hit"))
    return hits.agg(F.avg("hit").alias("hit_rate"), (F.avg("hit") >= 0.8).alias("passes"))


@query("""
WITH d AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'),
a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders),
c AS (SELECT o_custkey, count(*) FILTER (n <= 5) AS k FROM d GROUP BY o_custkey),
u AS (SELECT o_custkey, o_orderkey, 0 AS widened FROM d WHERE n <= 5
      UNION ALL SELECT a.o_custkey, a.o_orderkey, 1 FROM a LEFT JOIN c USING (o_custkey) WHERE a.n <= 5 AND coalesce(k, 0) < 2)
SELECT o_custkey, o_orderkey, min(widened) AS widened FROM u GROUP BY o_custkey, o_orderkey""")
def recent_then_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lease_id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("risk_score"), "o_orderdate")
    recent = portfolio.ranked(rows.where("o_orderdate >= '1996-01-01'"), 5)
    few = recent.groupBy("lease_id").agg(F.count(F.lit(1)).alias("k"))
    wide = portfolio.ranked(rows, 5).join(few, "lease_id", "left").where(F.coalesce("k", F.lit(0)) < 2)
    both = recent.select("lease_id", "seq", F.lit(0).alias("widened")).unionByName(wide.select("lease_id", "seq", F.lit(1).alias("widened")))
    return both.groupBy(F.col("lease_id").alias("o_custkey"), F.col("seq").alias("o_orderkey")).agg(F.min("widened").alias("widened"))


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_custkey % 3 > 0 THEN make_date(1995 + o_custkey % 3, 6, 1) END AS floor FROM orders)
SELECT o_orderkey, day, floor FROM o WHERE floor IS NULL OR day >= floor""")
def optional_date_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders not older than their customer's floor; a third of the customers have none."""
    floor = F.when(F.col("o_custkey") % 3 > 0, F.make_date((1995 + F.col("o_custkey") % 3).cast("int"), F.lit(6), F.lit(1)))
    rows = tables.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), floor.alias("floor"))
    return tables.since(rows, "day", F.col("floor"))


@query("""
SELECT p_partkey AS id, ['last_months_rent', 'key_deposit_refundable', 'security_or_damage_deposit', 'pet_deposit_or_fee', 'application_or_credit_check_fee', 'admin_or_move_in_fee', 'post_dated_cheque_fee', 'other'][1 + p_partkey % 8] AS fee_type,
       ['legal', 'conditional', 'illegal', 'illegal', 'illegal', 'illegal', 'illegal', NULL][1 + p_partkey % 8] AS verdict FROM part""")
def fee_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(n) for n, _ in rules.FEES), F.lit("other"))
    rows = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.element_at(names, (F.col("p_partkey") % 8 + 1).cast("int")).alias("fee_type"))
    return rules.fee_verdicts(rows).select("id", "fee_type", "verdict")


@query(f"""
WITH {CLAUSES_SQL}
SELECT clause_type, avg(risk_score) AS mean, count(DISTINCT lease_id) AS leases, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share FROM clauses GROUP BY clause_type""")
def type_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _clauses(spark, sf_dir).groupBy("clause_type").agg(F.avg("risk_score").alias("mean"), F.count_distinct("lease_id").alias("leases"), F.count(F.lit(1)).alias("n"))
    every = per.agg(F.sum("n").alias("every"))
    return per.join(F.broadcast(every)).select("clause_type", "mean", "leases", F.round(F.col("n") * 100.0 / F.col("every"), 2).alias("share"))
