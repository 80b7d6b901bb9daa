"""The query catalogue over the driver's tables, each query with its DuckDB SQL.

The tables hold no leases, so orders stand for documents, line items for
clauses (discount as risk), events for traces, and documents for texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.functions.texts import contains_any
from clausegrid.operators import documents, events, pairs, portfolio, postings, retrieval, rules, sweeps
from clausegrid.sources import tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as clauses: risk_score is a hundred times the discount, from 0 to 10."""
    return tables.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("lease_id"),
        F.col("l_linenumber").alias("seq"),
        F.round(F.col("l_discount") * 100, 0).alias("risk_score"),
        F.col("l_returnflag").alias("clause_type"),
        (F.col("l_returnflag") == "R").alias("heavy"),
        ((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.05)).alias("void"),
        "l_partkey",
        "l_suppkey",
    )


CLAUSES_SQL = """
clauses AS (
  SELECT l_orderkey AS lease_id, l_linenumber AS seq, round(l_discount * 100, 0) AS risk_score, l_returnflag AS clause_type,
         l_returnflag = 'R' AS heavy, l_returnflag = 'R' AND l_discount >= 0.05 AS void, l_partkey, l_suppkey
  FROM lineitem)"""


def _level(x: str) -> str:
    return f"CASE WHEN {x} <= 3 THEN 'low' WHEN {x} <= 6 THEN 'medium' WHEN {x} <= 8 THEN 'high' ELSE 'critical' END"


@query("""
SELECT count(DISTINCT o_orderkey) AS total_leases,
       floor(CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) / count(*) * 10 + 0.5) / 10 AS avg_risk_score,
       count(l_orderkey) AS total_clauses,
       count(CASE WHEN l_discount >= 0.08 OR l_returnflag = 'R' THEN 1 END) AS total_red_flags
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderstatus = 'F'""")
def public_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = tables.table(spark, sf_dir, "orders"), tables.table(spark, sf_dir, "customer")
    own = orders.where("o_orderstatus = 'F'").join(customer.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    leases = own.select(F.col("o_orderkey").alias("lease_id"), F.col("o_totalprice").cast("decimal(15,2)").alias("score"))
    red = (F.col("l_discount") >= 0.08) | (F.col("l_returnflag") == "R")
    clauses = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("lease_id"), red.alias("red"))
    return portfolio.public_stats(leases, clauses)


@query(f"""
WITH {CLAUSES_SQL},
p AS (SELECT lease_id, floor(sum(CASE WHEN heavy THEN 1.5 ELSE 1.0 END * risk_score) / sum(CASE WHEN heavy THEN 1.5 ELSE 1.0 END) * 10 + 0.5) / 10 AS base,
             max(risk_score) AS top, count(*) FILTER (void) AS n_void FROM clauses GROUP BY lease_id),
o AS (SELECT *, greatest(CASE WHEN top >= 8 THEN floor((0.6 * base + CAST(0.4 AS DOUBLE) * top) * 10 + 0.5) / 10 ELSE base END,
             CASE WHEN n_void >= 4 THEN 9.5 WHEN n_void = 3 THEN 8.5 WHEN n_void = 2 THEN 7.5 ELSE 0 END) AS overall FROM p)
SELECT lease_id, base, top, n_void, overall, {_level("overall")} AS level FROM o""")
def weighted_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.overall_risk(_clauses(spark, sf_dir))


@query(f"""
WITH {CLAUSES_SQL},
p AS (SELECT lease_id, count(*) AS n, count(*) FILTER (risk_score <= 3) AS low, count(*) FILTER (risk_score > 3 AND risk_score <= 6) AS medium,
             count(*) FILTER (risk_score > 6 AND risk_score <= 8) AS high, count(*) FILTER (risk_score > 8) AS critical FROM clauses GROUP BY lease_id)
SELECT *, {", ".join(f"floor({x} * CAST(100 AS DOUBLE) / n * 100 + 0.5) / 100 AS {x}_share" for x in ("low", "medium", "high", "critical"))} FROM p""")
def risk_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.risk_distribution(_clauses(spark, sf_dir))


def _ranked_sql(k: int | None, least: float | None) -> str:
    cond = f"WHERE risk_score >= {least}" if least is not None else ""
    return f"""
WITH {CLAUSES_SQL},
r AS (SELECT lease_id, seq, risk_score, row_number() OVER (PARTITION BY lease_id ORDER BY risk_score DESC NULLS LAST, seq) AS place FROM clauses {cond})
SELECT lease_id, seq, risk_score, place FROM r {f'WHERE place <= {k}' if k else ''}"""


@query(_ranked_sql(1, None))
def top_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.ranked(_clauses(spark, sf_dir), 1).select("lease_id", "seq", "risk_score", "place")


@query(_ranked_sql(12, 4))
def top12_negotiation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.ranked(_clauses(spark, sf_dir), 12, 4).select("lease_id", "seq", "risk_score", "place")


@query(_ranked_sql(None, 6))
def red_flags_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.ranked(_clauses(spark, sf_dir), None, 6).select("lease_id", "seq", "risk_score", "place")


@query("""
WITH t AS (SELECT o_orderkey AS id, o_orderpriority AS grp, CAST(o_totalprice AS DECIMAL(15,2)) AS x FROM orders),
g AS (SELECT grp, count(*) - 1 AS n, sum(x) AS total, floor(median(CAST(x AS DOUBLE)) * 10 + 0.5) / 10 AS median FROM t GROUP BY grp),
c AS (SELECT id, grp, x, count(*) OVER (PARTITION BY grp ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS upto FROM t)
SELECT c.id, c.grp, g.n, CASE WHEN n >= 10 THEN CAST(floor(upto * CAST(100 AS DOUBLE) / n + 0.5) AS INTEGER) END AS percentile,
       CASE WHEN n >= 10 THEN floor(CAST(total - x AS DOUBLE) / n * 10 + 0.5) / 10 END AS mean, CASE WHEN n >= 10 THEN median END AS median
FROM c JOIN g USING (grp)""")
def benchmark_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").cast("decimal(15,2)").alias("x"))
    return portfolio.percentile_among_peers(pool, pool.select("grp", "x"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem
WHERE EXISTS (SELECT 1 FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = l_orderkey AND c_mktsegment = 'BUILDING')
GROUP BY 1, 2""")
def rls_owner_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = tables.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    own = tables.table(spark, sf_dir, "orders").join(owners, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return tables.table(spark, sf_dir, "lineitem").join(own, "l_orderkey", "left_semi").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT c_custkey, n_name AS city, CASE WHEN c_mktsegment = 'BUILDING' OR c_acctbal < 0 THEN c_name END AS c_name
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def owner_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = tables.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"))
    shown = (F.col("c_mktsegment") == "BUILDING") | (F.col("c_acctbal") < 0)
    return tables.table(spark, sf_dir, "customer").join(F.broadcast(nation), "c_nationkey").select("c_custkey", "city", F.when(shown, F.col("c_name")).alias("c_name"))


@query("""
SELECT o_orderkey, CAST(o_orderdate + INTERVAL 90 DAY AS DATE) AS expires_on FROM orders
WHERE o_orderdate + INTERVAL 90 DAY > TIMESTAMP '1998-01-01 00:00:00'""")
def expired_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    until = tables.table(spark, sf_dir, "orders").withColumn("until", F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"))
    return tables.unexpired(until, "until", "1998-01-01 00:00:00").select("o_orderkey", F.to_date("until").alias("expires_on"))


@query(f"""
WITH {CLAUSES_SQL}
SELECT a.lease_id, a.clause_type, a.seq AS a, b.seq AS b
FROM clauses a JOIN clauses b ON a.lease_id = b.lease_id AND a.clause_type = b.clause_type AND a.seq < b.seq""")
def intra_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.same_type_pairs(_clauses(spark, sf_dir))


@query(f"""
WITH {CLAUSES_SQL},
f AS (SELECT lease_id, clause_type, min(seq) AS seq FROM clauses GROUP BY ALL),
w AS (SELECT * FROM (VALUES ('A', 'N'), ('A', 'R'), ('N', 'R')) t(left_type, right_type))
SELECT x.lease_id, left_type, right_type, least(x.seq, y.seq) AS a, greatest(x.seq, y.seq) AS b
FROM w JOIN f x ON x.clause_type = left_type JOIN f y ON y.clause_type = right_type AND y.lease_id = x.lease_id""")
def cross_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.cross_type_pairs(_clauses(spark, sf_dir), [("A", "N"), ("A", "R"), ("N", "R")])


_REQUIRED = [(1, "click"), (2, "purchase"), (3, "signup"), (4, "view"), (5, "refund")]


@query("""
WITH r AS (SELECT * FROM (VALUES (1, 'click'), (2, 'purchase'), (3, 'signup'), (4, 'view'), (5, 'refund')) t(place, kind)),
u AS (SELECT DISTINCT user_id AS lease_id FROM events),
h AS (SELECT DISTINCT user_id AS lease_id, place FROM events JOIN r ON kind = event_type)
SELECT u.lease_id, count(h.place) AS n_have, 5 - count(h.place) AS n_missing, floor(count(h.place) * CAST(100 AS DOUBLE) / 5 + 0.5) / 100 AS coverage
FROM u LEFT JOIN h USING (lease_id) GROUP BY u.lease_id""")
def missing_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("lease_id"), F.col("event_type").alias("clause_type"))
    out = pairs.present_and_missing(found, _REQUIRED)
    return out.select("lease_id", F.size("have").cast("long").alias("n_have"), F.size("missing").cast("long").alias("n_missing"), "coverage")


_TERMS = ["the license", "worthless", "heaea", "password", "tionand"]


@query(f"""
SELECT doc_id FROM documents WHERE {" OR ".join(f"contains(lower(text), '{t}')" for t in _TERMS)}""")
def ilike_any_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents").where(contains_any(F.col("text"), _TERMS)).select("doc_id")


_COS = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))"


def _nearest_sql(k: int, least: float) -> str:
    return f"""
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS}, 6) AS cosine
      FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM s WHERE cosine >= {least}),
v AS (SELECT query_id, id, cosine, rank FROM r WHERE rank <= {k})"""


def _nearest(spark: SparkSession, sf_dir: str, k: int, least: float) -> DataFrame:
    vectors = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("vec"))
    asked = vectors.where("id % 100 = 0").select(F.col("id").alias("query_id"), "grp", "vec")
    return retrieval.nearest(asked, vectors.select("id", "grp", "vec"), k, least).select("query_id", "id", "cosine", "rank")


@query(f"WITH {_nearest_sql(5, 0.1)} SELECT * FROM v")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, 5, 0.1)


_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '')"
_ASKED = {0: ["the", "and"], 1: ["that", "for"], 2: ["de", "la"]}


def _index(spark: SparkSession, sf_dir: str, english: bool = False) -> postings.Postings:
    """The inverted index of the documents, which all searches of the same tables share."""
    docs = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return postings.index_of(docs, sf_dir, tables.scratch(spark, "index"), english)


@query(f"""
SELECT doc_id FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) WHERE list_has_all(t, ['the', 'and', 'that'])""")
def fts_and_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(0, "the and that")], "query_id int, asked string")
    return _index(spark, sf_dir).matching_all(asked).select(F.col("id").alias("doc_id"))


def _bm25_sql(k: int) -> str:
    values = ", ".join(f"({q}, '{w}')" for q, ws in _ASKED.items() for w in ws)
    return f"""
d AS (SELECT doc_id AS id, {_TOKENS} AS t FROM documents),
n AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM d),
q AS (SELECT * FROM (VALUES {values}) x(query_id, word)),
tf AS (SELECT id, len(t) AS dl, word, len(list_filter(t, lambda w: w = word)) AS tf FROM d, (SELECT DISTINCT word FROM q)),
f AS (SELECT word, count(*) AS df FROM tf WHERE tf > 0 GROUP BY word),
b AS (SELECT query_id, id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))), 6) AS score, count(*) AS found
      FROM tf JOIN f USING (word) JOIN q USING (word), n WHERE tf > 0 GROUP BY query_id, id),
t AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b WHERE found = 2) WHERE rank <= {k})"""


def _ranked_texts(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    asked = spark.createDataFrame([(q, " ".join(ws)) for q, ws in _ASKED.items()], "query_id int, asked string")
    return _index(spark, sf_dir).bm25(asked, k)


@query(f"WITH {_bm25_sql(10)} SELECT * FROM t")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked_texts(spark, sf_dir, 10).select("query_id", "id", "score", "rank")


@query(f"""
WITH {_nearest_sql(30, -1.0)}, {_bm25_sql(30)},
a AS (SELECT vec_id AS query_id, (vec_id // 100) % 3 AS asked FROM embeddings WHERE vec_id % 100 = 0),
x AS (SELECT a.query_id, t.id, t.rank FROM t JOIN a ON a.asked = t.query_id),
h AS (SELECT coalesce(v.query_id, x.query_id) AS query_id, coalesce(v.id, x.id) AS id,
             round(0.7 * (CAST(coalesce(1.0 / (60 + v.rank), 0) AS DOUBLE) + CAST(coalesce(1.0 / (60 + x.rank), 0) AS DOUBLE)) * 61 / 2 + 0.3 * coalesce(v.cosine, 0), 4) AS score
      FROM v FULL JOIN x ON v.query_id = x.query_id AND v.id = x.id)
SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM h) WHERE rank <= 10""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector with one of three word queries; lists are three times as long as the result."""
    k = 10
    texts = _ranked_texts(spark, sf_dir, 3 * k).select(F.col("query_id").alias("asked"), "id", "rank")
    own = tables.table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.expr("cast((vec_id div 100) % 3 as int)").alias("asked"))
    return retrieval.hybrid(_nearest(spark, sf_dir, 3 * k, -1.0), own.join(texts, "asked").select("query_id", "id", "rank"), k).select("query_id", "id", "score", "rank")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their source, with a header and a page number as printed ones have."""
    text = F.concat(F.lit("Residential  lease\n"), F.col("text"), F.lit("\n  Page "), F.col("doc_id"), F.lit("\ninitials:\t"))
    return tables.table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("page"), text.alias("text"))


_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_PAGES_SQL = f"""
pages AS (SELECT source AS file, doc_id AS page, 'Residential  lease' || chr(10) || text || chr(10) || '  Page ' || doc_id || chr(10) || 'initials:' || chr(9) AS text FROM documents),
l AS (SELECT file, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM pages WHERE text IS NOT NULL),
c AS (SELECT file, {_TRIM.format("line")} AS line, count(DISTINCT page) AS pages FROM l GROUP BY ALL),
p AS (SELECT file, count(DISTINCT page) AS total FROM pages GROUP BY ALL),
h AS (SELECT c.file, c.line, c.pages FROM c JOIN p USING (file) WHERE line <> '' AND pages >= greatest(2, floor(total * 0.3)))"""


@query(f"WITH {_PAGES_SQL} SELECT file, line, pages FROM h")
def header_footer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.header_footer_lines(_pages(spark, sf_dir))


@query(f"""
WITH {_PAGES_SQL},
k AS (SELECT l.* FROM l LEFT JOIN h ON h.file = l.file AND h.line = {_TRIM.format("l.line")} WHERE h.line IS NULL AND NOT ({" OR ".join(f"regexp_matches(l.line, '{p}')" for p in documents.PAGE_NUMBERS)})),
s AS (SELECT file, page, string_agg(line, chr(10) ORDER BY n) AS text FROM k GROUP BY ALL)
SELECT p.file, p.page, md5(coalesce(s.text, '')) AS digest FROM pages p LEFT JOIN s ON s.file = p.file AND s.page = p.page""")
def headers_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.without_headers(_pages(spark, sf_dir)).select("file", "page", F.md5("text").alias("digest"))


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages, ten to a file."""
    return tables.table(spark, sf_dir, "documents").select(F.expr("doc_id div 10").alias("file"), F.col("doc_id").alias("page"), "text")


@query(f"""
WITH t AS (SELECT doc_id // 10 AS file, doc_id AS page, translate({_TRIM.format("text")}, '’‘“”□' || chr(65533), '''''""''''') AS text FROM documents)
SELECT file, md5(string_agg(text, chr(10) || chr(10) ORDER BY page)) AS digest FROM t WHERE text <> '' GROUP BY file""")
def assembled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.assembled(_paired(spark, sf_dir)).select("file", F.md5("text").alias("digest"))


_OPENS = " OR ".join(f"regexp_matches(t, '{p}')" for p in documents.BOUNDARIES)
_B = documents.BOUNDARIES


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
o AS (SELECT *, {_TRIM.format("line")} AS t FROM l),
s AS (SELECT *, {_OPENS} AS opens, sum(CASE WHEN {_OPENS} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS part FROM o),
g AS (SELECT doc_id, part, {_TRIM.format("string_agg(line, chr(10) ORDER BY n)")} AS text, min(CASE WHEN opens THEN t END) AS t FROM s GROUP BY doc_id, part),
b AS (SELECT *, max(part) OVER (PARTITION BY doc_id) AS bounds FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part) AS clause, count(*) OVER (PARTITION BY doc_id) AS clauses FROM b WHERE text <> '' AND bounds > 0),
a AS (
  SELECT doc_id, clause, coalesce(nullif(CASE WHEN regexp_matches(t, '{_B[0]}') THEN regexp_extract(t, '{_B[0]}', 1) WHEN regexp_matches(t, '{_B[1]}') THEN regexp_extract(t, '{_B[1]}', 1)
           WHEN regexp_matches(t, '{_B[2]}') THEN regexp_extract(t, '{_B[2]}', 1) WHEN regexp_matches(t, '{_B[3]}') THEN ''
           WHEN regexp_matches(t, '{_B[4]}') THEN regexp_extract(t, '{_B[4]}', 1) || ' ' || regexp_extract(t, '{_B[4]}', 2) END, ''), 'synthetic-' || clause) AS number,
         nullif(CASE WHEN regexp_matches(t, '{_B[0]}') THEN regexp_extract(t, '{_B[0]}', 2) WHEN regexp_matches(t, '{_B[1]}') THEN regexp_extract(t, '{_B[1]}', 2)
           WHEN regexp_matches(t, '{_B[2]}') THEN regexp_extract(t, '{_B[2]}', 2) WHEN regexp_matches(t, '{_B[3]}') THEN t WHEN regexp_matches(t, '{_B[4]}') THEN regexp_extract(t, '{_B[4]}', 3) END, '') AS heading,
         text, CASE WHEN bounds >= 5 AND clauses >= 5 THEN 0.85 WHEN bounds >= 2 THEN 0.6 ELSE 0.4 END AS confidence FROM k),
f AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\n{{2,}}'), lambda x: {_TRIM.format("x")}), lambda x: length(x) > 20) AS parts
      FROM documents WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM b WHERE bounds > 0)),
q AS (SELECT doc_id, CASE WHEN len(parts) > 1 THEN parts ELSE [{_TRIM.format("text")}] END AS parts FROM f),
u AS (SELECT doc_id, generate_subscripts(parts, 1) AS clause, unnest(parts) AS text FROM q)
SELECT doc_id, clause, number, {_TRIM.format("heading")} AS heading, length(text) AS n_chars, md5(text) AS digest, CAST(confidence AS DOUBLE) AS confidence FROM a
UNION ALL SELECT doc_id, clause, 'synthetic-' || clause, NULL, length(text), md5(text), 0.3 FROM u""")
def segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = documents.segments(tables.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("clause").cast("long").alias("clause"), "number", "heading", "n_chars", F.md5("text").alias("digest"), "confidence")


_INJECTED = " OR ".join("regexp_matches(text, '{}')".format(p.replace("'", "''")) for p in documents.INJECTIONS)


def _hits_sql(patterns: tuple[str, ...]) -> str:
    return " + ".join("CAST(regexp_matches(lower(text), '{}') AS INTEGER)".format(p.lower().replace("'", "''")) for p in patterns)


@query(f"""
WITH h AS (SELECT doc_id, text, [{", ".join(_hits_sql(p) for _, _, p in documents.CLAUSE_TYPES)}] AS h FROM documents),
b AS (SELECT *, list_max(h) AS hits, list_position(h, list_max(h)) AS place, len(list_filter(h, lambda x: x > 0)) AS n_types FROM h),
c AS (SELECT *, least(0.95, CAST(0.4 AS DOUBLE) + hits / CAST([{", ".join(str(len(p)) for _, _, p in documents.CLAUSE_TYPES)}][place] AS DOUBLE) * CAST(0.55 AS DOUBLE) + CASE WHEN n_types = 1 THEN CAST(0.1 AS DOUBLE) ELSE 0 END) AS raw FROM b)
SELECT doc_id, hits, n_types,
       CASE WHEN text IS NULL OR trim(text, ' ') = '' OR hits = 0 THEN 'unknown' ELSE [{", ".join(f"'{n}'" for n, _, _ in documents.CLAUSE_TYPES)}][place] END AS primary_type,
       CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 0.0 WHEN hits = 0 THEN 0.1 ELSE floor(CASE WHEN n_types > 1 THEN greatest(CAST(0.3 AS DOUBLE), raw - CAST(0.15 AS DOUBLE)) ELSE raw END * 100 + 0.5) / 100 END AS confidence,
       hits > 0 AND [{", ".join(f"'{p}'" for _, p, _ in documents.CLAUSE_TYPES)}][place] <> 'none' AS needs_lookup
FROM c WHERE text IS NOT NULL""")
def classify_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents.classified(tables.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.where("text is not null").select("doc_id", "hits", F.col("n_types").cast("long").alias("n_types"), "primary_type", "confidence", "needs_lookup")


@query(f"""
SELECT conv_id, turn, coalesce({_INJECTED}, false) AS blocked FROM conversations""")
def injection_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.screened(tables.table(spark, sf_dir, "conversations")).select("conv_id", "turn", "blocked")


@query(f"""
WITH c AS (SELECT conv_id, turn, role, substring(text, 1, 2000) AS text FROM conversations),
s AS (SELECT * FROM c WHERE NOT (role = 'user' AND coalesce({_INJECTED}, false))),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end FROM s)
SELECT conv_id, turn, role, from_end FROM r WHERE from_end <= 6""")
def chat_tail6(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return documents.last_turns(turns).select("conv_id", "turn", "role", "from_end")


_INCREASES_SQL = """
WITH g AS (SELECT * FROM (VALUES {values}) t(guideline_year, percent)),
r AS (SELECT o_orderkey AS id, CAST(1000 + o_orderkey % 500 AS DOUBLE) AS current_rent, CAST(1000 + o_orderkey % 500 + o_orderkey % 40 AS DOUBLE) AS proposed_rent,
             CAST(o_orderdate AS DATE) + INTERVAL 26 YEAR AS eff, o_orderkey % 7 = 0 AS exempt, o_orderkey % 11 = 0 AS approved,
             CAST(60 + o_orderkey % 60 AS INTEGER) AS notice, CAST(10 + o_orderkey % 5 AS INTEGER) AS months FROM orders),
s AS (SELECT *, CAST(eff AS DATE) AS effective_date, CAST(eff - to_months(months) AS DATE) AS last_date, (proposed_rent - current_rent) / current_rent * 100 AS pct,
             least(greatest(year(eff), 2018), 2027) AS guideline_year, year(eff) < 2018 OR year(eff) > 2027 AS is_estimate FROM r),
c AS (SELECT s.*, g.percent, notice >= 90 AS n_ok, effective_date >= CAST(last_date + INTERVAL 12 MONTH AS DATE) AS f_ok, exempt OR approved OR pct <= g.percent + CAST(0.01 AS DOUBLE) AS g_ok FROM s JOIN g USING (guideline_year))
SELECT id, CAST(guideline_year AS INTEGER) AS guideline_year, is_estimate, floor(pct * 100 + 0.5) / 100 AS increase_percent,
       CASE WHEN pct > 0 THEN n_ok END AS notice_ok, CASE WHEN pct > 0 THEN f_ok END AS frequency_ok, CASE WHEN pct > 0 THEN g_ok END AS guideline_ok,
       CASE WHEN pct > 0 AND NOT (n_ok AND f_ok AND g_ok) THEN 'not_compliant' ELSE 'compliant' END AS verdict
FROM c""".format(values=", ".join(f"({y}, CAST({p} AS DOUBLE))" for y, p in rules.GUIDELINES))


@query(_INCREASES_SQL)
def rent_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    eff = F.add_months(F.to_date("o_orderdate"), 12 * 26)
    rows = tables.table(spark, sf_dir, "orders").select(
        k.alias("id"),
        (1000 + k % 500).cast("double").alias("current_rent"),
        (1000 + k % 500 + k % 40).cast("double").alias("proposed_rent"),
        eff.alias("effective_date"),
        F.date_sub(eff, (60 + k % 60).cast("int")).alias("notice_date"),
        F.add_months(eff, -(10 + k % 5).cast("int")).alias("last_date"),
        (k % 7 == 0).alias("exempt"),
        (k % 11 == 0).alias("approved"),
    )
    return rules.rent_increases(rows).select("id", "guideline_year", "is_estimate", "increase_percent", "notice_ok", "frequency_ok", "guideline_ok", "verdict")


@query("""
WITH r AS (SELECT o_orderkey AS id, ['N4', 'N5', 'N8', 'N12', 'N13'][1 + o_orderkey % 5] AS kind, o_orderkey % 130 AS days, o_orderkey % 3 = 0 AS weekly,
                  o_orderkey % 4 = 0 AS severe, o_orderkey % 4 = 1 AS repairs, o_orderkey % 2 = 0 AS by_landlord, o_orderkey % 7 <> 0 AS individual, o_orderkey % 6 <> 0 AS paid FROM orders),
n AS (SELECT *, CASE kind WHEN 'N4' THEN CASE WHEN weekly THEN 7 ELSE 14 END WHEN 'N5' THEN CASE WHEN severe THEN 10 ELSE 20 END
             WHEN 'N8' THEN CASE WHEN weekly THEN 28 ELSE 60 END WHEN 'N12' THEN 60 ELSE 120 END AS required_days FROM r),
f AS (SELECT *, CAST(days < required_days AS INTEGER) + CAST(kind = 'N12' AND by_landlord AND NOT individual AS INTEGER)
             + CAST(NOT paid AND (kind = 'N12' OR (kind = 'N13' AND NOT repairs)) AS INTEGER) AS failed FROM n)
SELECT id, kind AS notice_type, CAST(required_days AS INTEGER) AS required_days, CAST(days AS INTEGER) AS actual_days, CASE WHEN kind = 'N12' THEN 1 WHEN kind = 'N13' AND NOT repairs THEN CASE WHEN id % 9 >= 5 THEN 3 ELSE 1 END ELSE 0 END AS months_owed, failed, CASE WHEN failed > 0 THEN 'not_valid' ELSE 'appears_valid' END AS verdict FROM f""")
def eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = tables.table(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.element_at(F.array(*(F.lit(x) for x in ("N4", "N5", "N8", "N12", "N13"))), (k % 5 + 1).cast("int")).alias("notice_type"),
        day.alias("notice_date"),
        F.date_add(day, (k % 130).cast("int")).alias("termination_date"),
        F.when(k % 3 == 0, "daily_weekly").otherwise("monthly").alias("tenancy"),
        F.when(k % 4 == 0, "damage_wilful_severe").when(k % 4 == 1, "repairs").otherwise("interference").alias("ground"),
        F.when(k % 2 == 0, "landlord").otherwise("purchaser").alias("served_by"),
        (k % 7 != 0).alias("individual_landlord"),
        F.lit(True).alias("individual_unit"),
        (k % 6 != 0).alias("compensation"),
        (k % 9).alias("units"),
    )
    return rules.eviction_notices(rows).select("id", "notice_type", "required_days", "actual_days", "months_owed", "failed", "verdict")


@query("""
WITH g AS (SELECT * FROM (VALUES {values}) t(y, percent)),
r AS (SELECT o_orderkey AS id, CAST(1000 + o_orderkey % 900 AS DOUBLE) AS deposit, CAST(1000 + o_orderkey % 600 AS DOUBLE) AS rent,
             CAST(CAST(o_orderdate AS DATE) + INTERVAL 24 YEAR AS DATE) AS p, DATE '2024-07-01' AS a FROM orders),
h AS (SELECT *, unnest(generate_series(year(p), year(a))) AS yr FROM r WHERE a > p),
d AS (SELECT *, date_diff('day', greatest(make_date(yr, 1, 1), p), least(make_date(yr + 1, 1, 1), a)) AS days, date_diff('day', make_date(yr, 1, 1), make_date(yr + 1, 1, 1)) AS of FROM h),
s AS (SELECT id, count(*) AS years, floor(sum(deposit * (percent / 100) * (days / CAST(of AS DOUBLE))) * 100 + 0.5) / 100 AS total FROM d JOIN g ON y = least(greatest(yr, 2018), 2027) WHERE days > 0 GROUP BY id)
SELECT r.id, deposit > rent + CAST(0.01 AS DOUBLE) AS exceeds_cap, coalesce(years, 0) AS years, coalesce(total, 0.0) AS total_interest FROM r LEFT JOIN s USING (id)""".format(values=", ".join(f"({y}, CAST({p} AS DOUBLE))" for y, p in rules.GUIDELINES)))
def deposit_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = tables.table(spark, sf_dir, "orders").select(
        k.alias("id"),
        (1000 + k % 900).cast("double").alias("deposit"),
        (1000 + k % 600).cast("double").alias("rent"),
        F.add_months(F.to_date("o_orderdate"), 12 * 24).alias("paid_date"),
        F.lit("2024-07-01").cast("date").alias("as_of_date"),
    )
    return rules.deposit_interest(rows)


@query("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events),
c AS (SELECT event_id, user_id,
  count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY user_id, us ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS in_hour,
  count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY user_id, us ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS in_day FROM e)
SELECT event_id, user_id, in_hour, in_day, in_day < 10 AND in_hour < 5 AS allowed, greatest(0, least(5 - in_hour - 1, 10 - in_day - 1)) AS remaining FROM c""")
def quota_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sliding_quota(tables.table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), 5, 10).drop("ts")


@query("""
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events),
w(user_id, start) AS (
  SELECT user_id, min(us) FROM e GROUP BY user_id
  UNION ALL SELECT w.user_id, min(e.us) FROM w JOIN e ON e.user_id = w.user_id AND e.us > w.start + 3600000000 GROUP BY w.user_id),
p AS (SELECT e.event_id, row_number() OVER (PARTITION BY e.user_id, w.start ORDER BY e.us, e.event_id) AS n FROM e ASOF JOIN w ON e.user_id = w.user_id AND e.us >= w.start)
SELECT event_id, CAST(least(n, 6) AS INTEGER) AS count, n <= 5 AS allowed FROM p""")
def quota_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.anchored_quota(tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "event_id"), 5, 3600)


@query("""
WITH f AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('purchase', 'refund')),
l AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT l.user_id AS key, coalesce(f.event_type, l.event_type) AS status, coalesce(f.event_id, l.event_id) AS event_id
FROM l LEFT JOIN f ON f.user_id = l.user_id AND f.n = 1 WHERE l.n = 1""")
def job_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "event_id", F.col("event_type").alias("status"))
    return events.latest_status(rows, ("purchase", "refund"))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("trace"), F.col("event_id").alias("seq"), F.expr("unix_micros(ts) div 1000").alias("start_ms"), F.floor(F.abs("value") * 1000).cast("long").alias("duration_ms"))


_STEPS_SQL = "steps AS (SELECT user_id AS trace, event_id AS seq, epoch_us(ts) // 1000 AS start_ms, CAST(floor(abs(value) * 1000) AS BIGINT) AS duration_ms FROM events)"


@query(f"""
WITH {_STEPS_SQL},
x AS (SELECT trace, min(start_ms) AS t0, greatest(max(start_ms + duration_ms) - min(start_ms), 1) AS span FROM steps GROUP BY trace)
SELECT trace, seq, floor((start_ms - t0) * CAST(100 AS DOUBLE) / span * 1000 + 0.5) / 1000 AS left_pct,
       greatest(0.8, floor(duration_ms * CAST(100 AS DOUBLE) / span * 1000 + 0.5) / 1000) AS width_pct
FROM steps JOIN x USING (trace)""")
def trace_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.trace_geometry(_steps(spark, sf_dir)).select("trace", "seq", "left_pct", "width_pct")


@query(f"""
WITH {_STEPS_SQL}
SELECT trace, seq, duration_ms, CAST(coalesce(sum(duration_ms) OVER (PARTITION BY trace ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ms FROM steps""")
def virtual_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.virtual_offsets(_steps(spark, sf_dir).select("trace", "seq", "duration_ms"))


@query(f"""
WITH RECURSIVE {_STEPS_SQL},
o AS (SELECT trace, seq, CAST(start_ms AS DOUBLE) AS a, CAST(start_ms + duration_ms AS DOUBLE) AS b, row_number() OVER (PARTITION BY trace ORDER BY start_ms, seq) AS n FROM steps),
r(trace, n, seq, lane, ends) AS (
  SELECT trace, n, seq, 0, [b] FROM o WHERE n = 1
  UNION ALL
  SELECT trace, n, seq, free - 1, CASE WHEN free > len(ends) THEN list_append(ends, b) ELSE list_concat(list_concat(ends[1:free - 1], [b]), ends[free + 1:]) END
  FROM (SELECT o.trace, o.n, o.seq, o.b, r.ends, CAST(coalesce(list_position(list_transform(r.ends, lambda e: o.a >= e - 0.1), true), len(r.ends) + 1) AS INTEGER) AS free FROM r JOIN o ON o.trace = r.trace AND o.n = r.n + 1))
SELECT trace, seq AS step, lane FROM r""")
def trace_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _steps(spark, sf_dir)
    return events.lanes(s.select("trace", F.col("seq").alias("step"), F.col("start_ms").cast("double").alias("start"), (F.col("start_ms") + F.col("duration_ms")).cast("double").alias("stop")))


_TOOLS = tuple(events.CATEGORIES) + ("draw_chart",)


@query(f"""
WITH RECURSIVE {_STEPS_SQL},
k AS (SELECT *, [{", ".join(f"'{t}'" for t in _TOOLS)}][1 + seq % {len(_TOOLS)}] AS tool, CASE WHEN trace % 3 = 0 AND seq % 5 = 0 THEN NULL ELSE start_ms END AS begun, CASE WHEN seq % 17 > 0 THEN duration_ms ELSE 0 END AS d FROM steps),
e AS (SELECT trace, count(*) FILTER (begun IS NULL) AS untimed, min(begun) AS t0, max(begun + d) AS t1, sum(d) AS total FROM k GROUP BY trace),
j AS (SELECT k.*, untimed = 0 AS timed, t0, greatest(CASE WHEN untimed = 0 THEN t1 - t0 ELSE total END, 1) AS span FROM k JOIN e USING (trace) WHERE tool <> 'benchmark_clause'),
p AS (SELECT trace, seq, tool, CASE WHEN timed THEN begun - t0 ELSE coalesce(sum(d) OVER (PARTITION BY trace ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END * CAST(100 AS DOUBLE) / span AS l, greatest(d * CAST(100 AS DOUBLE) / span, 0.8) AS w FROM j),
o AS (SELECT trace, seq, l AS a, l + w AS b, row_number() OVER (PARTITION BY trace ORDER BY l, seq) AS n FROM p),
r(trace, n, seq, lane, ends) AS (
  SELECT trace, n, seq, 0, [b] FROM o WHERE n = 1
  UNION ALL
  SELECT trace, n, seq, free - 1, CASE WHEN free > len(ends) THEN list_append(ends, b) ELSE list_concat(list_concat(ends[1:free - 1], [b]), ends[free + 1:]) END
  FROM (SELECT o.trace, o.n, o.seq, o.b, r.ends, CAST(coalesce(list_position(list_transform(r.ends, lambda e: o.a >= e - CAST(0.1 AS DOUBLE)), true), len(r.ends) + 1) AS INTEGER) AS free FROM r JOIN o ON o.trace = r.trace AND o.n = r.n + 1))
SELECT p.trace, p.seq AS step, CASE tool {" ".join(f"WHEN '{t}' THEN '{c}'" for t, c in events.CATEGORIES.items())} ELSE 'unknown' END AS category, round(l, 6) AS left_pct, round(w, 6) AS width_pct, lane FROM p JOIN r ON r.trace = p.trace AND r.seq = p.seq""")
def trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps of tools; a third of the traces have steps without a time."""
    tool = F.element_at(F.array(*map(F.lit, _TOOLS)), (F.col("seq") % len(_TOOLS) + 1).cast("int"))
    late = (F.col("trace") % 3 == 0) & (F.col("seq") % 5 == 0)
    steps = _steps(spark, sf_dir).select("trace", F.col("seq").alias("step"), "seq", tool.alias("tool"), F.when(~late, F.col("start_ms")).alias("start_ms"), F.when(F.col("seq") % 17 > 0, F.col("duration_ms")).alias("duration_ms"))
    return events.trace_rows(steps).select("trace", "step", "category", F.round("left_pct", 6).alias("left_pct"), F.round("width_pct", 6).alias("width_pct"), "lane")


@query(f"""
WITH {_STEPS_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY start_ms, seq) AS n FROM steps),
c AS (SELECT a.trace, a.seq, 1 + count(b.seq) AS here FROM o a LEFT JOIN o b ON b.trace = a.trace AND b.n < a.n AND b.start_ms + b.duration_ms - 0.1 > a.start_ms GROUP BY ALL)
SELECT trace, CAST(sum(duration_ms) AS BIGINT) AS total_ms, max(duration_ms) AS peak_ms, CAST(max(here) AS INTEGER) AS parallel FROM steps JOIN c USING (trace, seq) GROUP BY trace""")
def trace_parallelism(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _steps(spark, sf_dir)
    lanes = sweeps.parallelism(s.select("trace", F.col("seq").alias("step"), F.col("start_ms").cast("double").alias("start"), (F.col("start_ms") + F.col("duration_ms")).cast("double").alias("stop")))
    return events.trace_extent(s).join(lanes, "trace").select("trace", "total_ms", "peak_ms", "parallel")


@query("""
WITH r AS (SELECT contains(lower(coalesce(text, '')), 'idiot') OR contains(lower(coalesce(text, '')), 'moron') OR contains(lower(coalesce(text, '')), 'worthless') AS p, toxic = 1 AS a FROM documents JOIN labels USING (doc_id)),
c AS (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM r),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 1.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 1.0 END AS recall,
             CASE WHEN fp + tn > 0 THEN fp / CAST(fp + tn AS DOUBLE) ELSE 0.0 END AS fpr FROM c)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m""")
def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", contains_any(F.coalesce("text", F.lit("")), ["idiot", "moron", "worthless"]).alias("predicted"))
    actual = tables.table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("actual"))
    return portfolio.confusion(docs.join(actual, "doc_id").select("predicted", "actual"))


@query(f"""
WITH {CLAUSES_SQL},
s AS (SELECT lease_id, seq, 'part' AS kind, l_partkey AS source FROM clauses UNION ALL SELECT lease_id, seq, 'supplier', l_suppkey FROM clauses)
SELECT lease_id, kind, source, min(seq) AS seq FROM s GROUP BY ALL""")
def sources_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _clauses(spark, sf_dir)
    cited = F.explode(F.array(F.struct(F.lit("part").alias("kind"), F.col("l_partkey").alias("source")), F.struct(F.lit("supplier").alias("kind"), F.col("l_suppkey").alias("source"))))
    return c.select("lease_id", "seq", cited.alias("s")).groupBy("lease_id", "s.kind", "s.source").agg(F.min("seq").alias("seq"))


@query("""
SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return tables.latest(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("""
SELECT c_custkey, 'new' AS kind FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01')
UNION ALL SELECT o_orderkey, 'changed' FROM orders WHERE o_orderkey % 7 = 0 AND o_orderstatus <> 'O'""")
def load_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.table(spark, sf_dir, "orders")
    seen = orders.where("o_orderdate >= '1998-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    new = tables.unseen(tables.table(spark, sf_dir, "customer").select("c_custkey"), seen, ["c_custkey"])
    old = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "O").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    changed = tables.changed(orders.select("o_orderkey", "o_orderstatus"), old, ["o_orderkey"], "o_orderstatus")
    return new.select("c_custkey", F.lit("new").alias("kind")).unionByName(changed.select(F.col("o_orderkey").alias("c_custkey"), F.lit("changed").alias("kind")))


@query("SELECT event_id, TRY_CAST(json_extract_string(CASE WHEN starts_with(props, '{') AND json_valid(props) THEN props END, '$.k') AS BIGINT) AS k FROM events")
def json_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.when(F.col("props").startswith("{"), F.get_json_object("props", "$.k"))
    return tables.table(spark, sf_dir, "events").select("event_id", parsed.try_cast("long").alias("k"))
