"""Queries of places: clauses on pages, sections in clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.operators import alignment
from clausegrid.plans.queries import query
from clausegrid.sources import tables

_CUT = r"\. |\n"


def _norm_sql(x: str) -> str:
    plain = f"translate(lower({x}), '‘’‚‛′‵`“”„‟″‶–—', '''''''''''''''\"\"\"\"\"\"--')"
    return rf"regexp_replace(regexp_replace({plain}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def _prefix_sql(x: str, found: str) -> str:
    return ", ".join(f"{{'found': '{found}', 'prefix': {k}, 'at': CASE WHEN length({x}) >= 40 THEN instr(flat, left({x}, {k})) ELSE 0 END}}" for k in alignment.PREFIXES)


@query(rf"""
WITH d AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '{_CUT}') AS parts FROM documents),
i AS (SELECT doc_id // 10 AS file, doc_id AS page, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS item FROM d),
n AS (SELECT * FROM (SELECT file, page, item, {_norm_sql("text")} AS t FROM i) WHERE t <> ''),
s AS (SELECT *, sum(length(t) + 1) OVER (PARTITION BY file, page ORDER BY item) - length(t) - 1 AS start FROM n),
f AS (SELECT file, page, string_agg(t, ' ' ORDER BY item) AS flat FROM n GROUP BY file, page),
c AS (SELECT doc_id // 10 AS file, doc_id AS clause, replace(parts[2] || ' ' || coalesce(parts[3], ''), ' ', chr(9) || ' ') AS own, parts[1] AS heading, [60, 28, 17, 5, 30][1 + doc_id % 5] AS k FROM d),
b AS (SELECT file, clause, CASE WHEN k = 30 THEN left(own, 30) ELSE left(own, k) || CASE WHEN k < 60 THEN ' zq§ ' ELSE '' END || substr(own, k + 1) END AS body, heading FROM c),
x AS (SELECT file, clause, {_norm_sql("body")} AS body, {_norm_sql("heading")} AS heading FROM b),
h AS (SELECT x.file, clause, page, list_filter([{_prefix_sql("body", "body")}, {_prefix_sql("heading", "heading")}], lambda z: z.at > 0)[1] AS z FROM x JOIN f ON f.file = x.file)
SELECT h.file, h.clause, h.page, z.found AS found, z.prefix AS prefix, CAST(min(item) AS INTEGER) AS first_item, CAST(max(item) AS INTEGER) AS last_item
FROM h JOIN s ON s.file = h.file AND s.page = h.page AND s.start < z.at - 1 + z.prefix AND s.start + length(s.t) > z.at - 1
WHERE z IS NOT NULL GROUP BY ALL""")
def clause_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents as the pages of a file; a clause is made of each page's second and third sentence, spoilt at different places."""
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 10").alias("file"), F.split(F.coalesce("text", F.lit("")), _CUT, -1).alias("parts"))
    # Without outer, a filter on the array's size would be pushed down and split the texts once more.
    items = docs.select("file", F.col("doc_id").alias("page"), F.posexplode_outer("parts").alias("item", "text"))
    part = lambda n: F.try_element_at("parts", F.lit(n))
    own = F.regexp_replace(F.concat(part(2), F.lit(" "), F.coalesce(part(3), F.lit(""))), " ", "\t ")
    k = F.element_at(F.array(*map(F.lit, (60, 28, 17, 5, 30))), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = docs.select("file", F.col("doc_id").alias("clause"), own.alias("own"), part(1).alias("heading"), k.alias("k"))
    spoilt = F.expr("left(own, k) || if(k < 60, ' zq§ ', '') || substr(own, k + 1)")
    clauses = rows.select("file", "clause", F.when(F.col("k") == 30, F.expr("left(own, 30)")).otherwise(spoilt).alias("body"), "heading")
    return alignment.clause_places(alignment.flat_pages(items), clauses)


_SECTIONS_SQL = """
c AS (SELECT l_orderkey AS lease_id, l_linenumber AS clause_id, ['Section ' || (l_partkey % 140), 'RTA s. ' || (l_suppkey % 60) || '(1)', 'none'] AS v, 'void under s. ' || (l_partkey % 45) || ' or section ' || (l_suppkey % 150) AS e FROM lineitem)"""


@query(f"""
WITH {_SECTIONS_SQL},
r AS (SELECT o_orderkey AS lease_id, unnest([1, 2, 3]) AS source, unnest(['Act s.' || (o_custkey % 30) || ' — rule', 'Act s.' || (o_custkey % 7) || '(1) - rule', 'no section']) AS reference, unnest([[o_custkey % 5], [], [7]]) AS stated FROM orders),
n AS (SELECT *, regexp_extract(reference, 's\\.(\\S+)\\s*[—–-]\\s*(.+)', 1) AS section FROM r),
m AS (SELECT n.lease_id, n.source, c.clause_id FROM n JOIN c ON c.lease_id = n.lease_id AND n.section <> '' AND (
  len(list_filter(c.v, lambda x: contains(replace(lower(x), ' ', ''), 's.' || n.section) OR contains(replace(lower(x), ' ', ''), 'section' || n.section))) > 0
  OR contains(lower(e), 's. ' || n.section) OR contains(lower(e), 's.' || n.section) OR contains(lower(e), 'section ' || n.section))
  UNION SELECT lease_id, source, unnest(stated) FROM n)
SELECT n.lease_id, n.source, coalesce(string_agg(DISTINCT CAST(m.clause_id AS VARCHAR), ',' ORDER BY CAST(m.clause_id AS VARCHAR)), '') AS clause_ids
FROM n LEFT JOIN m ON m.lease_id = n.lease_id AND m.source = n.source GROUP BY ALL""")
def section_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as clauses that name sections by part and supplier; three sources for each order."""
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    violations = F.array(F.concat(F.lit("Section "), part % 140), F.concat(F.lit("RTA s. "), supplier % 60, F.lit("(1)")), F.lit("none"))
    explanation = F.concat(F.lit("void under s. "), part % 45, F.lit(" or section "), supplier % 150)
    clauses = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("lease_id"), F.col("l_linenumber").cast("long").alias("clause_id"), violations.alias("violations"), explanation.alias("explanation"))
    who = F.col("o_custkey")
    each = F.array(
        F.struct(F.lit(1).alias("source"), F.concat(F.lit("Act s."), who % 30, F.lit(" — rule")).alias("reference"), F.array(who % 5).alias("stated")),
        F.struct(F.lit(2).alias("source"), F.concat(F.lit("Act s."), who % 7, F.lit("(1) - rule")).alias("reference"), F.array().cast("array<bigint>").alias("stated")),
        F.struct(F.lit(3).alias("source"), F.lit("no section").alias("reference"), F.array(F.lit(7).cast("long")).alias("stated")),
    )
    sources = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lease_id"), F.inline(each))
    found = alignment.sources_by_containment(clauses, sources)
    return found.select("lease_id", "source", F.array_join(F.array_sort(F.transform("clause_ids", lambda x: x.cast("string"))), ",").alias("clause_ids"))


_LONGEST = sorted(alignment.COMPLIANT, key=len, reverse=True)


def _longest_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({x}), '{k}') THEN '{k}'" for k in _LONGEST) + " END"


@query(f"""
SELECT l_orderkey AS lease_id, l_linenumber AS clause_id, coalesce({_longest_sql("'RTA s.' || (l_partkey % 150)")}, {_longest_sql("'S.' || (l_suppkey % 30) || '(2)'")}) AS key FROM lineitem""")
def compliant_wordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as clauses with two violations each."""
    sections = F.array(F.concat(F.lit("RTA s."), F.col("l_partkey") % 150), F.concat(F.lit("S."), F.col("l_suppkey") % 30, F.lit("(2)")))
    rows = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("lease_id"), F.col("l_linenumber").alias("clause_id"), alignment.compliant_wording(sections).alias("w"))
    return rows.select("lease_id", "clause_id", "w.key")
