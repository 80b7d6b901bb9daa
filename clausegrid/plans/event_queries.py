"""Queries of events as readers get them, and of the tools by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.operators import toolset
from clausegrid.plans.queries import query
from clausegrid.sources import tables
from clausegrid.streaming import bus


@query("""
WITH e AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' ELSE event_type END AS status FROM events),
f AS (SELECT key, min(n) AS first FROM e WHERE status IN ('complete', 'error') GROUP BY key),
j AS (SELECT c_custkey AS key, ['complete', 'failed', 'pending', 'processing'][1 + c_custkey % 4] AS state FROM customer)
SELECT e.key, e.n, e.status FROM e LEFT JOIN f ON f.key = e.key WHERE e.n <= coalesce(first, e.n)
UNION ALL SELECT key, 0, CASE state WHEN 'complete' THEN 'complete' ELSE 'error' END FROM j WHERE state IN ('complete', 'failed') AND key NOT IN (SELECT key FROM e)""")
def delivered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user up to the first purchase or error, and an end for customers without events whose job is done."""
    from pyspark.sql.window import Window

    status = F.when(F.col("event_type") == "purchase", "complete").otherwise(F.col("event_type"))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    rows = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), n.alias("n"), status.alias("status"))
    state = F.element_at(F.array(*map(F.lit, ("complete", "failed", "pending", "processing"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    jobs = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), state.alias("state"))
    return bus.with_polled_ends(rows, jobs)


_NAMED = ("check_missing", "generate_negotiation", "benchmark_clause", "detect_contradiction", "generate_report", "draw_chart", "check_missing")


@query("""
WITH l AS (SELECT *, (l_orderkey * 10 + l_linenumber) % 7 AS k, round(l_discount * 100, 0) AS s, ['entry_rights', 'pets', 'standard_boilerplate'][1 + l_partkey % 3] AS t FROM lineitem),
b AS (SELECT t, count(*) AS n FROM l GROUP BY t),
u AS (SELECT a.t, a.s, count(*) AS upto FROM (SELECT DISTINCT t, s FROM l) a JOIN l ON l.t = a.t AND l.s <= a.s GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  ['check_missing', 'generate_negotiation', 'benchmark_clause', 'detect_contradiction', 'generate_report', 'draw_chart', 'check_missing'][1 + k] AS tool,
  k >= 5 OR (k = 2 AND n < 10) AS is_error,
  CASE k WHEN 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN CASE t WHEN 'standard_boilerplate' THEN '0.15' ELSE CASE WHEN t = 'pets' THEN '0.0' ELSE '0.08' END END ELSE '0.0' END
         WHEN 1 THEN CASE WHEN t = 'standard_boilerplate' OR s < 4 THEN 'low' WHEN s >= 8 THEN 'high' WHEN s >= 6 THEN 'medium' ELSE 'low' END
         WHEN 2 THEN CASE WHEN n < 10 THEN 'Not enough benchmarks' ELSE CAST(CAST(floor(upto * 100.0 / n + CAST(0.5 AS DOUBLE)) AS INTEGER) AS VARCHAR) END
         WHEN 3 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'true' ELSE 'false' END
         WHEN 4 THEN CASE WHEN s <= 3 THEN 'low' WHEN s <= 6 THEN 'medium' WHEN s <= 8 THEN 'high' ELSE 'critical' END
         WHEN 5 THEN 'Unknown tool: draw_chart' ELSE 'Invalid input' END AS answer
FROM l JOIN b USING (t) JOIN u USING (t, s)""")
def tool_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call for every line item: five tools, one that is not there, and calls without their input."""
    rows = tables.table(spark, sf_dir, "lineitem").withColumns(
        {
            # The call's number carries what the answers are shown with, so that they need not meet the line items again.
            "call_id": F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"),
            "k": ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) % 7).cast("int"),
            "s": F.round(F.col("l_discount") * 100, 0),
            "t": F.element_at(F.array(*map(F.lit, ("entry_rights", "pets", "standard_boilerplate"))), (F.col("l_partkey") % 3 + 1).cast("int")),
        }
    )
    even = F.col("l_suppkey") % 2 == 0
    clause = lambda n, text, kind: F.struct(F.lit(n).alias("id"), text.alias("text"), F.lit(kind).alias("type"))
    inputs = (
        F.struct(F.array("t").alias("found_clause_types"), F.when(even, "CA-ON").otherwise("CA-BC").alias("jurisdiction_code")),
        F.struct(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("clause_id"), F.lit("text").alias("clause_text"), F.col("t").alias("clause_type"), F.col("s").alias("risk_score")),
        F.struct(F.col("t").alias("clause_type"), F.col("s").alias("risk_score")),
        F.struct(clause("a", F.when(even, "The landlord may enter.").otherwise("Nothing."), "entry_rights").alias("clause_a"), clause("b", F.lit("No right to sublet."), "pets").alias("clause_b")),
        F.struct(F.lit("Ontario").alias("jurisdiction"), F.array(F.struct(F.lit(1).alias("seq"), F.lit("1").alias("number"), F.lit("utilities").alias("clause_type"), F.when(F.col("s") < 8, F.col("s")).otherwise(F.col("s")).alias("risk_score"), F.lit("text").alias("text"))).alias("analyzed_clauses")),
        F.struct(F.lit(1).alias("x")),
        F.struct(F.lit("CA-ON").alias("jurisdiction_code")),
    )
    given = F.coalesce(*(F.when(F.col("k") == n, F.to_json(x)) for n, x in enumerate(inputs)))
    calls = rows.select("call_id", F.element_at(F.array(*map(F.lit, _NAMED)), F.col("k") + 1).alias("tool"), given.alias("input"))
    benchmarks = rows.select(F.col("t").alias("grp"), F.col("s").alias("x"))
    found = toolset.answers(calls, {toolset.BENCHMARKS: benchmarks}, tuple(dict.fromkeys(n for n in _NAMED if n in toolset.TOOLS)))
    fields = ("error", "coverage_score", "priority", "percentile", "has_contradiction", "overall_risk_level")
    answer = F.coalesce(*(F.get_json_object("output", f"$.{f}") for f in fields))
    return found.select("call_id.l_orderkey", "call_id.l_linenumber", "call_id.l_partkey", "call_id.l_suppkey", "tool", "is_error", answer.alias("answer"))
