"""Queries of lookups: every hundredth vector asks in three lists, over vectors and the documents of the same ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.operators import lookups, retrieval
from clausegrid.plans.queries import _ASKED, _COS, _bm25_sql, _index, query
from clausegrid.sources import tables

_SINCE = "2024-06-01"
_WORDS = [" ".join(ws) for ws in _ASKED.values()]


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hundredth vector and the two after it as lists 1 to 3, with one of three word queries each."""
    words = F.element_at(F.array(*map(F.lit, _WORDS)), F.expr("cast((vec_id div 100 + vec_id % 100) % 3 + 1 as int)"))
    v = tables.table(spark, sf_dir, "embeddings").where("vec_id % 100 < 3")
    return v.select(F.expr("vec_id - vec_id % 100").alias("query_id"), (F.col("vec_id") % 100 + 1).cast("int").alias("list"), F.lit("all").alias("grp"), F.col("embedding").alias("vec"), words.alias("asked"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    day = F.expr("date_add(date'2024-01-01', cast(vec_id % 200 as int))")
    v = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("all").alias("grp"), F.col("embedding").alias("vec"), day.alias("day"))
    return v.join(texts, "id", "left")


def _near_sql(name: str, k: int, least: float, where: str = "true") -> str:
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY cosine DESC, id) AS rank FROM (
      SELECT a.vec_id - a.vec_id % 100 AS query_id, a.vec_id % 100 + 1 AS list, b.vec_id AS id, round({_COS}, 6) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 100 < 3 AND {where})
    WHERE cosine >= {least}) WHERE rank <= {k})"""


def _fused_sql(lists: str, score: str, k: int) -> str:
    return f"""
  SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT query_id, id, round(0.7 * sum(CAST(1.0 AS DOUBLE) / (60 + rank)) / (3 / CAST(61 AS DOUBLE)) + 0.3 * max({score}), 4) AS score FROM {lists} GROUP BY query_id, id)) WHERE rank <= {k}"""


@query(f"""
WITH {_near_sql("v", 15, 0.1)}, {_bm25_sql(15)},
a AS (SELECT vec_id - vec_id % 100 AS query_id, vec_id % 100 + 1 AS list, (vec_id // 100 + vec_id % 100) % 3 AS asked FROM embeddings WHERE vec_id % 100 < 3),
x AS (SELECT a.query_id, a.list, t.id, t.rank FROM t JOIN a ON a.asked = t.query_id),
h AS (SELECT coalesce(v.query_id, x.query_id) AS query_id, coalesce(v.list, x.list) AS list, coalesce(v.id, x.id) AS id,
             round(0.7 * (CAST(coalesce(1.0 / (60 + v.rank), 0) AS DOUBLE) + CAST(coalesce(1.0 / (60 + x.rank), 0) AS DOUBLE)) * 61 / 2 + 0.3 * coalesce(v.cosine, 0), 4) AS score
      FROM v FULL JOIN x ON v.query_id = x.query_id AND v.list = x.list AND v.id = x.id),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY score DESC, id) AS rank FROM h) WHERE rank <= 5),
z AS ({_fused_sql("l", "score", 5)})
SELECT query_id, id, score, rank FROM z""")
def statute_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hybrid lists for each query, fused; the bar is low, since the vectors have nothing to do with the words."""
    found = lookups.statutes(_asked(spark, sf_dir), _corpus(spark, sf_dir), _index(spark, sf_dir), least=0.1)
    return found.select("query_id", "id", "score", "rank")


_LOW = "lower(coalesce(text, ''))"


@query(f"""
WITH {_near_sql("r", 5, 0.3, "b.vec_id % 200 >= 152")}, {_near_sql("o", 5, 0.3)},
fr AS ({_fused_sql("r", "cosine", 5)}),
fo AS ({_fused_sql("o", "cosine", 5)}),
q AS (SELECT DISTINCT vec_id - vec_id % 100 AS query_id FROM embeddings WHERE vec_id % 100 < 3),
few AS (SELECT q.query_id FROM q LEFT JOIN fr ON fr.query_id = q.query_id GROUP BY q.query_id HAVING count(fr.id) < 2),
u AS (SELECT query_id, id, score, rank, 0 AS step FROM fr UNION ALL
      SELECT query_id, id, score, rank, 1 FROM fo WHERE query_id IN (SELECT query_id FROM few) AND (query_id, id) NOT IN (SELECT (query_id, id) FROM fr))
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank, step FROM (SELECT query_id, id, score, step, row_number() OVER (PARTITION BY query_id ORDER BY step, rank) AS rank FROM u) WHERE rank <= 5""")
def decision_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent decisions over three lists, fused, and older ones where they are few."""
    found = lookups.decisions(_asked(spark, sf_dir), _corpus(spark, sf_dir), _SINCE, least=0.3)
    return found.where("step < 2").select("query_id", "id", "score", "rank", "step")


@query(f"""
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS}, 6) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM s WHERE cosine >= 0.6) WHERE rank <= 5),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM s WHERE cosine >= 0.45) WHERE rank <= 3),
t AS (SELECT e.vec_id AS id, coalesce(text, '') AS text FROM embeddings e LEFT JOIN documents ON doc_id = vec_id)
SELECT query_id, 'statute' AS source, l.id, CAST(rank AS INTEGER) AS rank, md5(left(text, 600)) AS digest FROM l JOIN t ON t.id = l.id
UNION ALL SELECT query_id, 'decision', d.id, CAST(rank AS INTEGER), md5(left(text, 400)) FROM d JOIN t ON t.id = d.id""")
def chat_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every hundredth vector's chat is answered from, by vectors alone."""
    corpus = _corpus(spark, sf_dir)
    found = lookups.chat_context(_asked(spark, sf_dir).where("list = 1").drop("list"), corpus, None, corpus)
    return found.select("query_id", "source", "id", "rank", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""
WITH d AS (SELECT doc_id AS id, lower(coalesce(text, '')) AS low FROM documents),
q AS (SELECT item_id AS query_id, list_slice(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 4 AND w NOT IN ('the', 'a', 'an', 'and', 'or', 'in', 'on', 'to', 'of', 'with', 'tenant', 'landlord', 'lease', 'agreement')), 1, 4) AS words FROM benchmark),
h AS (SELECT DISTINCT query_id, id FROM (SELECT query_id, unnest(words) AS w FROM q) JOIN d ON contains(low, w))
SELECT query_id, id, CAST(0.25 AS DOUBLE) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY id) AS INTEGER) AS rank FROM h) WHERE rank <= 5""")
def decision_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first documents that hold any of the search words of every benchmark text, by the rule for decisions."""
    asked = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(0).alias("grp"), F.col("text").alias("asked"))
    corpus = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(0).alias("grp"), F.coalesce("text", F.lit("")).alias("text"))
    return retrieval.keyword_hits(asked, corpus, 5, decisions=True)
