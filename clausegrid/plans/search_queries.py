"""Queries of the inverted index and of cells of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.operators import cells
from clausegrid.plans.queries import _TOKENS, _index, query
from clausegrid.sources import tables


def _openings(spark: SparkSession, sf_dir: str, words: int) -> DataFrame:
    """query_id and asked: the first words of every benchmark text."""
    return tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, words), " ").alias("asked"))


@query(f"""
WITH d AS (SELECT doc_id AS id, {_TOKENS} AS t FROM documents),
q AS (SELECT item_id AS query_id, {_TOKENS} AS w FROM (SELECT item_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS text FROM benchmark)),
s AS (SELECT *, ' ' || array_to_string(t, ' ') || ' ' AS s FROM d),
c AS (SELECT query_id, id, t, w FROM s, q WHERE len(w) > 0 AND contains(s, ' ' || array_to_string(w, ' ') || ' ')),
n AS (SELECT query_id, id, len(list_filter(range(1, len(t) - len(w) + 2), lambda i: t[i:i + len(w) - 1] = w)) AS n FROM c)
SELECT query_id, id, n FROM n WHERE n > 0""")
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where and how often the first three words of every benchmark text stand in a row."""
    return _index(spark, sf_dir).phrase(_openings(spark, sf_dir, 3)).select("query_id", "id", "n")


@query()
def english_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents that hold the stems of the first four words of every benchmark text, stop words left out."""
    return _index(spark, sf_dir, english=True).bm25(_openings(spark, sf_dir, 4), 10).select("query_id", "id", "score", "rank")


@query()
def cells_searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells of vectors there are for every hundredth vector, and how many its five nearest needed."""
    v = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("grp"))
    return cells.nearest_by_cells(v.where("id % 100 = 0").withColumnRenamed("id", "query_id"), v, 5, 0.1)[1]
