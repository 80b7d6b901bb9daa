"""Lookups as an analysis makes them: several searches a clause, fused, with fallbacks.

A clause asks in lists: the same clause put in several ways, each with a vector
and words. All clauses and all lists are searched at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.operators import retrieval
from clausegrid.operators.postings import Postings

#: Least cosines of statutes in a hybrid and a pure vector search, and of decisions.
HYBRID, VECTOR, DECISION = 0.55, 0.60, 0.45
#: Results, and results of a chat from statutes and decisions with the signs of their texts that are kept.
FOUND, CHAT = 5, ((5, 600), (3, 400))
#: Lists of a query, at most; a search's key is its query's id and list in one number.
LISTS = 8


def _each(queries: DataFrame) -> DataFrame:
    """Queries (query_id, list, ...) with a key for each search in place of their id."""
    return queries.withColumn("query_id", F.col("query_id") * LISTS + F.col("list"))


def _of_lists(ranked: DataFrame) -> DataFrame:
    return ranked.withColumns({"list": F.col("query_id") % LISTS, "query_id": F.expr(f"query_id div {LISTS}")})


def hybrid_lists(queries: DataFrame, corpus: DataFrame, index: Postings, k: int, least: float = HYBRID) -> DataFrame:
    """query_id, list, id, score, rank: the k best of each list by vector and words together.

    Queries need query_id (a number), list, grp, vec, asked; the corpus id, grp,
    vec; the index the same ids. Both searches give three times k.
    """
    each = _each(queries)
    near = retrieval.nearest(each.select("query_id", "grp", "vec"), corpus.select("id", "grp", "vec"), 3 * k, least)
    words = index.bm25(each.select("query_id", "asked"), 3 * k)
    return _of_lists(retrieval.hybrid(near, words, k))


def vector_lists(queries: DataFrame, corpus: DataFrame, k: int, least: float, since: str | None = None) -> DataFrame:
    """query_id, list, id, score, rank: the k nearest of each list, ``since`` a day if one is given; the corpus then needs day."""
    rows = corpus if since is None else corpus.where(F.col("day") >= F.lit(since).cast("date"))
    near = retrieval.nearest(_each(queries).select("query_id", "grp", "vec"), rows.select("id", "grp", "vec"), k, least)
    return _of_lists(near.withColumnRenamed("cosine", "score"))


def statutes(queries: DataFrame, corpus: DataFrame, index: Postings | None, n_lists: int = 3, k: int = FOUND, least: float | None = None) -> DataFrame:
    """query_id, id, score, rank, fallback: the k best statutes of each query over its lists, filled up by words where they are few.

    Without an index the lists are those of vectors alone. The last list's words
    are looked for where fewer than two are found; such rows have score 0.3.
    Queries need query_id, list, grp, vec, asked; the corpus id, grp, vec, text.
    """
    lists = vector_lists(queries, corpus, k, VECTOR if least is None else least) if index is None else hybrid_lists(queries, corpus, index, k, HYBRID if least is None else least)
    found = retrieval.fused(lists, n_lists, k)
    last = F.max("list").over(Window.partitionBy("query_id"))
    words = queries.withColumn("_last", last).where("list = _last").select("query_id", "grp", "asked")
    return retrieval.topped_up(found, retrieval.keyword_hits(words, corpus, k), words, k)


def decisions(queries: DataFrame, corpus: DataFrame, since: str, n_lists: int = 3, k: int = FOUND, least: float = DECISION) -> DataFrame:
    """query_id, id, score, rank and step: the k best decisions of each query: recent ones, then older ones, then by words.

    Step 0 are those since the day given; where they are fewer than two, step 1
    fills up with what all days give and they lack. A query that has none then
    gets step 2: those that hold its words, with score 0.25. Queries need
    query_id, list, grp, vec, asked; the corpus id, grp, vec, text, day.
    """
    recent = retrieval.fused(vector_lists(queries, corpus, k, least, since), n_lists, k)
    asked = queries.select("query_id").distinct()
    few = asked.join(recent.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < retrieval.FEW_HITS).select("query_id")
    older = retrieval.fused(vector_lists(queries.join(few, "query_id", "left_semi"), corpus, k, least), n_lists, k)
    older = older.join(recent.select("query_id", "id"), ["query_id", "id"], "left_anti")
    columns = lambda df, step: df.select("query_id", "id", "score", "rank", F.lit(step).alias("step"))
    both = columns(recent, 0).unionByName(columns(older, 1))
    none = queries.join(both.select("query_id").distinct(), "query_id", "left_anti").where("list = 1").select("query_id", "grp", "asked")
    both = both.unionByName(columns(retrieval.keyword_hits(none, corpus, k, decisions=True), 2))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("step", "rank"))
    return both.withColumn("rank", place).where(F.col("rank") <= k)


def chat_context(queries: DataFrame, laws: DataFrame, index: Postings | None, cases: DataFrame) -> DataFrame:
    """query_id, source (statute or decision), id, rank and text: what a chat answers from, texts cut to 600 and 400 signs.

    Statutes by vector and words, or without an index by vector alone with a
    higher bar; decisions by vector. Queries need query_id, grp, vec, asked.
    """
    one = queries.withColumn("list", F.lit(1))
    (k_law, law_signs), (k_case, case_signs) = CHAT
    found = vector_lists(one, laws, k_law, VECTOR) if index is None else hybrid_lists(one, laws, index, k_law, HYBRID)
    by_case = vector_lists(one, cases, k_case, DECISION)
    texts = lambda ranked, corpus, name, signs: ranked.select("query_id", "id", "rank").join(corpus.select("id", F.substring(F.coalesce("text", F.lit("")), 1, signs).alias("text")), "id").select("query_id", F.lit(name).alias("source"), "id", "rank", "text")
    return texts(found, laws, "statute", law_signs).unionByName(texts(by_case, cases, "decision", case_signs))
