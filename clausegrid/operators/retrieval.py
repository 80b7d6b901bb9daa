"""Retrieval: exact vector search, keyword search, and their fusion by reciprocal ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.functions.cleaning import DECISION_STOPS, STATUTE_STOPS, search_words
from clausegrid.functions.texts import tokens
from clausegrid.operators.alignment import first_holders
from clausegrid.operators.cells import _SLACK, _matrix, _products, nearest_by_cells, unit
from clausegrid.sources.tables import written

RRF = 60
K1, B = 1.2, 0.75
DIGITS = 6
#: Queries that are broadcast at once, and such blocks at most; more are searched through cells.
BROADCAST_QUERIES, BLOCKS = 10_000, 16
#: Rows whose products with a block of queries are held at once.
BLOCK_ROWS = 512


def _top(rows: DataFrame, score: Column, k: int, doc: str = "id") -> DataFrame:
    """The k best rows of each query with their rank; ties go to the smaller id."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(score.desc(), F.col(doc)))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def _nearer(k: int, least: float, asked: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over rows (grp, id, u) that keeps the k best for each of the broadcast queries: (group, places, matrix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = {g: (places, vectors, np.full(len(places), least)) for g, places, vectors in asked.value}
        best = None
        for batch in batches:
            grp, u, id_ = batch.column("grp").to_pylist(), _matrix(batch.column("u"), 1), batch.column("id")
            found = [best] if best is not None else []
            for g in set(grp) & groups.keys():
                rows = np.flatnonzero(np.fromiter((x == g for x in grp), bool, len(grp)))
                places, vectors, bars = groups[g]
                for begin in range(0, len(rows), BLOCK_ROWS):
                    at = rows[begin : begin + BLOCK_ROWS]
                    scores = _products(vectors, u[at])
                    if len(at) > k:
                        # What so many rows of this block reach is a bar for all others; the slack keeps what rounds to it.
                        np.maximum(bars, np.partition(scores, len(at) - k, axis=1)[:, len(at) - k] - _SLACK, out=bars)
                    q, n = np.nonzero(scores >= bars[:, None] - _SLACK)
                    cosine = np.round(scores[q, n], DIGITS)
                    sure = cosine >= least
                    found.append(pa.table([pa.array(places[q[sure]]), pa.array(cosine[sure]), id_.take(pa.array(at[n[sure]]))], ["q", "cosine", "id"]))
            if found:
                best = _k_best(pa.concat_tables(found), k)
                q, starts, sizes = np.unique(best.column("q").to_numpy(), return_index=True, return_counts=True)
                worst = dict(zip(q[sizes == k].tolist(), best.column("cosine").to_numpy()[(starts + sizes - 1)[sizes == k]].tolist(), strict=True))
                for places, _, bars in groups.values():
                    np.maximum(bars, [worst.get(x, least) for x in places.tolist()], out=bars)
        if best is not None:
            yield from best.combine_chunks().to_batches()

    return run


def _k_best(found: pa.Table, k: int) -> pa.Table:
    """The k best rows of each q, in order; ties to the smaller id."""
    found = found.sort_by([("q", "ascending"), ("cosine", "descending"), ("id", "ascending")])
    q = found.column("q").to_numpy()
    first = np.flatnonzero(np.diff(q, prepend=-1))
    within = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return found.filter(pa.array(within < k))


def nearest(queries: DataFrame, corpus: DataFrame, k: int, least: float, by_cells: bool = False) -> DataFrame:
    """query_id, id, cosine, rank: the k nearest rows of the query's group with a cosine of ``least`` or more.

    Both need grp and vec; queries have query_id, the corpus id. Queries are
    broadcast in blocks while they are few; a task takes the products of its rows
    with a block as matrices and passes on only the k best of each query, so that
    pairs are neither rows nor shuffled. More queries, or if ``by_cells`` says
    so, are searched through cells with bounds, to the same result.
    """
    asked = unit(queries, ["query_id", "grp"])
    if by_cells or queries.limit(BLOCKS * BROADCAST_QUERIES + 1).count() > BLOCKS * BROADCAST_QUERIES:
        return nearest_by_cells(queries, corpus, k, least)[0]
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // BROADCAST_QUERIES))
    rows = unit(corpus.select("grp", "id", "vec").repartition(spark.sparkContext.defaultParallelism, "id"), ["grp", "id"])
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((asked, "query_id"), (rows, "id"))}
    out = []
    for n in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).toArrow()
        vectors = _matrix(block.column("u"), 1)
        grp = block.column("grp").to_pylist()
        of = {g: np.flatnonzero(np.fromiter((x == g for x in grp), bool, len(grp))) for g in set(grp) - {None}}
        shared = spark.sparkContext.broadcast([(g, places, vectors[places]) for g, places in of.items()])
        names = spark.createDataFrame(pa.table([pa.array(np.arange(len(grp))), block.column("query_id")], ["q", "query_id"]), f"q long, query_id {kinds['query_id']}")
        best = rows.mapInArrow(_nearer(k, least, shared), f"q long, cosine double, id {kinds['id']}")
        out.append(best.join(F.broadcast(names), "q").select("query_id", "id", "cosine"))
    return _top(reduce(DataFrame.unionByName, out), F.col("cosine"), k)


def matching_all(docs: DataFrame, words: list[str]) -> DataFrame:
    """Documents that hold all the words as tokens."""
    return docs.where(F.size(F.array_except(F.array(*(F.lit(w) for w in words)), tokens(F.col("text")))) == 0)


def bm25(docs: DataFrame, queries: dict[int, list[str]], k: int) -> DataFrame:
    """query_id, id, score, rank: the k best documents that hold all words of the query. Needs id and text.

    Only the queries' words are exploded; lengths and document counts come
    from the same pass over the tokens.
    """
    spark = docs.sparkSession
    words = spark.createDataFrame([(q, w) for q, ws in queries.items() for w in sorted(set(ws))], "query_id int, word string")
    sizes = spark.createDataFrame([(q, len(set(ws))) for q, ws in queries.items()], "query_id int, n_words int")
    every = sorted({w for ws in queries.values() for w in ws})
    read = docs.select("id", tokens(F.col("text")).alias("t")).select("id", F.size("t").alias("dl"), F.filter("t", lambda w: w.isin(*every)).alias("hits"))
    stats = read.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    tf = read.where(F.size("hits") > 0).select("id", "dl", F.explode("hits").alias("word")).groupBy("id", "dl", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    joined = tf.join(F.broadcast(df), "word").join(F.broadcast(words), "word").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = joined.groupBy("query_id", "id").agg(F.round(F.sum(part), DIGITS).alias("score"), F.count(F.lit(1)).alias("found"))
    whole = scored.join(F.broadcast(sizes), "query_id").where(F.col("found") == F.col("n_words")).drop("found", "n_words")
    return _top(whole, F.col("score"), k)


def hybrid(vectors: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank from two ranked lists: 0.7 of the scaled reciprocal ranks and 0.3 of the cosine.

    A row that only the text list has counts with cosine 0. Both lists need
    query_id, id, rank; the vectors also cosine.
    """
    v = vectors.select("query_id", "id", F.col("rank").alias("vr"), "cosine")
    t = texts.select("query_id", "id", F.col("rank").alias("tr"))
    both = v.join(t, ["query_id", "id"], "full")
    share = lambda r: F.coalesce(1.0 / (RRF + F.col(r)), F.lit(0.0))
    fused = (share("vr") + share("tr")) * (RRF + 1) / 2
    score = F.round(0.7 * fused + 0.3 * F.coalesce("cosine", F.lit(0.0)), 4)
    return _top(both.select("query_id", "id", score.alias("score")), F.col("score"), k)


def fused(lists: DataFrame, n_lists: int, k: int) -> DataFrame:
    """query_id, id, score, rank over several ranked lists (query_id, list, id, rank, score): ranks and the best score blended."""
    per = lists.groupBy("query_id", "id").agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("rrf"), F.max("score").alias("best"))
    score = F.round(0.7 * F.col("rrf") / (n_lists / (RRF + 1.0)) + 0.3 * F.col("best"), 4)
    return _top(per.select("query_id", "id", score.alias("score")), F.col("score"), k)


# What to look for in statutes, by clause type.
QUERY_PHRASES = {
    "rent_payment": "rent payment obligation due date monthly non-refundable deposit fee prohibited additional charge late penalty Ontario RTA section 12 105 106 134",
    "rent_increase": "rent increase notice guideline percentage cap Ontario RTA section 116 120 128",
    "security_deposit": "security deposit last month rent key deposit limit refund Ontario RTA section 105 106",
    "entry_rights": "landlord entry written notice 24 hours tenant consent emergency Ontario RTA section 26 27",
    "maintenance_repairs": "maintenance repairs good repair habitable standard landlord obligation Ontario RTA section 20 29",
    "subletting_assignment": "subletting assignment sublet consent unreasonably withheld Ontario RTA section 97 98",
    "early_termination": "early termination notice grounds eviction Ontario RTA section 37 38 44 48 60 61",
    "renewal_terms": "lease renewal automatic month-to-month tenancy continuation Ontario RTA section 95 96",
    "utilities": "utilities heat water electricity included rental unit obligation Ontario RTA",
    "pets": "pets no-pet clause void unenforceable Ontario RTA section 14",
    "alterations": "alterations improvements restoration tenant obligation consent Ontario RTA",
    "quiet_enjoyment": "quiet enjoyment interference substantial interference harassment Ontario RTA section 22 23",
    "liability_indemnification": "liability indemnification waiver release tenant rights Ontario RTA",
    "dispute_resolution": "dispute resolution Landlord Tenant Board application hearing Ontario RTA",
    "parking_storage": "parking storage locker additional services fee Ontario RTA",
    "guest_policy": "guest occupant visitor overnight policy additional charge surcharge fee prohibited Ontario RTA section 134",
    "standard_boilerplate": "standard lease terms Ontario RTA Residential Tenancies Act form",
    "unknown": "Ontario Residential Tenancies Act tenant landlord rights obligations",
}
KEYWORD_SCORE, DECISION_KEYWORD_SCORE, FEW_HITS = 0.3, 0.25, 2


def built_queries(clauses: DataFrame) -> DataFrame:
    """query_id, list (1 to 3) and asked: a clause's own text, its type as a risk, and the phrase for its type. Needs query_id, clause_type, text."""
    kind = F.regexp_replace("clause_type", "_", " ")
    phrases = F.create_map(*(F.lit(x) for kv in QUERY_PHRASES.items() for x in kv))
    own = F.substring("text", 1, 1000)
    risk = F.substring(F.concat(kind, F.lit(" "), kind, F.lit(" tenant rights Ontario lease")), 1, 500)
    typed = F.coalesce(F.element_at(phrases, F.col("clause_type")), F.concat(kind, F.lit(" Ontario Residential Tenancies Act")))
    return clauses.select("query_id", F.posexplode(F.array(own, risk, typed)).alias("list", "asked")).withColumn("list", F.col("list") + 1)


def nearest_since(queries: DataFrame, corpus: DataFrame, k: int, least: float, floor: str | None = None) -> DataFrame:
    """As nearest through cells, over rows not older than ``floor``; None asks all. The corpus needs day."""
    return nearest(queries, corpus if floor is None else corpus.where(F.col("day") >= F.lit(floor).cast("date")), k, least, by_cells=True)


def keyword_hits(queries: DataFrame, corpus: DataFrame, k: int, decisions: bool = False) -> DataFrame:
    """query_id, id, score, rank of rows that hold any of a query's search words; ties to the smaller id. Needs query_id, grp, asked; id, grp, text.

    The words of all queries are searched for at once; the first k rows of each
    group and word then meet the queries, whose words are made once and written.
    """
    words = search_words(F.col("asked"), DECISION_STOPS, 4, 4, once=False) if decisions else search_words(F.col("asked"), STATUTE_STOPS)
    asked = written(queries.select("query_id", "grp", F.explode(words).alias("key")), "asked")
    # All scores are equal, so that a query's first rows are among the first of its words.
    first = first_holders(corpus.select("grp", "id", F.lower("text").alias("text")), asked, k)
    found = first.join(asked, ["grp", "key"])
    score = DECISION_KEYWORD_SCORE if decisions else KEYWORD_SCORE
    return _top(found.select("query_id", "id").distinct().withColumn("score", F.lit(score)), F.col("score"), k)


def topped_up(found: DataFrame, fallback: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank, fallback: results, and for queries with fewer than FEW_HITS also fallback rows that they lack, k in all."""
    few = queries.select("query_id").distinct().join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < FEW_HITS).select("query_id")
    more = fallback.join(few, "query_id", "left_semi").join(found.select("query_id", "id"), ["query_id", "id"], "left_anti")
    both = found.select("query_id", "id", "score", F.lit(False).alias("fallback"), F.col("rank").alias("place")).unionByName(more.select("query_id", "id", "score", F.lit(True).alias("fallback"), F.col("rank").alias("place")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("fallback", "place"))
    return both.withColumn("rank", place).where(F.col("rank") <= k).drop("place")


def retrieval_confidence(results: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id and confidence: a tenth over the mean score and 0.95 at most; 0.5 with fallback rows, 0.3 where the search had failed too, 0 without any row.

    Queries may say with ``failed`` that their vectors could not be made.
    """
    per = results.groupBy("query_id").agg(F.avg("score").alias("mean"), F.max(F.col("fallback").cast("int")).alias("fell"))
    failed = F.coalesce(F.max("failed"), F.lit(False)) if "failed" in queries.columns else F.lit(False)
    sure = F.when(F.col("mean").isNull(), 0.0).when((F.col("fell") == 1) & F.col("failed"), 0.3).when(F.col("fell") == 1, 0.5).otherwise(F.least(F.lit(0.95), F.col("mean") + 0.1))
    asked = queries.groupBy("query_id").agg(failed.alias("failed"))
    return asked.join(per, "query_id", "left").select("query_id", (F.floor(sure * 100 + 0.5) / 100).alias("confidence"))


def with_details(ranked: DataFrame, corpus: DataFrame, columns: list[str]) -> DataFrame:
    """Ranked rows with wide columns of the corpus, which are joined after the ranking only."""
    return ranked.join(corpus.select("id", *columns), "id")
