"""Exact top-k inner products by block-at-a-time pruning.

Vectors are integers, a dimension is a term. Candidates are dealt into groups
of bounded size, queries too, and every pair of groups is one task. In a task
the candidates are ranged by their nearest pivot and cut into blocks, each with
the greatest and least value of every term. The sum of the terms' extremes
bounds what a query can score in a block. A query takes its blocks by falling
bound, scores one at a time through the block's own rows, and stops at the
first bound below its k-th best score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCALE = 1024
K = 10
QUERY_EVERY = 100
#: Rows in a group of candidates, a group of queries, and a block.
CANDIDATES = 4096
QUERIES = 2048
BLOCK = 64
PIVOTS = 32


def _scaled(x: Column) -> Column:
    """A component times SCALE, rounded down."""
    large = F.raise_error(F.lit("a component is too large for integer scores"))
    return F.when(F.abs(x) < float(1 << 42), F.floor(x.cast("double") * SCALE).cast("long")).otherwise(large.cast("long"))


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the components times SCALE rounded down; rows with a null or non-finite part are left out."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    return sound.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", _scaled).alias("x"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows, short ones filled up with zeros."""
    column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _width(*columns: pa.ChunkedArray) -> int:
    return max((int(np.diff(c.combine_chunks().offsets.to_numpy()).max(initial=0)) for c in columns), default=0)


def best_of(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores and ids of the k best rows of each query, ties to smaller ids, and which are real; the rest fill up.

    Sums that may leave 64 bits are made of Python's integers.
    """
    greatest = max(1, int(np.abs(queries).max(initial=0))) * max(1, int(np.abs(rows).max(initial=0))) * (rows.shape[1] or 1)
    kind = np.float64 if greatest < 2**52 else np.int64 if greatest < 2**62 else object
    q, x = queries.astype(kind), rows.astype(kind)
    by = np.argsort(ids, kind="stable")
    pivots = x[by][:: max(1, len(x) // PIVOTS)][:PIVOTS]
    by = by[np.argsort((x[by] @ pivots.T).argmax(axis=1), kind="stable")]
    x, ids = x[by], ids[by]
    edges = np.arange(0, len(x), BLOCK)
    high, low = np.maximum.reduceat(x, edges), np.minimum.reduceat(x, edges)
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    ranked = np.argsort(-bounds, axis=1, kind="stable")
    worst = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
    scores, found = np.full((len(q), k), worst, kind), np.full((len(q), k), -1, np.int64)
    active = np.arange(len(q))
    for turn in range(len(edges)):
        block = ranked[active, turn]
        open_ = (bounds[active, block] >= scores[active, -1]) | (found[active, -1] < 0)
        active, block = active[open_], block[open_]
        if not len(active):
            break
        for b in np.unique(block).tolist():
            who = active[block == b]
            place = np.arange(edges[b], min(edges[b] + BLOCK, len(x)))
            new = q[who] @ x[place].T
            places = np.where(ids[place] == query_ids[who][:, None], -1, place)
            all_scores, all_places = np.hstack((scores[who], new)), np.hstack((found[who], places))
            ranks = all_scores if kind is not object else np.unique(all_scores, return_inverse=True)[1].reshape(all_scores.shape)
            order = np.lexsort((ids[all_places], -ranks, all_places < 0), axis=-1)[:, :k]
            scores[who], found[who] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_places, order, 1)
    return scores, ids[found], found >= 0


def top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query by integer inner product.

    Queries are the rows whose vec_id is divisible by ``every``; a row is no
    candidate for its own vec_id. Where lengths differ, missing components
    count as zero. Rows that repeat a vec_id take part each; of queries that do
    the one with the smallest vector, component by component, is asked. An empty
    table gives an empty result. Components of 2**42 or more are an error, and so
    are scores among the best that a long cannot hold; all others are exact.
    """
    own = quantized(vectors)
    asked = own.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    total, queries = vectors.count(), vectors.where(F.col("vec_id") % every == 0).count()
    parts, sets = max(1, -(-total // CANDIDATES)), max(1, -(-queries // QUERIES))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    left = asked.select(deal(sets, 1).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), "vec_id", "x")
    right = own.select(F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("s"), F.pmod(F.xxhash64("vec_id", F.lit(2), "x"), F.lit(parts)).cast("int").alias("p"), "vec_id", "x")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        width = _width(a.column("x"), b.column("x"))
        q, c = _matrix(a.column("x"), width), _matrix(b.column("x"), width)
        asked_ids = a.column("vec_id").to_numpy()
        scores, found, real = best_of(q, asked_ids, c, b.column("vec_id").to_numpy(), k)
        best = scores[real].tolist()
        if best and not -(2**63) <= min(best) <= max(best) < 2**63:
            raise ValueError("a score does not fit into 64 bits")
        return pa.table([pa.array(np.repeat(asked_ids, k)[real.ravel()]), pa.array(found[real]), pa.array([int(x) for x in best], pa.int64())], names)

    near = left.groupBy("s", "p").cogroup(right.groupBy("s", "p")).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The rows of top_k() with its defaults.
TOP_K_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {K}
"""
