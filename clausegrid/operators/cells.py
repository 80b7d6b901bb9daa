"""Exact nearest vectors through cells with bounds.

Vectors are scaled to length one and put into the cell of their nearest center.
A cell knows its center and the widest angle of its vectors to it, so that the
cosine of a query to any of them is at most the cosine of the angle that is left.
A query first searches the cell that promises most, which gives it a k-th best
cosine, and then only the cells whose bound reaches that. A cell's vectors are
dealt into chunks and its queries into sets of bounded size; a set and a chunk
meet in one task, as a product of two matrices. No step pairs all queries with
all vectors, however many there are of either.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.sources.tables import cut

#: Centers, which are vectors themselves: those with the smallest hashes of their ids.
CENTERS = 64
#: Vectors of a chunk and queries of a set.
CHUNK, SET = 4096, 1024
DIGITS = 6
#: Cosines are compared after rounding, so that bounds get this much more.
_SLACK = 1e-6


def unit(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and u, the vector in double precision scaled to length one; vectors that are null, hold nulls, are not finite or have no length are left out. Needs vec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column("vec").cast(pa.list_(pa.float64()))
            sizes = pc.fill_null(pc.list_value_length(vec), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(vec.flatten(), float("nan")).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            with np.errstate(over="ignore", invalid="ignore"):
                length = np.sqrt(np.bincount(row, flat * flat, len(sizes)))
            sound = np.isfinite(length) & (length > 0)
            kept = sound[row]
            u = flat[kept] / length[row[kept]]
            offsets = np.concatenate(([0], np.cumsum(sizes[sound]))).astype(np.int32)
            chosen = b.select(keep).filter(pa.array(sound))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.ListArray.from_arrays(offsets, u)], [*keep, "u"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "vec").mapInArrow(run, f"{schema}, u array<double>")


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows; shorter ones are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), max(width, int(sizes.max(initial=0)))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _widened(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1]))) if a.shape[1] < width else a


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    width = max(a.shape[1], b.shape[1])
    return _widened(a, width) @ _widened(b, width).T


def in_cells(corpus: DataFrame, centers: int = CENTERS) -> tuple[DataFrame, np.ndarray]:
    """grp, id, u, cell and near (the cosine to the cell's center) of a corpus (grp, id, vec), and the centers.

    The centers are a bounded number of the corpus's own vectors; every vector
    is put into a cell. They only say what is searched first, not what is found.
    """
    rows = unit(corpus, ["grp", "id"])
    chosen = [r["u"] for r in rows.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(centers).collect()]
    width = max(map(len, chosen), default=1)
    held = np.array([u + [0.0] * (width - len(u)) for u in chosen]).reshape(len(chosen), width)
    shared = corpus.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = _products(_matrix(b.column("u"), 1), shared.value)
            cell = near.argmax(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(near[np.arange(len(cell)), cell])], [*b.schema.names, "cell", "near"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return (rows.mapInArrow(run, f"{schema}, cell int, near double") if chosen else rows.withColumns({"cell": F.lit(0), "near": F.lit(1.0)})), held


def _promises(held: np.ndarray, least: float, key: tuple, queries: pa.Table, cells: pa.Table) -> pa.Table:
    """For each query its cells by falling bound, those that promise ``least`` or more."""
    names = ["query_id", "grp", "u", "cells"]
    which, radius = cells.column("cell").to_numpy(), np.arccos(np.clip(cells.column("near").to_numpy(), -1, 1))
    angle = np.arccos(np.clip(_products(_matrix(queries.column("u"), 1), held[which]), -1, 1))
    bound = np.cos(np.maximum(0, angle - radius)) + _SLACK
    order = np.argsort(-bound, axis=1, kind="stable")
    ranked = np.take_along_axis(bound, order, 1)
    lists = [[{"cell": int(c), "bound": float(b)} for c, b in zip(which[o], r, strict=True) if b >= least] for o, r in zip(order, ranked, strict=True)]
    kind = pa.list_(pa.struct([("cell", pa.int32()), ("bound", pa.float64())]))
    return pa.table([queries.column("query_id"), queries.column("grp"), queries.column("u"), pa.array(lists, kind)], names)


def _best(k: int, least: float, key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
    """The k best rows of a chunk for each query of a set."""
    ids = rows.column("id").combine_chunks()
    if not queries.num_rows or not rows.num_rows:
        return pa.table([pa.array([], queries.schema.field("query_id").type), ids.slice(0, 0), pa.array([], pa.float64())], ["query_id", "id", "cosine"])
    scores = np.round(_products(_matrix(queries.column("u"), 1), _matrix(rows.column("u"), 1)), DIGITS)
    place = np.argsort(pc.array_sort_indices(ids).to_numpy(), kind="stable")
    order = np.lexsort((np.broadcast_to(place, scores.shape), -scores), axis=-1)[:, :k]
    found = np.take_along_axis(scores, order, 1)
    q, n = np.nonzero(found >= least)
    return pa.table([queries.column("query_id").take(pa.array(q)), ids.take(pa.array(order[q, n])), pa.array(found[q, n])], ["query_id", "id", "cosine"])


def _search(wanted: DataFrame, rows: DataFrame, chunks: DataFrame, k: int, least: float) -> DataFrame:
    """query_id, id, cosine of the k best in each (query, cell, chunk) of ``wanted`` (query_id, grp, u, cell)."""
    sets = wanted.groupBy("grp", "cell").agg(F.ceil(F.count(F.lit(1)) / SET).cast("int").alias("sets")).join(chunks, ["grp", "cell"])
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = wanted.join(sets, ["grp", "cell"]).select("grp", "cell", deal("query_id", "sets").alias("set"), every("chunks").alias("chunk"), "query_id", "u")
    right = rows.join(sets, ["grp", "cell"]).select("grp", "cell", every("sets").alias("set"), deal("id", "chunks").alias("chunk"), "id", "u")
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    by = ("grp", "cell", "set", "chunk")
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(partial(_best, k, least), f"query_id {kind(wanted, 'query_id')}, id {kind(rows, 'id')}, cosine double")


def nearest_by_cells(queries: DataFrame, corpus: DataFrame, k: int, least: float, centers: int = CENTERS) -> tuple[DataFrame, DataFrame]:
    """The k nearest rows of each query's group, and what was searched for it.

    The first frame has query_id, id, cosine (six digits), rank, ties to the
    smaller id; the second query_id, cells (that its group has) and searched.
    Needs query_id, grp, vec and id, grp, vec; ids of a group are unique.
    Vectors that are null, hold a null or have no length are not found and find
    nothing; shorter ones count as filled up with zeros.
    """
    from clausegrid.operators.retrieval import _top

    placed, held = in_cells(corpus, centers)
    rows = cut(placed)
    cells = rows.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near"))
    chunks = cells.select("grp", "cell", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    asked = unit(queries, ["query_id", "grp"])
    sets = asked.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / SET).cast("int").alias("sets"))
    left = asked.join(sets, "grp").select("query_id", "grp", "u", F.pmod(F.xxhash64("query_id"), F.col("sets")).cast("int").alias("set"))
    right = cells.join(sets, "grp").select("grp", "cell", "near", F.explode(F.sequence(F.lit(0), F.col("sets") - 1)).alias("set"))
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    kind = lambda c: asked.schema[c].dataType.simpleString()
    schema = f"query_id {kind('query_id')}, grp {kind('grp')}, u array<double>, cells array<struct<cell:int,bound:double>>"
    promised = cut(left.groupBy("grp", "set").cogroup(right.groupBy("grp", "set")).applyInArrow(partial(_promises, held, least), schema))

    first = promised.where(F.size("cells") > 0).select("query_id", "grp", "u", F.col("cells")[0]["cell"].alias("cell"))
    home = cut(_search(first, rows, chunks, k, least))
    kth = _top(home, F.col("cosine"), k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("kth"))
    reach = F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(least))
    others = promised.join(kth, "query_id", "left").select("query_id", "grp", "u", F.filter(F.slice("cells", 2, held.shape[0] + 1), lambda c: c["bound"] >= reach).alias("cells"))
    more = _search(others.select("query_id", "grp", "u", F.explode("cells.cell").alias("cell")), rows, chunks, k, least)
    found = _top(home.unionByName(more), F.col("cosine"), k)
    searched = others.join(cells.groupBy("grp").agg(F.count(F.lit(1)).alias("cells_of")), "grp")
    report = searched.select("query_id", F.col("cells_of").alias("cells"), (F.size("cells") + 1).alias("searched"))
    return found.select("query_id", "id", "cosine", "rank"), report
