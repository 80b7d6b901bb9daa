"""Compression of vectors to one byte a part, by codebooks of integers.

Components are integers, vectors are cut into consecutive parts, and each part
position has a codebook that starts as the parts of the first vectors. In each
round the codebooks, whose size is fixed, are broadcast; a task works on Arrow
batches, takes all squared distances by the expansion |x|^2 - 2xc + |c|^2 with
int64 matrix products, and gives one row of sums for each entry that it used.
Those rows are summed by a grouped shuffle, and each entry becomes the mean of
its parts, rounded down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import cut

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Vectors whose distances are held at once.
_ROWS = 2048


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id, label and x, the components times SCALE rounded down; rows whose vector is null or holds a null or non-finite part are left out.

    Components of 2**42 or more are an error.
    """
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    large = F.raise_error(F.lit("a component is too large for integer codes")).cast("long")
    scaled = lambda x: F.when(F.abs(x) < float(1 << 42), F.floor(x.cast("double") * SCALE).cast("long")).otherwise(large)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").where(F.col("embedding").isNotNull() & ~odd)
    return own.select("vec_id", "label", F.transform("embedding", scaled).alias("x"))


def _parts(column: pa.Array, width: int, parts: int) -> np.ndarray:
    """The vectors as rows x parts x components; shorter ones are filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out.reshape(len(column), parts, width // parts)


def nearest(x: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row and its squared distance, in int64 without overflow, else an error."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(codebook).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) >= 2**63:
        raise ValueError(f"components of {most} are too large: squared distances of {x.shape[1]} components overflow 64 bits")
    distances = (x * x).sum(axis=1)[:, None] - 2 * (x @ codebook.T) + (codebook * codebook).sum(axis=1)
    first = distances.argmin(axis=1)
    return first, distances[np.arange(len(x)), first]


def _assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the batches with their parts, the entries of these and the squared distances."""
    parts, _, own = books.shape
    for whole in batches:
        for k in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(k, _ROWS)
            x = _parts(batch.column("x"), parts * own, parts)
            found = [nearest(x[:, p], books[p]) for p in range(parts)]
            yield batch, x, np.stack([f for f, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, n and the sums s0, s1, ... of the parts assigned to each entry that is used."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, entries, own = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, own), np.int64)
        for _, x, first, _ in _assigned(batches, shared.value):
            for p in range(parts):
                np.add.at(n[p], first[:, p], 1)
                np.add.at(sums[p], first[:, p], x[:, p])
        part, entry = np.nonzero(n)
        columns = [part.astype(np.int32), entry.astype(np.int32), n[part, entry], *sums[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "n", *(f"s{i}" for i in range(own))])

    schema = "part int, entry int, n long" + "".join(f", s{i} long" for i in range(own))
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *(f"s{i}" for i in range(own)))]
    return rows.select("x").mapInArrow(run, schema).groupBy("part", "entry").agg(*exact)


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after all rounds: parts x entries x components of a part.

    ``rows`` is what quantized() returns. The first entries are the parts of the
    rows with the smallest vec_id, ties by the vector, null ids last; fewer rows
    give fewer entries. The driver holds the codebooks and one row of sums for
    each entry, never vectors beyond the first ``entries``.
    """
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    width = -(-width // parts) * parts
    start = rows.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    books = np.zeros((len(start), width), np.int64)
    for k, r in enumerate(start):
        books[k, : len(r["x"])] = r["x"]
    books = np.ascontiguousarray(books.reshape(len(start), parts, width // parts).transpose(1, 0, 2))
    for _ in range(rounds if width and len(start) else 0):
        for r in _sums(rows, books).collect():
            part, entry, n, *sums = r
            books[part, entry] = [int(s) // int(n) for s in sums]
    return books


def digest(books: np.ndarray) -> str:
    """The SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part) and error, the squared distances summed over the parts."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not shared.value.size:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([""] * b.num_rows, pa.string()), pa.array([0] * b.num_rows, pa.int64())], ["vec_id", "label", "code", "error"])
            return
        for batch, _, first, far in _assigned(batches, shared.value):
            code = [x.tobytes().hex() for x in first.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code), pa.array(far.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id and x, the entries that a code names, one part after another."""
    shared = codes.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for b in batches:
            first = np.frombuffer(bytes.fromhex("".join(b.column("code").to_pylist())), np.uint8).reshape(b.num_rows, held.shape[0])
            x = np.concatenate([held[p][first[:, p]] for p in range(held.shape[0])], axis=1) if b.num_rows else np.zeros((0, 0), np.int64)
            offsets = np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)[: b.num_rows + 1]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.ListArray.from_arrays(offsets, x.ravel())], ["vec_id", "x"])

    return codes.where(F.col("code") != "").select("vec_id", "code").mapInArrow(run, "vec_id long, x array<long>")


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row that takes part.

    label_error is error summed over equal labels, null labels together. Rows
    may repeat; each has its own result. Vectors of different lengths, or of
    lengths that the parts do not divide, count as filled up with zeros; empty
    ones too, and where all are empty the code is empty and errors are 0. Other
    columns are ignored; an empty table gives an empty result. Components whose
    squared distances would overflow 64 bits are an error.
    """
    rows = quantized(vectors)
    books = codebooks(rows)
    codes = cut(encoded(rows, books))
    by_label = codes.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error"))
    found = codes.join(by_label, F.col("label").eqNullSafe(F.col("own")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _rounds_sql() -> str:
    own = "len(x) // 4"
    text = f"""
v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS i, vec_id, label, x FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
parts AS (SELECT i, p, list_slice(x, p * ({own}) + 1, (p + 1) * ({own})) AS x FROM v, (SELECT unnest(range({PARTS})) AS p)),
b0 AS (SELECT p, i - 1 AS e, x FROM parts WHERE i <= {ENTRIES}),"""
    for r in range(ROUNDS + 1):
        text += f"""
a{r} AS (
  SELECT i, p, min_by(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT a.i, a.p, b.e, list_inner_product(a.x, a.x) - 2 * list_inner_product(a.x, b.x) + list_inner_product(b.x, b.x) AS d
    FROM parts a JOIN b{r} b USING (p)) GROUP BY i, p),"""
        if r < ROUNDS:
            text += f"""
m{r} AS (
  SELECT p, e, list(m ORDER BY k) AS x FROM (
    SELECT p, e, k, floor(sum(c) / count(*)) AS m FROM (
      SELECT a.p, a.e, unnest(s.x) AS c, unnest(range(1, len(s.x) + 1)) AS k FROM a{r} a JOIN parts s USING (i, p)) GROUP BY p, e, k)
  GROUP BY p, e),
b{r + 1} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (p, e)),"""
    return text


#: The rows of compressed().
CODES_SQL = f"""
WITH {_rounds_sql()}
hashed AS (
  SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, k)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(x) AS c, unnest(range(len(x))) AS k FROM b{ROUNDS})),
coded AS (
  SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY i)
SELECT v.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, h.codebooks_sha256
FROM v JOIN coded c USING (i), hashed h
"""
