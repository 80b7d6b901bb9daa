"""Language-model scores by stupid backoff over the corpus's own n-gram counts.

Texts are packed into chunks of bounded size. Each chunk gives its distinct
words and word pairs, by hash, with how often it has them, as one array for
each bucket of the hash range. The arrays are shuffled by bucket and exploded
into rows; the counts of an n-gram are summed over all chunks, and each row
takes that sum back to its chunk. No n-gram has more rows than there are
chunks, however frequent it is, and Spark sorts them with spilling. In the
chunk the scores are added up for each document: a pair found MIN_COUNT times
or more scores its count over that of its first word, any other one falls back
to BACKOFF times the share of its second word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausegrid.llm.common import slices, stored, utf8
from clausegrid.llm.words import pair_hash, word_count, word_pieces

BACKOFF = 0.4
MIN_COUNT = 2
CHUNK_BYTES = 8 << 20
#: N-grams of a bucket, about, all chunks together.
BUCKET_GRAMS = 1 << 20
#: Buckets never have more bits; beyond that their rows are sorted on disk.
MOST_BITS = 18
#: Ranges of hashes, as bits, in which a chunk's n-grams are sorted.
RANGE_BITS = 4
#: Words of a chunk whose logarithms are taken at once.
PIECE = 1 << 18


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here, number = TaskContext.get().partitionId() << 24, 0
    press = zstandard.ZstdCompressor(level=3).compress
    ids: list[int | None] = []
    sizes: list[np.ndarray] = []
    texts: list[bytes] = []
    words = size = 0

    def pack() -> pa.RecordBatch:
        columns = [pa.array([here + number]), pa.array([words]), pa.array([ids], pa.list_(pa.int64())), pa.array([np.concatenate(sizes)], pa.list_(pa.int64())), pa.array([press(b"".join(texts))])]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "words", "ids", "sizes", "packed"])

    # Texts are copied, since a slice would hold its whole batch.
    for batch in slices(batches, "text", CHUNK_BYTES // 4):
        data, at = utf8(batch.column("text"))
        ids += batch.column("doc_id").to_pylist()
        sizes.append(np.diff(at))
        texts.append(data.tobytes())
        words += word_count(data, at)
        size += len(data)
        if size >= CHUNK_BYTES:
            yield pack()
            ids, sizes, texts, words, size, number = [], [], [], 0, 0, number + 1
    if ids:
        yield pack()


def chunked(docs: DataFrame) -> DataFrame:
    """The texts in chunks: chunk, words (how many it has), ids and sizes of its documents, packed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_chunks, "chunk long, words long, ids array<long>, sizes array<long>, packed binary")


def _grams(packed: bytes, sizes: list[int], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of a chunk: their hashes and rows, and the hashes of the pairs that they end; zero for a row's first word."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    h, row, pair = np.empty(words, np.uint64), np.empty(words, np.int32), np.zeros(words, np.uint64)
    at = 0
    for own, rows in word_pieces(data, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)):
        first, end = max(at, 1), at + len(own)
        h[at:end], row[at:end] = own, rows
        pair[first:end] = np.where(row[first:end] == row[first - 1 : end - 1], pair_hash(h[first - 1 : end - 1], h[first:end]), 0)
        at = end
    return h, row, pair


def _ranges(h: np.ndarray, pair: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where a chunk's words and where its pairs are whose hashes begin with the same bits, in the order of these.

    N-grams are sorted range by range, so that what sorting needs is small.
    """
    parts = [(x >> np.uint64(64 - RANGE_BITS)).astype(np.uint8) for x in (h, pair)]
    for n in range(1 << RANGE_BITS):
        yield np.flatnonzero(parts[0] == n), np.flatnonzero((parts[1] == n) & (pair > 0))


def _both_counts(h: np.ndarray, pair: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counts of a chunk's words and of its pairs, zero for none; ``found`` has those of its distinct n-grams, in order."""
    counts, before = (np.zeros(len(h), found.dtype), np.zeros(len(pair), found.dtype)), 0
    for words, pairs in _ranges(h, pair):
        own, place = np.unique(np.concatenate((h[words], pair[pairs])), return_inverse=True)
        counts[0][words], counts[1][pairs] = found[place[: len(words)] + before], found[place[len(words) :] + before]
        before += len(own)
    return counts


def _counts_of(every: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The counts of n-grams that are not told apart."""
    return _both_counts(every, every[:0], found)[0]


def _sums(row: np.ndarray, paired: np.ndarray, words: np.ndarray, pairs: np.ndarray, n_rows: int, total: int) -> np.ndarray:
    """The sum of the logarithms of each row's scores, of a piece of the words at a time."""
    sums = np.zeros(n_rows)
    for a in range(0, len(row), PIECE):
        at = slice(a, a + PIECE)
        own, both = np.maximum(words[at], 1), pairs[at]
        before = np.append(max(words[a - 1], 1) if a else 1, own[:-1])
        share = np.where(paired[at], BACKOFF, 1.0) * own / max(total, 1)
        sums += np.bincount(row[at], weights=np.log(np.where(both > 0, both / before, share)), minlength=n_rows)
    return sums


def _press(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, compressed; small ones leave most planes empty."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def _unpress(packed: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packets(chunk: int, h: np.ndarray, pair: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """The packets of a chunk, a range of hashes at a time."""
    before = 0
    for words, pairs in _ranges(h, pair):
        gram, n = np.unique(np.concatenate((h[words], pair[pairs])), return_counts=True)
        if not len(gram):
            continue
        bucket = (gram >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(gram), np.int32)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        at = pa.array(np.append(edges, len(gram)).astype(np.int32))
        grams = pa.ListArray.from_arrays(at, pa.array(gram.view(np.int64)))
        counts = pa.ListArray.from_arrays(at, pa.array(n.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(edges), chunk)), pa.array(bucket[edges]), pa.array(edges + before), grams, counts], ["chunk", "bucket", "start", "grams", "counts"])
        before += len(gram)


def packets(chunks: DataFrame, bits: int) -> DataFrame:
    """chunk, bucket (the first ``bits`` bits of the hash), start, grams and counts: a chunk's distinct hashes in order, cut by bucket and range.

    ``start`` is the place of the packet's first hash among all of its chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (x for k in range(batch.num_rows) for x in batch.slice(k, 1).to_pylist()):
                h, row, pair = _grams(r["packed"], r["sizes"], r["words"])
                del row
                yield from _packets(r["chunk"], h, pair, bits)

    return chunks.select("chunk", "words", "sizes", "packed").mapInArrow(run, "chunk long, bucket int, start long, grams array<long>, counts array<int>")


def counted(packed: DataFrame, parts: int) -> DataFrame:
    """chunk, place and total: the corpus count of each n-gram of a chunk that is found MIN_COUNT times or more.

    Packets are shuffled by bucket and exploded where they arrive, so that an
    n-gram is eight bytes of a row in the shuffle. The count table is
    partitioned by the hash's first bits, and so are the n-grams joined with
    it: both are one window over (bucket, gram), without another shuffle.
    """
    rows = packed.repartition(parts, "bucket").select("chunk", "bucket", "start", F.posexplode(F.arrays_zip("grams", "counts")).alias("at", "of"))
    grams = rows.select("chunk", "bucket", (F.col("start") + F.col("at")).alias("place"), F.col("of.grams").alias("gram"), F.col("of.counts").alias("n"))
    total = F.sum("n").over(Window.partitionBy("bucket", "gram"))
    return grams.select("chunk", "place", total.alias("total")).where(F.col("total") >= MIN_COUNT)


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chunk, place, total = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "place", "total"))
        edges = np.flatnonzero(np.diff(chunk, prepend=-1))
        ends = np.append(edges[1:], len(chunk))[: len(edges)]
        runs = list(zip(edges.tolist(), ends.tolist(), strict=True))
        places = [_press(np.diff(place[a:b], prepend=0)) for a, b in runs]
        totals = [_press(total[a:b].astype(np.int64)) for a, b in runs]
        yield pa.RecordBatch.from_arrays([pa.array(chunk[edges]), pa.array(places, pa.binary()), pa.array(totals, pa.binary())], ["chunk", "places", "totals"])


def packed_counts(counts: DataFrame) -> DataFrame:
    """chunk, places (gaps between them) and totals, compressed: the rows of counted() on their way back to their chunk."""
    return counts.sortWithinPartitions("chunk", "place").mapInArrow(_by_chunk, "chunk long, places binary, totals binary")


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and score, the mean natural logarithm of the words' backoff scores.

    Words are runs of anything but ASCII white space, A-Z in lower case. A
    row's first word scores its share of all words. A text without words has a
    null score. Rows may repeat, count as often as they do and keep a result
    each; other columns are ignored; an empty table gives an empty result.
    """
    chunks = stored(chunked(docs), "chunks")
    total = chunks.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first()["n"]

    bits = min(MOST_BITS, (2 * total // BUCKET_GRAMS).bit_length())

    def score(texts: pa.Table, counts: pa.Table) -> pa.Table:
        out = []
        for r in texts.to_pylist():
            h, row, pair = _grams(r["packed"], r["sizes"], r["words"])
            # Places end before the number of all n-grams, which is at least that of the distinct ones.
            found = np.zeros(len(h) + int(np.count_nonzero(pair)), np.int32)
            for place, n in zip(counts.column("places"), counts.column("totals"), strict=True):
                own = _unpress(n.as_py(), np.int64)
                if own.max(initial=0) >= 1 << 31:
                    found = found.astype(np.int64)
                found[np.cumsum(_unpress(place.as_py(), np.int64))] = own
            words, pairs = _both_counts(h, pair, found)
            del found, h
            paired = pair > 0
            del pair
            n = np.bincount(row, minlength=len(r["ids"]))
            sums = _sums(row, paired, words, pairs, len(r["ids"]), total)
            del row, paired, words, pairs
            mean = pa.array(sums / np.maximum(n, 1), mask=n == 0)
            out.append(pa.table([pa.array(r["ids"], pa.int64()), pa.array(n.astype(np.int64)), mean], ["doc_id", "n_words", "score"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["doc_id", "n_words", "score"])

    counts = packed_counts(counted(packets(chunks, bits), 1 << max(0, bits - 2)))
    return chunks.select("chunk", "words", "ids", "sizes", "packed").groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(score, "doc_id long, n_words long, score double")


def rounded_scores(docs: DataFrame) -> DataFrame:
    """lm_scores with the score rounded, so that the order of additions does not show."""
    return lm_scores(docs).withColumn("score", F.round("score", 5))


#: The rows of rounded_scores().
SCORES_SQL = f"""
WITH w AS (
  SELECT d.doc_id, i, ws[i] AS word, CASE WHEN i > 1 THEN ws[i - 1] END AS before
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents) d,
       LATERAL (SELECT unnest(generate_series(1, len(d.ws))) AS i)),
u AS (SELECT word, count(*) AS n FROM w GROUP BY word),
b AS (SELECT before, word, count(*) AS n FROM w WHERE before IS NOT NULL GROUP BY before, word HAVING count(*) >= {MIN_COUNT}),
t AS (SELECT count(*) AS n FROM w),
s AS (
  SELECT w.doc_id, count(*) AS n_words,
         avg(ln(CASE WHEN b.n IS NOT NULL THEN b.n / CAST(p.n AS DOUBLE)
                     WHEN w.before IS NULL THEN u.n / CAST(t.n AS DOUBLE)
                     ELSE {BACKOFF} * u.n / t.n END)) AS score
  FROM w JOIN u ON u.word = w.word CROSS JOIN t
  LEFT JOIN u p ON p.word = w.before
  LEFT JOIN b ON b.before = w.before AND b.word = w.word
  GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(s.n_words, 0) AS n_words, round(s.score, 5) AS score
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id
"""
