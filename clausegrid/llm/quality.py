"""Quality selection by importance resampling over hashed n-grams.

Two bag-of-n-gram models over the same hash buckets, one of the texts that
labels call good (the target), one of all texts (raw), give every document the
mean log ratio of its n-grams. That mean, times EFFECTIVE_NGRAMS so that long
and short texts weigh alike, is its log importance weight. Adding Gumbel noise
and taking the k largest draws k documents without replacement in proportion to
the weights. k is the number of documents whose mean lies on the good side of
the cut that parts the labelled sample best, so the draw has as many documents
as the corpus has of target quality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausegrid.llm.common import cut, slices, under_plain_names, utf8
from clausegrid.llm.words import lower, pair_hash, pieces, span_hashes

BUCKETS = 10_000
#: Labelled rows that the target model and the cut are fitted on, at most.
LABELLED_ROWS = 20_000
EFFECTIVE_NGRAMS = 200
SEED = 7
#: How much more the cut minds losing all good texts than keeping all bad ones.
GOOD_WEIGHT = 5.0
#: Fixed-point form of a key: steps to a unit, and what is added to make it non-negative.
_STEPS, _ZERO, _TOP = 1 << 32, 1 << 47, (1 << 48) - 1
_AGAIN = np.uint64(1)
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the row of each run of letters or digits and each run of other signs."""
    data = lower(data)
    kind = _KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    some = kind[starts] > 0
    starts, ends = starts[some], ends[some]
    return span_hashes(data, starts, ends), np.searchsorted(offsets, starts, side="right") - 1


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and rows of the unigrams and bigrams of runs of letters or digits and runs of other signs.

    All bigrams that repeat a run share one bucket.
    """
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, _, part, at in pieces(data, offsets):
        if len(part):
            h, row = _runs(part, at)
            hashes.append(h)
            rows.append(row + first)
    h, row = np.concatenate(hashes), np.concatenate(rows)
    pair = row[1:] == row[:-1]
    pairs = np.where(h[1:] == h[:-1], _AGAIN, pair_hash(h[:-1], h[1:]))
    all_hashes = np.concatenate((h, pairs[pair]))
    return (all_hashes % np.uint64(BUCKETS)).astype(np.int64), np.concatenate((row, row[1:][pair]))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in slices(batches, "text"):
        bucket, row = ngrams(*utf8(batch.column("text")))
        good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
        raw += np.bincount(bucket, minlength=BUCKETS)
        target += np.bincount(bucket[good[row]], minlength=BUCKETS)
    if raw.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])


def labelled_sample(labels: DataFrame) -> DataFrame:
    """doc_id and good of at most LABELLED_ROWS documents with a quality label; of several labels the least counts."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") >= 1).alias("good"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)


def ratios(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """The log ratio of target to raw probability of each bucket, add-one smoothed; zeros without any target text."""
    own = sample.select(F.col("doc_id").alias("_labelled"), "good")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = named.join(F.broadcast(own), F.col("doc_id") == F.col("_labelled"), "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    sums = named.mapInArrow(_counts, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums.collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.any():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def _scored(docs: DataFrame, ratio: np.ndarray, others: list[str]) -> DataFrame:
    """text, doc (a struct of ``others``) and mean, the mean log ratio; zero for a text without n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            bucket, row = ngrams(*utf8(batch.column("text")))
            count = np.bincount(row, minlength=batch.num_rows)
            mean = np.bincount(row, weights=shared.value[bucket], minlength=batch.num_rows) / np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("doc"), pa.array(mean)], ["text", "doc", "mean"])

    given = docs.select("text", F.struct(*others).alias("doc"))
    return given.mapInArrow(run, T.StructType([*given.schema.fields, T.StructField("mean", T.DoubleType())]))


def best_cut(means: np.ndarray, good: np.ndarray) -> float:
    """The mean that parts good from bad at the least weighted loss; minus infinity if one kind is missing."""
    if not good.any() or good.all():
        return -np.inf
    by = np.argsort(means, kind="stable")
    means, good = means[by], good[by]
    lost, gone = np.cumsum(good) / good.sum(), np.cumsum(~good) / (~good).sum()
    last = np.append(means[1:] != means[:-1], True)
    gain = np.where(last, gone - GOOD_WEIGHT * lost, -1)
    k = int(gain.argmax())
    if gain[k] <= 0:
        return -np.inf
    return float((means[k] + means[k + 1]) / 2) if k + 1 < len(means) else np.inf


def _key(mean: Column, doc_id: Column) -> Column:
    """log weight plus Gumbel noise drawn from doc_id, in fixed point."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(SEED)), 12).cast("double") + 0.5) / float(1 << 52)
    key = mean * EFFECTIVE_NGRAMS - F.log(-F.log(u))
    return F.greatest(F.lit(0), F.least(F.lit(_TOP), F.floor(key * _STEPS).cast("long") + _ZERO))


def kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest 48-bit ``key``, by three histograms of 16 bits each; 0 if there are no more than k."""
    known, left = 0, k
    for shift in (32, 16, 0):
        within = keys.where(F.shiftright("key", shift + 16) == known) if shift < 32 else keys
        digits = within.groupBy(F.shiftright("key", shift).bitwiseAND(F.lit(65535)).alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect()
        for digit, n in sorted(((r.digit, r.n) for r in digits), reverse=True):
            if left <= n:
                break
            left -= n
        else:
            return 0
        known = known << 16 | digit
    return known


def _draw(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, int]:
    """The bucket ratios and the least key drawn."""
    sample = cut(labelled_sample(labels))
    ratio = ratios(docs, sample)
    doc_id = F.col("doc.doc_id").cast("long")
    scores = cut(_scored(docs, ratio, ["doc_id"]).select(doc_id.alias("doc_id"), "mean", _key(F.col("mean"), doc_id).alias("key")))
    rows = scores.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("mean").alias("mean"), F.first("good").alias("good")).collect()
    at = best_cut(np.array([r.mean for r in rows]), np.array([r.good for r in rows], bool))
    k = scores.where(F.col("mean") >= at).count()
    return ratio, kth_largest(scores.select("key"), k) if k else _TOP + 1


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, log_weight (to an n-gram) and kept of every document.

    A null or empty text has log weight 0. Rows of one doc_id share their
    noise; ties with the last key drawn are kept. Rows with null labels or
    doc_ids teach nothing; of rows that repeat a labelled doc_id all teach the
    target model, and the least mean the cut. Without labels of both kinds
    everything is kept.
    """
    ratio, least = _draw(docs, labels)
    doc_id = F.col("doc.doc_id").cast("long")
    return _scored(docs, ratio, ["doc_id"]).select(doc_id.alias("doc_id"), F.col("mean").alias("log_weight"), (_key(F.col("mean"), doc_id) >= least).alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents drawn, with all their columns, whatever their names."""
    return under_plain_names(docs, ("doc_id", "text"), lambda rows: _good(rows, labels))


def _good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    ratio, least = _draw(docs, labels)
    scored = _scored(docs, ratio, [c for c in docs.columns if c != "text"])
    kept = scored.where(_key(F.col("mean"), F.col("doc.doc_id").cast("long")) >= least)
    return kept.select(*(F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns))
