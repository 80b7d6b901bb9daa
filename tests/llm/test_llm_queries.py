"""The training-data queries against their SQL, and the pipeline against its stages by hand."""

from __future__ import annotations

import tracemalloc
import types

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from clausegrid.llm import backoff, mixing
from clausegrid.llm.queries import oracle_sql, queries
from clausegrid.llm.words import mix

SF_DIR = "/root/testdata/sf0.001"


def rows(columns: list[str], found: list[tuple]) -> list[tuple[str, ...]]:
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in by) for r in found)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark: SparkSession, name: str) -> None:
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF_DIR}/{t}.parquet'")
    df, want = queries()[name](spark, SF_DIR), con.sql(oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_scores_of_odd_rows(spark: SparkSession) -> None:
    df = spark.createDataFrame([(1, "a b a b"), (1, "a b a b"), (2, None), (3, " \n"), (None, "A c"), (4, "x" * 5000)], "doc_id long, text string")
    found = backoff.lm_scores(df).collect()
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in found) == [("1", 4), ("1", 4), ("2", 0), ("3", 0), ("4", 1), ("None", 2)]
    assert {r["score"] for r in found if r["n_words"] == 0} == {None}
    assert backoff.lm_scores(df.limit(0)).count() == 0


def test_lm_scores_are_the_same_however_chunks_and_buckets_are_cut(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    texts = [" ".join(f"w{(i * k) % 37}" for k in range(1, 60)) for i in range(40)] + [None, "", "one", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, backoff.rounded_scores(df.coalesce(1)).collect()), key=str)
    monkeypatch.setattr(backoff, "BUCKET_GRAMS", 64)
    cut = df.repartition(5)
    assert sorted(map(tuple, backoff.rounded_scores(cut).collect()), key=str) == want
    totals = {r["total"] for r in backoff.counted(backoff.packets(backoff.chunked(cut), 6), 4).collect()}
    assert min(totals) >= backoff.MIN_COUNT


def test_pipeline(spark: SparkSession, tmp_path) -> None:
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = docs
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = kept
        stage(spark, before, SF_DIR).write.parquet(str(tmp_path / str(k)))
        kept = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(kept.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert kept.dtypes == docs.dtypes
            assert kept.join(before, "doc_id", "left_anti").count() == 0
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4] == counts[5] > 0
    whole = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(str, whole.select("doc_id", "n_tokens", F.hash("ids")).collect())) == sorted(map(str, kept.select("doc_id", "n_tokens", F.hash("ids")).collect()))


def test_pipeline_positions_follow_the_mixture(spark: SparkSession, tmp_path) -> None:
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").dropDuplicates(["doc_id"])
    stages = dict(corpus_pipeline.STAGES)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stages["mixing sources"](spark, docs, SF_DIR).write.parquet(str(tmp_path / "mixed"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "mixed").glob("part-*"))) > 1
    out = stages["byte-level BPE"](spark, spark.read.parquet(str(tmp_path / "mixed")), SF_DIR)
    got = [r["doc_id"] for r in out.select("doc_id", "position").orderBy("position").collect()]
    assert got == [r["doc_id"] for r in mixing.mixture(docs).orderBy("slot", "place").collect()]


def test_positions_by_the_file_number_only(spark: SparkSession, tmp_path) -> None:
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "written"))
    (tmp_path / "named").mkdir()
    name = "part-00003-1f2e3d4c-c99999-4444-8888-c12345678901-c002.snappy.parquet"
    next((tmp_path / "written").glob("part-*")).rename(tmp_path / "named" / name)
    out = corpus_pipeline.encoded(spark, spark.read.parquet(str(tmp_path / "named")), SF_DIR)
    assert [r["position"] for r in out.collect()] == [(3 << 43) + (2 << 30)]


def test_counts_are_found_range_by_range() -> None:
    every = mix(np.random.default_rng(1).integers(0, 1 << 17, 1 << 18, dtype=np.uint64))
    own, place = np.unique(every, return_inverse=True)
    found = np.arange(len(own)) * 3
    tracemalloc.start()
    got = backoff._counts_of(every, found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == found[place]).all()
    # What is returned takes one time the n-grams' bytes; sorting them at once takes four times and more.
    assert peak < 2.5 * every.nbytes
    assert len(backoff._counts_of(every[:0], found[:0])) == 0


def test_a_chunk_is_scored_in_little_memory(monkeypatch: pytest.MonkeyPatch) -> None:
    h = mix(np.random.default_rng(2).integers(0, 1 << 16, 1 << 18, dtype=np.uint64))
    pair = np.where(np.arange(len(h)) % 100 > 0, np.roll(h, 1) ^ mix(h), 0)
    own, n = np.unique(np.concatenate((h, pair[pair > 0])), return_counts=True)
    found = n.astype(np.int32)
    tracemalloc.start()
    words, pairs = backoff._both_counts(h, pair, found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Counts of both take half of the n-grams' bytes; one copy of these and their counts would take twice.
    assert peak < 1.5 * (h.nbytes + pair.nbytes)
    assert (words == n[np.searchsorted(own, h)]).all()
    assert (pairs == np.where(pair > 0, n[np.searchsorted(own, pair) % len(n)], 0)).all()
    row = np.repeat(np.arange(64), len(h) // 64)
    want = backoff._sums(row, pair > 0, words, pairs, 64, len(h))
    monkeypatch.setattr(backoff, "PIECE", 1000)
    assert np.allclose(backoff._sums(row, pair > 0, words, pairs, 64, len(h)), want, rtol=1e-12)


def test_chunks_and_packets_are_made_in_little_memory(monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(backoff, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    words = np.char.mod("%x", np.random.default_rng(3).integers(0, 1 << 16, 1 << 21))
    batch = pa.RecordBatch.from_arrays([pa.array(range(512)), pa.array([" ".join(x) for x in words.reshape(512, -1)])], ["doc_id", "text"])
    tracemalloc.start()
    (chunk,) = backoff._chunks(iter([batch]))
    # A chunk's bytes are held, joined and compressed; its words would take four times them and more.
    assert tracemalloc.get_traced_memory()[1] < 5 * sum(map(len, batch.column("text").to_pylist()))
    frame = types.SimpleNamespace(select=lambda *columns: types.SimpleNamespace(mapInArrow=lambda run, schema: run))
    run = backoff.packets(frame, 6)
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    assert sum(p.num_rows for p in run(iter([chunk]))) == 64
    # Words and pairs take twice the words' bytes; sorting them at once takes four times more.
    assert tracemalloc.get_traced_memory()[1] - before < 6 * 8 * len(words)
    tracemalloc.stop()
    h, row, pair = backoff._grams(*(chunk.column(c).to_pylist()[0] for c in ("packed", "sizes", "words")))
    own, n = np.unique(np.concatenate((h, pair[pair > 0])), return_counts=True)
    got = [p.column(c).combine_chunks().flatten().to_numpy() if c != "start" else p.column(c).to_numpy() for p in [pa.Table.from_batches(list(run(iter([chunk]))))] for c in ("grams", "counts", "start")]
    assert (got[0] == own.view(np.int64)).all() and (got[1] == n).all()
    assert (own[got[2]] >> np.uint64(58) == np.arange(64)).all()
