"""Columns of any name, large components, and the pipeline's stages on odd rows."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from clausegrid.llm import mixing, quality, simhash, suffixes, topk
from clausegrid.llm.common import remove, stored_at

NAMES = ("_slot", "_id", "_source", "_block", "_place", "a.b", "top", "doc", "mean", "kept", "component_id", "Text", "n")


def odd(spark: SparkSession) -> DataFrame:
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "en", "s1"), (2, words, "en", "s1"), (3, None, None, None), (4, "", "fr", "s2"), (1, words, "en", "s1"), (None, "x y z", "en", ""), (5, "é " * 400, "fr", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({"n_chars": F.length("text").cast("long")} | {c: F.monotonically_increasing_id() for c in NAMES if c != "Text"}).withColumnRenamed("n", "Other text")


def test_columns_of_any_name_stay(spark: SparkSession) -> None:
    docs = odd(spark)
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    for out in (mixing.mixed(docs), simhash.one_of_each_group(docs), suffixes.texts_without_repeats(docs), quality.good_documents(docs, labels)):
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert 0 < out.count() <= docs.count()
    assert mixing.mixed(docs).count() == docs.count()
    assert sorted(str(r["a.b"]) for r in mixing.mixed(docs).select("`a.b`").collect()) == sorted(str(r["a.b"]) for r in docs.select("`a.b`").collect())


@pytest.mark.parametrize("size", [2.0**21, 2.0**20, 1.0])
def test_top_k_of_large_components(spark: SparkSession, size: float) -> None:
    rows = [(0, [size, size]), (1, [size / 4, -size / 8]), (2, [-size / 2, 1.0]), (3, [size / 16, size / 16])]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    x = {i: [int(c * 1024) for c in v] for i, v in rows}
    want = sorted(((-sum(a * b for a, b in zip(x[0], x[i], strict=True)), i) for i in (1, 2, 3)))
    assert [(r["vec_id"], r["score"]) for r in found] == [(i, -s) for s, i in want]


def test_a_score_beyond_a_long_is_an_error(spark: SparkSession) -> None:
    rows = [(0, [2.0**24, 2.0**24]), (1, [2.0**24, 2.0**24]), (2, [1.0, 0.0])]
    with pytest.raises(Exception, match="does not fit"):
        topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()


def test_positions_differ_with_several_files_a_task(spark: SparkSession, tmp_path) -> None:
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"), F.lit(8).cast("long").alias("n_chars"))
    stages = dict(corpus_pipeline.STAGES)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "100")
    try:
        stages["mixing sources"](spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert len(list((tmp_path / "mixed").glob("part-*"))) >= 10
    out = stages["byte-level BPE"](spark, spark.read.parquet(str(tmp_path / "mixed")), "")
    got = out.select("doc_id", "position").orderBy("position").collect()
    assert len({r["position"] for r in got}) == 1000
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in mixing.mixture(docs).orderBy("slot", "place").collect()]


def test_stages_on_odd_rows(spark: SparkSession, tmp_path) -> None:
    kept = odd(spark)
    spark.createDataFrame([(1, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        kept = spark.read.parquet(str(tmp_path / str(k)))
    assert kept.columns == ["position", "doc_id", "n_tokens", "ids", "decoded_sha256"]
    assert kept.count() > 0 and kept.select("position").distinct().count() == kept.count()


def test_a_stored_table_can_be_removed(spark: SparkSession) -> None:
    table, path = stored_at(spark.range(3).toDF("x"), "small")
    assert table.count() == 3
    remove(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)
