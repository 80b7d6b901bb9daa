"""Lookups with their fallbacks on small cases."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from clausegrid.operators import lookups, retrieval
from clausegrid.operators.postings import Postings

QUERIES = "query_id long, list int, grp string, vec array<double>, asked string"
CORPUS = "id long, grp string, vec array<double>, text string, day date"


def tables(spark: SparkSession):
    queries = [(1, 1, "on", [1.0, 0.0], "entry notice"), (1, 2, "on", [0.9, 0.1], "notice"), (2, 1, "on", [0.0, 1.0], "repairs heating"), (2, 2, "on", [0.0, 1.0], "heating"), (3, 1, "on", None, "heating broken"), (3, 2, "on", None, "heating")]
    corpus = [(10, "on", [1.0, 0.0], "entry needs notice"), (11, "on", [0.9, 0.2], "old notice"), (12, "on", [0.1, 1.0], "old heating case"), (13, "on", [-1.0, 0.0], "heating is due"), (14, "bc", [1.0, 0.0], "notice elsewhere"), (15, "on", None, None)]
    days = {10: "2024-01-01", 11: "2020-01-01", 12: "2019-01-01", 13: "2024-01-01", 14: "2024-01-01", 15: None}
    c = spark.createDataFrame([(*x, days[x[0]]) for x in corpus], CORPUS.replace("day date", "day string")).withColumn("day", F.to_date("day"))
    return spark.createDataFrame(queries, QUERIES), c


def test_decisions_widen_and_fall_back(spark: SparkSession) -> None:
    queries, corpus = tables(spark)
    found = lookups.decisions(queries, corpus, "2023-01-01", n_lists=2)
    got = {q: [(r["id"], r["step"]) for r in sorted(found.where(f"query_id = {q}").collect(), key=lambda r: r["rank"])] for q in (1, 2, 3)}
    assert got == {1: [(10, 0), (11, 1)], 2: [(12, 1)], 3: [(12, 2), (13, 2)]}
    assert {r["score"] for r in found.where("step = 2").collect()} == {0.25}
    assert lookups.decisions(queries.limit(0), corpus, "2023-01-01").count() == 0
    assert lookups.decisions(queries, corpus.limit(0), "2023-01-01").count() == 0


def test_statutes_by_vector_and_words(spark: SparkSession, tmp_path) -> None:
    queries, corpus = tables(spark)
    index = Postings.write(corpus.where("grp = 'on'").select("id", "text"), str(tmp_path / "i"), english=True, buckets=2)
    found = lookups.statutes(queries, corpus, index, n_lists=2)
    got = {q: [(r["id"], r["fallback"]) for r in sorted(found.where(f"query_id = {q}").collect(), key=lambda r: r["rank"])] for q in (1, 2, 3)}
    assert got[1] == [(10, False), (11, False)]
    assert {i for i, _ in got[2]} == {12, 13} and sorted(got[3]) == [(12, False), (13, False)]
    plain = lookups.statutes(queries, corpus, None, n_lists=2)
    got = {q: [(r["id"], r["fallback"]) for r in sorted(plain.where(f"query_id = {q}").collect(), key=lambda r: r["rank"])] for q in (1, 2, 3)}
    assert got == {1: [(10, False), (11, False)], 2: [(12, False), (13, True)], 3: [(12, True), (13, True)]}
    failed = queries.withColumn("failed", F.col("vec").isNull())
    sure = {r["query_id"]: r["confidence"] for r in retrieval.retrieval_confidence(plain, failed).collect()}
    assert sure[2] == 0.5 and sure[3] == 0.3 and sure[1] > 0.5


def test_chat_context_cuts_texts(spark: SparkSession) -> None:
    queries, corpus = tables(spark)
    long = corpus.withColumn("text", F.repeat("text", 100))
    got = lookups.chat_context(queries.where("list = 1"), long, None, long).collect()
    assert {(r["query_id"], r["source"], r["id"]) for r in got} == {(1, "statute", 10), (1, "statute", 11), (1, "decision", 10), (1, "decision", 11), (2, "statute", 12), (2, "decision", 12)}
    assert {len(r["text"]) for r in got if r["source"] == "statute"} == {600} and {len(r["text"]) for r in got if r["source"] == "decision"} == {400}
