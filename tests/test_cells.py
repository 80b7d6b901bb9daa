"""Nearest vectors through cells against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import SparkSession

from clausegrid.operators import cells, retrieval


def brute(queries: list[tuple], corpus: list[tuple], k: int, least: float) -> list[tuple]:
    out = []
    for q, g, v in queries:
        scored = []
        for i, h, x in corpus:
            if h != g or not x or not v or None in x or None in v or not any(x) or not any(v):
                continue
            n = max(len(x), len(v))
            a, b = np.pad(np.array(v, float), (0, n - len(v))), np.pad(np.array(x, float), (0, n - len(x)))
            c = round(float((a / np.sqrt(a @ a)) @ (b / np.sqrt(b @ b))), 6) + 0.0
            if c >= least:
                scored.append((-c, i))
        out += [(q, i, -c, n) for n, (c, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("centers", [1, 6, 500])
@pytest.mark.parametrize("least", [-1.0, 0.5])
def test_nearest_by_cells(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, centers: int, least: float) -> None:
    monkeypatch.setattr(cells, "CHUNK", 7)
    monkeypatch.setattr(cells, "SET", 3)
    r = random.Random(2)
    tops = [[r.gauss(0, 1) for _ in range(5)] for _ in range(6)]
    near = lambda: [c + r.gauss(0, 0.1) for c in r.choice(tops)]
    corpus = [(i, r.choice("aaab"), near()) for i in range(150)]
    corpus += [(200, "a", None), (201, "a", [0.0] * 5), (202, "a", [1.0, None, 1.0, 1.0, 1.0]), (203, "a", [1.0, 2.0]), (204, "b", corpus[0][2]), (205, "b", corpus[0][2])]
    queries = [(i, r.choice("ab"), near()) for i in range(20)] + [(30, "c", near()), (31, "a", None), (32, "b", corpus[0][2])]
    x = spark.createDataFrame(corpus, "id long, grp string, vec array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, grp string, vec array<double>")
    found, report = cells.nearest_by_cells(q, x, 4, least, centers)
    got = sorted((a["query_id"], a["id"], a["cosine"] + 0.0, a["rank"]) for a in found.collect())
    assert got == brute(queries, corpus, 4, least)
    seen = report.collect()
    assert all(a["searched"] <= a["cells"] for a in seen if a["cells"])
    if centers == 6:
        assert sum(a["searched"] for a in seen) < sum(a["cells"] for a in seen)
    assert cells.nearest_by_cells(q, x.limit(0), 4, least)[0].count() == 0
    assert cells.nearest_by_cells(q.limit(0), x, 4, least)[0].count() == 0


def test_many_queries_make_no_product_of_tables(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 5)
    v = spark.range(400).selectExpr("id", "0 as grp", "array(sin(id), cos(id), sin(id * 7)) as vec")
    asked = v.selectExpr("id as query_id", "grp", "vec")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = retrieval.nearest(asked, v, 3, -1.0)
        assert "CartesianProduct" not in found._jdf.queryExecution().toString()
        many = sorted(map(tuple, found.select("query_id", "id", "rank").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 10_000)
    assert many == sorted(map(tuple, retrieval.nearest(asked, v, 3, -1.0).select("query_id", "id", "rank").collect()))
