"""Clauses on pages and keys in texts, against brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from clausegrid.functions import cleaning
from clausegrid.operators import alignment


def norm(s: str | None) -> str:
    s = (s or "").lower().translate(str.maketrans("‘’“”–—", "''\"\"--"))
    return re.sub(r"[ \t\n\r\f\v]+", " ", s).strip(" ")


def brute_places(items: list[tuple], clauses: list[tuple]) -> list[tuple]:
    out = []
    for file, clause, body, heading in clauses:
        for f, page in sorted({i[:2] for i in items}):
            if f != file:
                continue
            flat, owner = "", []
            for _, _, n, t in sorted(i for i in items if i[:2] == (f, page)):
                if norm(t):
                    flat, owner = (flat + " ", [*owner, -1]) if flat else (flat, owner)
                    flat, owner = flat + norm(t), owner + [n] * len(norm(t))
            hit = None
            for name, text in (("body", norm(body)), ("heading", norm(heading))):
                for k in (40, 25, 15):
                    if hit or len(text) < k:
                        break
                    if (at := flat.find(text[:k])) >= 0:
                        hit = (name, k, at)
            if hit:
                held = {x for x in owner[hit[2] : hit[2] + hit[1]] if x >= 0}
                out.append((file, clause, page, hit[0], hit[1], min(held), max(held)))
    return sorted(out)


@pytest.mark.parametrize("sizes", [(256, 20_000), (2, 3)])
def test_places_of_clauses(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, sizes: tuple[int, int]) -> None:
    monkeypatch.setattr(alignment, "BLOCK_PAGES", sizes[0])
    monkeypatch.setattr(alignment, "PART_CLAUSES", sizes[1])
    r = random.Random(4)
    words = ["The", "tenant’s", "rent", "shall", "be", "paid", "–", "landlord", "entry", "a", "Schedule"]
    items = [(r.choice(["a", "a", "a", "b"]), r.randrange(9), n, "  ".join(r.choices(words, k=r.randint(0, 4))) if n % 7 else None) for n in range(400)]
    items = list({i[:3]: i for i in items}.values())
    clauses = []
    for n in range(60):
        file, page = r.choice("ab"), r.randrange(9)
        own = " ".join(norm(t) for f, p, _, t in sorted(items, key=str) if (f, p) == (file, page) and norm(t))
        start = r.randrange(max(1, len(own) - 50))
        k = r.choice([10, 17, 28, 60])
        clauses.append((file, n, own[start : start + k] + "zz" + own[start + k : start + 60] if k < 60 else own[start : start + 60], own[:45] if n % 3 else None))
    clauses += [("a", 70, None, None), ("c", 71, "nowhere " * 9, "x"), ("a", 72, "short", ""), clauses[0]]
    pages = alignment.flat_pages(spark.createDataFrame(items, "file string, page int, item int, text string").repartition(3))
    asked = spark.createDataFrame(clauses, "file string, clause long, body string, heading string")
    want = brute_places(items, clauses)
    assert {x[3:5] for x in want} >= {("body", 40), ("body", 25), ("body", 15), ("heading", 40)}
    assert sorted(map(tuple, alignment.clause_places(pages, asked).collect())) == want
    assert alignment.clause_places(pages.limit(0), asked).count() == 0
    assert alignment.clause_places(pages, asked.limit(0)).count() == 0


def test_places_read_pages_and_clauses_once(spark: SparkSession) -> None:
    items = spark.createDataFrame([("a", 1, 0, "The tenant shall pay the rent on the first day of a month"), ("a", 1, 1, None), ("a", 2, 0, "Other text")], "file string, page int, item int, text string")
    asked = spark.createDataFrame([("a", 7, "The  TENANT shall\tpay the rent on the first week", None), ("b", 8, None, "x" * 50)], "file string, clause long, body string, heading string")
    got = alignment.clause_places(alignment.flat_pages(items), asked)
    assert sorted(map(tuple, got.collect())) == [("a", 7, 1, "body", 40, 0, 0)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 0


def test_heads_of_normalised_texts(spark: SparkSession) -> None:
    given = ["", None, "  ", " \t a  b ", "ab  c", "abc   ", "abc  d", "“İx” – y", "𝔸 ‘b’\n\nc", "ΑΣ Α", "abcdefg", "\u00a0a b c d"]
    rows = spark.createDataFrame([(t,) for t in given], "t string")
    for n in (1, 2, 3, 4, 5, 40):
        want, head = F.substring(cleaning.normalized(F.col("t")), 1, n), cleaning.normalized_head(F.col("t"), n)
        assert rows.where(~head.eqNullSafe(want)).collect() == []


@pytest.mark.parametrize("limit", [50_000, 4])
def test_keys_in_texts(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, limit: int) -> None:
    monkeypatch.setattr(alignment, "BROADCAST_KEYS", limit)
    keys = spark.createDataFrame([("s.3",), ("s.37",), ("s",), (None,), ("",), ("s.3",), ("é",)], "key string")
    rows = spark.createDataFrame([(1, "see s.37 and s.3"), (2, None), (3, "É é"), (4, "")], "id int, text string")
    got = {r["id"]: r["keys"] for r in alignment.with_keys(rows, "text", keys).collect()}
    assert got == {1: ["s.37", "s.3", "s"], 2: [], 3: ["é"], 4: []}
    assert alignment.with_keys(rows, "text", keys.limit(0)).select(F.size("keys").alias("n")).distinct().collect()[0]["n"] == 0


def test_sources_by_containment(spark: SparkSession) -> None:
    clauses = spark.createDataFrame([(1, 10, ["RTA Section 3 7"], None), (1, 11, None, "see s. 3(1)"), (2, 12, ["s.3"], ""), (1, 13, [None], None)], "lease_id int, clause_id long, violations array<string>, explanation string")
    sources = spark.createDataFrame([(1, "a", "Act s.3 — x", [13]), (1, "b", "Act, no section", [99]), (1, "c", None, None), (3, "d", "Act s.3 - x", [])], "lease_id int, source string, reference string, stated array<long>")
    got = {r["source"]: r["clause_ids"] for r in alignment.sources_by_containment(clauses, sources).collect()}
    assert got == {"a": [10, 11, 13], "b": [99], "c": [], "d": []}


def test_compliant_wordings(spark: SparkSession) -> None:
    rows = spark.createDataFrame([(1, ["none", "RTA S.105(2)", "s.3"]), (2, ["s.37"]), (3, []), (4, None), (5, [None, "s.120"])], "id int, v array<string>")
    got = {r["id"]: r["w"] for r in rows.select("id", alignment.compliant_wording(F.col("v")).alias("w")).collect()}
    assert {i: w and w["key"] for i, w in got.items()} == {1: "s.105", 2: "s.3", 3: None, 4: None, 5: "s.120"}
    assert got[5]["wording"] == alignment.COMPLIANT["s.120"]
