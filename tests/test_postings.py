"""The inverted index against scans and brute force; stems against known ones."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import SparkSession

from clausegrid.functions.stemming import STOP_WORDS, stem
from clausegrid.operators import postings, retrieval
from clausegrid.plans.catalogue import QUERIES

STEMS = """consign consign consignment consign consistency consist consolingly consol knackeries knackeri kneaded knead knightly knight
knives knive generously generous generate generat communication communic happy happi skies sky dying die cries cri ties tie gas gas this this
gaps gap hopping hop hoping hope luxuriated luxuri national nation relational relat conditional condit abilities abil electrical electr
hopefulness hope formalize formal controlling control agreed agre feed feed by by say say enjoy enjoy tenancies tenanc eviction evict
notices notic payment payment probably probabl bed bed shred shred replacement replac adjustment adjust adoption adopt youth youth
analogies analog apology apolog news news proceed proceed a a 1234 1234""".split()


def test_stems() -> None:
    assert [stem(w) for w in STEMS[::2]] == STEMS[1::2]


def words_of(text: str | None, english: bool) -> list[str | None]:
    found = re.findall("[a-z0-9]+", (text or "").lower())
    return [None if w in STOP_WORDS else stem(w) for w in found] if english else found


def brute_bm25(texts: list[tuple], queries: list[tuple], k: int, english: bool) -> list[tuple]:
    docs = {i: Counter(w for w in words_of(t, english) if w) for i, t in texts}
    mean = sum(sum(c.values()) for c in docs.values()) / len(docs)
    out = []
    for q, asked in queries:
        terms = {w for w in words_of(asked, english) if w} if len((asked or "").strip(" ")) > 2 else set()
        df = {w: sum(w in c for c in docs.values()) for w in terms}
        scored = []
        for i, c in docs.items():
            if terms and all(w in c for w in terms):
                part = [math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in terms]
                scored.append((-round(sum(part), 6), i))
        out += [(q, i, -s, n) for n, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("english", [False, True])
@pytest.mark.parametrize("most", [1000, 1])
def test_search(spark: SparkSession, tmp_path, monkeypatch: pytest.MonkeyPatch, english: bool, most: int) -> None:
    monkeypatch.setattr(postings, "FILTER_TERMS", most)
    r = random.Random(6)
    words = ["the", "Tenant", "tenants", "evicted", "eviction", "evict", "notice", "notices", "rent", "rents", "12", "é", "K", "of"]
    texts = [(i, " ".join(r.choices(words, k=r.randint(1, 12)))) for i in range(80)] + [(90, None), (91, ""), (92, "of the"), (93, "rent " * 3000)]
    queries = [(0, "evictions of tenants"), (1, "rent"), (2, "12"), (3, "of the"), (4, None), (5, "  no "), (6, "notice notice rent"), (7, "absent rent")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "id long, text string, term string, tf int").repartition(3)
    asked = spark.createDataFrame(queries, "query_id int, asked string")
    index = postings.Postings.write(docs, str(tmp_path / "index"), english, buckets=5, slices=3)
    got = sorted((x["query_id"], x["id"], round(x["score"], 6), x["rank"]) for x in index.bm25(asked, 7).collect())
    assert got == brute_bm25(texts, queries, 7, english)
    every = {(q, i) for q, i, *_ in brute_bm25(texts, queries, 10**6, english)}
    assert {tuple(x) for x in index.matching_all(asked).collect()} == every
    phrases = Counter()
    for q, said in queries:
        want = words_of(said, english) if len((said or "").strip(" ")) > 2 else []
        for i, t in texts:
            own = words_of(t, english)
            hits = sum(all(w is None or own[at + n] == w for n, w in enumerate(want)) for at in range(len(own) - len(want) + 1)) if any(want) else 0
            if hits:
                phrases[q, i] = hits
    found = {(x["query_id"], x["id"]): x["n"] for x in index.phrase(asked).collect()}
    if not english:  # a stop word at an end may reach beyond the text
        assert found == dict(phrases)
    if not english and most == 1000:
        scan = retrieval.bm25(docs, {0: ["tenants", "rent"]}, 5)
        own = index.bm25(spark.createDataFrame([(0, "tenants rent")], "query_id int, asked string"), 5)
        assert sorted(map(str, scan.select("id", "score", "rank").collect())) == sorted(map(str, own.select("id", "score", "rank").collect()))


def test_a_search_reads_its_buckets_only(spark: SparkSession, tmp_path) -> None:
    docs = spark.createDataFrame([(i, f"word{i % 9} common") for i in range(50)], "id long, text string")
    index = postings.Postings.write(docs, str(tmp_path / "index"), buckets=8)
    asked = index.asked(spark.createDataFrame([(0, "word3")], "query_id int, asked string"))
    rows = index.postings(asked)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket#" in plan.replace("isnotnull(bucket", "bucket") or "PartitionFilters" in plan
    assert {(r["term"], r["dl"]) for r in rows.collect()} == {("word3", 2)}
    empty = postings.Postings.write(docs.limit(0), str(tmp_path / "empty"))
    assert empty.bm25(spark.createDataFrame([(0, "word3")], "query_id int, asked string"), 3).count() == 0


def test_english_search_over_the_small_tables(spark: SparkSession) -> None:
    sf_dir = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    queries = [(r["item_id"], " ".join(r["text"].split(" ")[:4])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = sorted((r["query_id"], r["id"], round(r["score"], 6), r["rank"]) for r in QUERIES["english_search"](spark, sf_dir).collect())
    want = brute_bm25(texts, queries, 10, True)
    assert [(x[0], x[3]) for x in got] == [(x[0], x[3]) for x in want]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))
