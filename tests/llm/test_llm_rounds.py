"""Merges by a tokenizer file, vector codes and divergence of sources, against the library, SQL and brute force."""

from __future__ import annotations

import hashlib
import json
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from clausegrid.llm import codes, divergence, merges

SF_DIR = "/root/testdata/sf0.001"
FILE = public_tokenizers.path(merges.MERGE_FILE)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, tile int, value string, rank int"


def odd_texts() -> list[str | None]:
    r = random.Random(3)
    return [
        None,
        "",
        " \n\t ",
        "a" * 3001,
        "ab" * 1500,
        " " * 700 + "x",
        "".join(r.choice("abAB01+/") for _ in range(9000)),
        "x<|endoftext|>y <|endoftext|><|endoftext|>",
        "՘a \U000323b0b 1\U00011de0 <|endoftext|>՘",
        "日本語" * 900 + "é",
        "".join(chr(r.choice([r.randrange(32, 0x3000), r.randrange(0x10000, 0x3FC3F)])) for _ in range(3000)),
        "I'll say it's 12,000 o'clock",
    ]


# 11


def test_tokens_are_those_of_the_library(spark: SparkSession) -> None:
    texts = [*odd_texts(), *(r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect())]
    rows = [*enumerate(texts), (1, "x"), (None, "I'll say")]
    out = merges.encoded(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    library = Tokenizer.from_file(FILE)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    back = {r["doc_id"]: r["text"] for r in merges.decoded(out.where("doc_id > 1")).collect()}
    assert back == {i: t or "" for i, t in rows if i is not None and i > 1}


def test_tokens_of_an_empty_table_and_of_other_columns(spark: SparkSession) -> None:
    df = spark.createDataFrame([(1, "a", "en", "s", 1, "x", 2, "y", 3)], DOCS)
    assert [tuple(r)[:2] for r in merges.token_digests(df).collect()] == [(1, 1)]
    assert merges.token_digests(df.limit(0)).count() == 0
    assert merges.decoded(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).count() == 2


@pytest.mark.parametrize("ordered", [True, False])
def test_rounds_equal_one_merge_after_another(ordered: bool) -> None:
    with open(FILE, "rb") as f:
        table = merges.Merges(f.read())
    table.ordered, table.span = ordered, 3
    r = random.Random(8)
    made = json.load(open(FILE))["model"]
    rank = {tuple(m): k for k, m in enumerate(made["merges"])}
    signs = merges.byte_signs()
    words = ["".join(r.choice("aeinst") for _ in range(r.choice([1, 2, 5, 9]))).encode() for _ in range(60)]
    want = []
    for w in words:
        s = [signs[b] for b in w]
        while len(s) > 1:
            best = min(range(len(s) - 1), key=lambda k: (rank.get((s[k], s[k + 1]), 10**9), k))
            if (s[best], s[best + 1]) not in rank:
                break
            s[best : best + 2] = [s[best] + s[best + 1]]
        want.append([made["vocab"][x] for x in s])
    ids, counts = table.merge(words)
    assert np.split(ids, np.cumsum(counts)[:-1])[5].tolist() == want[5]
    assert ids.tolist() == [i for x in want for i in x]


def test_an_unusual_tokenizer_is_refused(tmp_path) -> None:
    made = json.load(open(FILE))
    made["model"]["byte_fallback"] = True
    with pytest.raises(ValueError, match="byte_fallback"):
        merges.Merges(json.dumps(made).encode())


# 12


def brute_codes(rows: list[tuple]) -> list[tuple]:
    kept = [(i, lab, [int(np.floor(float(c) * 1024)) for c in v]) for i, v, lab in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = -(-max((len(x) for *_, x in kept), default=0) // 4) * 4
    kept = [(i, lab, x + [0] * (width - len(x))) for i, lab, x in kept]
    own = width // 4
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:256]
    books = [[x[p * own : (p + 1) * own] for *_, x in first] for p in range(4)]
    far = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b, strict=True))

    def assign(x: list[int], p: int) -> tuple[int, int]:
        return min((far(x[p * own : (p + 1) * own], c), e) for e, c in enumerate(books[p]))

    for _ in range(4):
        new = []
        for p in range(4):
            groups = defaultdict(list)
            for *_, x in kept:
                groups[assign(x, p)[1]].append(x[p * own : (p + 1) * own])
            new.append([[sum(c) // len(c) for c in zip(*groups[e], strict=True)] if e in groups else c for e, c in enumerate(books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    done = [(i, lab, [assign(x, p) for p in range(4)]) for i, lab, x in kept]
    errors: Counter = Counter()
    for _, lab, a in done:
        errors[lab] += sum(d for d, _ in a)
    return sorted(((i, "".join(f"{e:02x}" for _, e in a), sum(d for d, _ in a), errors[lab], digest) for i, lab, a in done), key=str)


def test_codes_of_odd_vectors(spark: SparkSession) -> None:
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)], r.choice([None, 0, 1])) for i in range(300)]
    rows += [(5, rows[5][1], 0), (None, rows[7][1], 1), (400, None, 1), (401, [0.5, None, 1.0, 2.0, 1.0, 1.0, 1.0, 1.0], 1), (402, [float("nan")] * 8, 1), (403, [float("inf")] * 8, 1), (404, [1.0] * 6, None), (405, [], 2)]
    df = spark.createDataFrame([(*x, "c", 1, [0]) for x in rows], "vec_id long, embedding array<float>, label int, code string, error int, x array<int>").repartition(3)
    floats = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    got = codes.compressed(df)
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(floats)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codes.compressed(df.limit(0)).count() == 0
    assert [tuple(r)[1:3] for r in codes.compressed(df.where("vec_id = 405")).collect()] == [("", 0)]


def test_few_vectors_are_their_own_entries(spark: SparkSession) -> None:
    rows = spark.createDataFrame([(k, [float(k), 0.25, -1.5, 2.0]) for k in (3, 1, 2)], "vec_id long, embedding array<double>").selectExpr("*", "1 as label")
    own = codes.quantized(rows)
    books = codes.codebooks(own)
    found = codes.encoded(own, books)
    assert {(r["vec_id"], r["code"], r["error"]) for r in found.collect()} == {(1, "00000000", 0), (2, "01000000", 0), (3, "02000000", 0)}
    assert {r["vec_id"]: r["x"] for r in codes.decoded(found, books).collect()} == {r["vec_id"]: r["x"] for r in own.collect()}


def test_too_large_components_are_an_error(spark: SparkSession) -> None:
    df = spark.createDataFrame([(0, [2.0**24] * 4, 1), (1, [-(2.0**24)] * 4, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="too large"):
        codes.compressed(df).collect()
    x = np.array([[2**28]], np.int64)
    assert codes.nearest(x, -x) == (0, 2**58)


# 13


def brute_divergence(rows: list[tuple]) -> list[tuple]:
    docs = [tuple(x or "" for x in r) for r in rows]
    terms = [Counter(re.findall(r"[a-z\u0080-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))) for t, *_ in docs]
    out = []
    for lang in {d[1] for d in docs}:
        df, groups = Counter(), defaultdict(Counter)
        for (_, own, source), n in zip(docs, terms, strict=True):
            if own == lang:
                df.update(n.keys())
                groups[source].update(n)
        kept = [t for t in df if df[t] >= 3]

        def share(n: Counter, t: str) -> int:
            return 1 + Fraction(10**9 * (n[t] + 1), sum(n[k] for k in kept) + len(kept)).__floor__()  # noqa: B023

        every = sum(groups.values(), Counter())
        for s, n in groups.items():
            pairs = [(sum((share(n, t) - share(o, t)) ** 2 // share(o, t) for t in kept), k) for k, o in groups.items() if k != s]
            own = [((share(n, t) - share(every, t)) ** 2 // share(every, t), t) for t in kept if n[t] and share(n, t) > share(every, t)]
            for part, found in (("pair", pairs), ("term", own)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, k, v, i) for i, (v, k) in enumerate(ranked, 1) if part == "pair" or i <= 200]
    return sorted(out)


def found_in(df: DataFrame, **how: int) -> list[tuple]:
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.divergence(df, **how).collect())


@pytest.mark.parametrize("dense", [0.0, 0.5, 2.0])
def test_divergence_of_odd_rows(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, dense: float) -> None:
    r = random.Random(11)
    words = ["Ab", "ab", "é", "É", "日本", "x", "z9q", "-", "the", "o'clock"] + ["w" + chr(97 + k) + "q" * (k % 3) for k in range(26)]
    rows = [(" ".join(r.choices(words, range(len(words), 0, -1), k=r.randint(0, 30))), r.choice(["en", "fr", None, ""]), r.choice(["s1", "s2", "S2", "é", None, "s10"])) for _ in range(120)]
    rows += [rows[0]] * 4 + [(None, "en", "none"), ("1 2 3", "xx", "a"), ("once", "xx", "b"), ("", "yy", "alone"), ("x " * 70_000, "en", "s1")]
    df = spark.createDataFrame([(i, t, lang, s, 1, "n", 1, "v", 2) for i, (t, lang, s) in enumerate(rows)], DOCS)
    monkeypatch.setattr(divergence.Chunk.__init__, "__defaults__", (dense,))
    part = divergence.Chunk(np.array([0, 0, 1]), np.array([0, 2, 1]), np.array([5, 1, 2]), np.array([9, 9, 9]), dense)
    assert len(part.tile) == (dense == 0.0) or dense == 0.5
    want = brute_divergence(rows)
    assert found_in(df.repartition(3)) == want
    assert found_in(df, chunk=40, tile=2) == want
    assert divergence.divergence(df.limit(0)).count() == 0


def test_shares_are_exact() -> None:
    counts, total = np.array([0, 6, 10**15, 9 * 10**15 - 1]), 9 * 10**15
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


@pytest.mark.parametrize("which", ["embeddings", "documents"])
def test_small_tables_against_sql(spark: SparkSession, which: str) -> None:
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {which} AS FROM '{SF_DIR}/{which}.parquet'")
    run, sql = {"embeddings": (codes.compressed, codes.CODES_SQL), "documents": (divergence.divergence, divergence.DIVERGENCE_SQL)}[which]
    want = con.sql(sql)
    got = run(spark.read.parquet(f"{SF_DIR}/{which}.parquet"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
