"""The training-data operators against brute force, on small fixtures and the small tables."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import string
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.llm import bpe, language, licenses, mixing, quality, simhash, sketches, suffixes, topk

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept string, fp int"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def passage(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))


def fixture_rows() -> list[tuple]:
    shared = passage(1, 60)
    texts = {
        1: "Start " + shared + " end",
        2: passage(2, 30) + " " + shared + passage(3, 10),
        3: None,
        4: "",
        5: "a" * 1000,
        6: "The MIT License\nreleased under the mit license\n" + passage(4, 40),
        7: passage(5, 80),
        8: passage(5, 80),
        9: passage(5, 79) + " other",
        10: "é" * 300 + " " + "日本語" * 100,
        11: " \n\t ",
        12: passage(6, 4000),
        13: "ab" * 300 + "Z",
        14: "\n".join(["same line"] * 50),
    }
    rows = [(i, t, "en", "s%d" % (i % 3) if i != 7 else None, len(t or ""), "x", "y", 0) for i, t in texts.items()]
    return [*rows, rows[6], (None, "no id " + shared, None, "s0", 10, None, None, None), (7, "another text under a used id", "fr", "s1", 5, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixture_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def small(spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def pairs_of(df: DataFrame) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 1


def brute_removal(rows: list[tuple]) -> list[tuple]:
    seen: Counter = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[s : s + 200] for s in range(len(b) - 199))
    out = []
    for i, b in data:
        step = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                step[s] += 1
                step[s + 200] -= 1
        gone = np.cumsum(step[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [suffixes.HOT_CONTEXTS, 1])
@pytest.mark.parametrize("which", ["docs", "small"])
def test_removal(request: pytest.FixtureRequest, which: str, hot: int) -> None:
    df = request.getfixturevalue(which)
    found = suffixes.without_repeats(df.select("doc_id", "text"), hot_contexts=hot)
    got = found.select(F.col("doc.doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_removal(pairs_of(df))


def test_removal_of_many_equal_rows_and_null_ids(spark: SparkSession) -> None:
    shared, own = passage(31, 80), passage(32, 80)
    many = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(shared).alias("text"))
    none = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("row "), F.col("id").cast("string"), F.lit(" "), F.sha2(F.col("id").cast("string"), 512), F.sha2((-F.col("id")).cast("string"), 512)).alias("text"))
    few = spark.createDataFrame([(1, own + shared + "!"), (None, own + "?"), (None, None), (2, "")], "doc_id long, text string")
    found = suffixes.removal_digests(many.unionByName(none).unionByName(few))
    sums = {r["doc_id"]: r for r in found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("b"), F.sum("n_removed").alias("r")).collect()}
    assert (sums[7]["n"], sums[7]["b"], sums[7]["r"]) == (20_000, 20_000 * len(shared), 20_000 * len(shared))
    assert (sums[1]["b"] - sums[1]["r"], sums[2]["n"]) == (1, 1)
    assert (sums[None]["n"], sums[None]["r"]) == (20_002, len(own))
    assert suffixes.removal_digests(few.limit(0)).count() == 0


def test_removal_from_a_long_text(spark: SparkSession) -> None:
    shared, long = passage(33, 60), passage(34, 250_000)
    df = spark.createDataFrame([(1, long[:900_000] + shared + long[900_000:]), (2, "x " + shared)], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffixes.removal_digests(df).collect()} == {1: (len(shared), 1), 2: (len(shared), 1)}


def test_suffixes_are_sorted() -> None:
    text = np.frombuffer((passage(9, 50) * 3 + "a" * 400).encode(), np.uint8)
    starts = np.arange(len(text) - 200)
    order, lcp = suffixes.deep_shallow_sort(suffixes._words(text), starts, np.zeros(len(starts), np.int64), np.full(len(starts), 200))
    raw = text.tobytes()
    cut = [raw[s : s + 200] for s in starts[order]]
    assert cut == sorted(cut)
    for a, b, n in zip(cut, cut[1:], lcp[1:], strict=False):
        assert a[:n] == b[:n] and (n == 200 or a[n] != b[n])


def test_texts_without_repeats_keeps_the_columns(docs: DataFrame) -> None:
    out = suffixes.texts_without_repeats(docs)
    assert out.dtypes == docs.dtypes
    assert out.count() == docs.count()


# 2


def test_quality_keeps_good_and_drops_bad(spark: SparkSession) -> None:
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality.quality_scores(base, labels)
    assert found.count() == base.count()
    share = {r["quality"]: r["kept"] for r in found.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert share[1] > 0.99
    assert share[0] < 0.1
    again = {r["doc_id"] for r in found.where("kept").collect()}
    assert {r["doc_id"] for r in quality.good_documents(base, labels).select("doc_id").collect()} == again


def test_quality_scores_are_the_mean_ratios(spark: SparkSession, docs: DataFrame) -> None:
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 1, None), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    found = quality.quality_scores(docs, labels).collect()
    assert len(found) == docs.count()
    ratio = quality.ratios(docs, quality.labelled_sample(labels))
    texts = pairs_of(docs)
    for doc_id, text in texts:
        data = np.frombuffer((text or "").encode(), np.uint8)
        bucket, _ = quality.ngrams(data, np.array([0, len(data)]))
        want = ratio[bucket].mean() if len(bucket) else 0.0
        assert any(r["doc_id"] == doc_id and abs(r["log_weight"] - want) < 1e-9 for r in found)


def test_quality_draw_against_brute_force(spark: SparkSession) -> None:
    """Models, cut and draw written out again over words; hashes and noise are the operator's."""
    r = random.Random(23)
    texts = [" ".join(r.choices(("fine", "good", "words", "here", "now") if k % 3 else ("junk", "$$$", "buy", "now"), k=12)) for k in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(0, 60)] * 2, "doc_id long, quality int")

    def buckets(text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        return quality.ngrams(data, np.array([0, len(data)]))[0].tolist()

    assert len(buckets("fine good good")) == 5 and len(set(buckets("a a b b"))) == 4
    raw, target = Counter(), Counter()
    for k, t in enumerate(texts):
        raw.update(buckets(t))
        if k < 60 and k % 3:
            target.update(buckets(t))
    size = quality.BUCKETS
    ratio = {b: math.log((target[b] + 1) / (target.total() + size)) - math.log((raw[b] + 1) / (raw.total() + size)) for b in raw}
    means = [sum(ratio[b] for b in buckets(t)) / len(buckets(t)) for t in texts]
    known = sorted((means[k], k % 3 > 0) for k in range(60))
    options = [(sum(not g for m, g in known if m < c) / 20 - quality.GOOD_WEIGHT * sum(g for m, g in known if m < c) / 40, -c) for c in {m for m, _ in known}]
    best = -max(options)[1]
    best = (best + max(m for m, _ in known if m < best)) / 2
    k = sum(m >= best for m in means)
    noise = {r["id"]: r["u"] for r in spark.range(90).select("id", ((F.shiftrightunsigned(F.xxhash64("id", F.lit(quality.SEED)), 12).cast("double") + 0.5) / float(1 << 52)).alias("u")).collect()}
    keys = {i: means[i] * quality.EFFECTIVE_NGRAMS - math.log(-math.log(noise[i])) for i in range(90)}
    want = set(sorted(keys, key=keys.get, reverse=True)[:k])
    found = quality.quality_scores(df, labels).collect()
    assert {x["doc_id"] for x in found if x["kept"]} == want
    assert all(x["log_weight"] == pytest.approx(means[x["doc_id"]]) for x in found)


def test_quality_without_labels_keeps_everything(spark: SparkSession, docs: DataFrame) -> None:
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.good_documents(docs, none).count() == docs.count()
    assert quality.good_documents(docs.limit(0), none).count() == 0


def test_kth_largest(spark: SparkSession) -> None:
    keys = [random.Random(3).randrange(1 << 48) for _ in range(50)] + [5, 5, 5]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    for k in (1, 7, 50, 51, 53):
        assert quality.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]


# 4


def test_license_places(docs: DataFrame) -> None:
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    found = licenses.license_labels(docs).collect()
    want = []
    for i, text in pairs_of(docs):
        words = word.findall((text or "").translate(LOWER))
        at = [(k, label) for k in range(len(words)) for p, label in licenses.PHRASES if words[k : k + len(p.split())] == p.split()]
        want.append((i, len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found), key=str) == sorted(want, key=str)


def test_license_blocks_against_all_pairs(spark: SparkSession) -> None:
    lines = [t for t, _ in licenses.TEMPLATES] + [passage(8, 30), "licensed under cc by nc 4", " ".join(licenses.TEMPLATES[0][0].split()[2:]), passage(10, 70) + " " + licenses.TEMPLATES[5][0] + " " + passage(11, 60)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    for r in licenses.scan(df).collect():
        words = lines[r["doc_id"]].split()
        blocks = [words[k : k + licenses.BLOCK_WORDS] for k in range(0, max(1, len(words)), licenses.BLOCK_WORDS // 2)]
        want = set()
        for text, label in licenses.TEMPLATES:
            t = set(text.split())
            if any(len(t & set(b)) >= licenses.THRESHOLD * len(t) - 1e-9 for b in blocks):
                want.add(label)
        assert {b["label"] for b in r["blocks"]} == want


def test_license_notices_wrapped_over_lines(spark: SparkSession) -> None:
    rows = []
    for i, (text, label) in enumerate(licenses.TEMPLATES):
        words = text.split()
        for width in (3, 5, 8):
            for ahead in (0, 23, 24, 47):
                lines = [" ".join(words[k : k + width]) for k in range(0, len(words), width)]
                rows.append((len(rows), f"{passage(i, ahead)}\n# " + "\n# ".join(lines) + f"\n\n{passage(i + 50, 30)}", label))
    found = licenses.license_labels(spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(2)).collect()
    labels = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows)
    for doc_id, _, label in rows:
        assert label in labels[doc_id]["labels"].split(",")
        assert labels[doc_id]["score"] >= licenses.THRESHOLD


def test_license_lines_still_count_by_themselves(spark: SparkSession) -> None:
    words = licenses.TEMPLATES[11][0].split()
    line = " ".join([*words[:9], passage(20, 48 - len(words)), *words[9:]])
    df = spark.createDataFrame([(k, passage(21, k) + "\n" + line) for k in range(1, 40)], "doc_id long, text string")
    assert {r["labels"] for r in licenses.license_labels(df).collect()} == {"bsd"}


def test_license_of_empty_tables_and_long_texts(spark: SparkSession) -> None:
    long = passage(22, 60_000) + "\nmit license\n" + passage(23, 60_000)
    df = spark.createDataFrame([(1, long), (1, long), (None, None)], "doc_id long, text string")
    found = sorted(((r["doc_id"], r["n_words"], r["first_word"]) for r in licenses.license_labels(df).collect()), key=str)
    assert found == [(1, 120_002, 60_000), (1, 120_002, 60_000), (None, 0, None)]
    assert licenses.license_labels(df.limit(0)).count() == 0


# 5


def test_mixture_is_less_than_a_block_off(spark: SparkSession) -> None:
    quotas = spark.createDataFrame([("a", 270), ("b", 100), ("c", 1), (None, 13), ("d", 128)], "source string, quota int")
    plan = mixing.frame(quotas).collect()
    total = 512
    assert sorted(r["slot"] for r in plan) == list(range(total))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in plan)
    slots = {r["slot"]: r["source"] for r in plan}
    had: Counter = Counter()
    for t in range(total):
        had[slots[t]] += 1
        for r in quotas.collect():
            assert abs(had[r["source"]] - (t + 1) * r["quota"] / total) < 1


def test_mixture_meets_given_weights_over_many_frames(spark: SparkSession) -> None:
    rows = spark.range(100_000).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, "aaaaabbbccd")), (F.col("id") % 11 + 1).cast("int")).alias("source"))
    targets = {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0, "e": 0}
    found = mixing.mixture(rows, targets)
    assert found.count() == 100_000
    assert found.where("slot is null").select("source").distinct().collect() == [("d",)]
    slots = [(r["slot"], r["source"]) for r in found.where("slot < 8000").select("slot", "source").distinct().orderBy("slot").collect()]
    assert [t for t, _ in slots] == list(range(8000))
    had: Counter = Counter()
    for t, source in slots:
        had[source] += 1
        assert all(abs(had[s] - Fraction(str(w)) * (t + 1)) < 1 for s, w in targets.items())
    with pytest.raises(ValueError):
        mixing.exact_quotas({"a": 0.123456789, "b": 1})


def test_mixture_keeps_all_rows(docs: DataFrame) -> None:
    found = mixing.mixture(docs).collect()
    assert len(found) == docs.count()
    assert len({(r["slot"], r["place"]) for r in found}) == len(found)
    out = mixing.mixed(docs)
    assert out.dtypes == docs.dtypes
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert mixing.mixed(docs.limit(0)).count() == 0


# 6


def likeness(a: str, b: str) -> float:
    sets = []
    for text in (a, b):
        seen: Counter = Counter()
        own = set()
        for line in text.split("\n"):
            if line.strip():
                own.add((line, seen[line]))
                seen[line] += 1
        sets.append(own)
    either = sets[0] | sets[1]
    return len(sets[0] & sets[1]) / len(either) if either else 1.0


def test_fingerprints(small: DataFrame) -> None:
    rows = sorted(pairs_of(small), key=lambda r: -r[0])
    found = {r["doc_id"]: r for r in sketches.fingerprints(small).collect()}
    assert len(found) == len(rows)
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        changed = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        r = found[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(likeness(text, changed))
        assert r["near_next"] == pytest.approx(likeness(text, after))
    by_text: dict[str, set] = {}
    for i, text in rows:
        by_text.setdefault(text, set()).add(found[i]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprints_of_odd_rows(docs: DataFrame) -> None:
    assert sketches.fingerprints(docs).count() == docs.count()
    assert sketches.fingerprints(docs.limit(0)).count() == 0


def test_sketches_recover_the_difference() -> None:
    r = random.Random(4)
    common, a, b = ([r.getrandbits(64) for _ in range(n)] for n in (40, 3, 2))
    apart = sketches.Sketches(1, 24).add(*sketches._flat([common + a])).minus(sketches.Sketches(1, 24).add(*sketches._flat([common + b])))
    done, _, keys, side = apart.peel()
    assert done[0]
    assert {(int(k), int(s)) for k, s in zip(keys, side, strict=True)} == {(k, 1) for k in a} | {(k, -1) for k in b}


# 7


def test_language_on_held_out_rows(spark: SparkSession) -> None:
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.predicted(base)
    joined = found.join(base.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert joined.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_language_of_odd_rows(spark: SparkSession) -> None:
    rows = [(i, "the cat sat on the mat", "en") for i in range(8)] + [(20, None, "en"), (21, "123 -- 45", "en"), (22, "", None), (None, "the mat", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in language.predicted(df).collect()}
    assert [found[i]["lang_pred"] for i in (0, 20, 21, 22, None)] == ["en", "und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in found.values())
    nothing = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.predicted(nothing).collect()} == {"und"}
    assert language.predicted(df.limit(0)).count() == 0


def test_forward_sums_all_segmentations() -> None:
    pieces = language.Pieces(["▁", "a", "b", "ab", "▁a", "▁ab"])
    chance = np.array([[0.1], [0.2], [0.3], [0.05], [0.25], [0.1], [1e-7]])
    lattice, size = pieces.lattice(["▁ab"])
    want = 0.1 * 0.2 * 0.3 + 0.1 * 0.05 + 0.25 * 0.3 + 0.1
    assert language.forward(lattice, size, chance)[0, 3, 0] == pytest.approx(want)


def brute_log(word: str, pieces: dict[str, float], unknown: float) -> float:
    """The sum over all segmentations, in exact fractions."""
    sums = [Fraction(1)]
    for end in range(1, len(word) + 1):
        sums.append(sum(sums[s] * Fraction(pieces.get(word[s:end], unknown if end - s == 1 else 0)) for s in range(max(0, end - 5), end)))
    return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)


def test_long_words_sum_all_segmentations() -> None:
    r = random.Random(17)
    names = sorted({"".join(r.choices("abc", k=n)) for n in (1, 2, 3, 5) for _ in range(6)} | {"▁a", "abcab"})
    chance = np.array([[r.random() / 20, r.random() / 9] for _ in names] + [[1e-7, 1e-7]])
    pieces = language.Pieces(names)
    words = ["▁" + "".join(r.choices("abcd", k=n)) for n in (1, 40, 41, 511, 512, 513, 1500)]
    got = pieces.log_sums(words, chance)
    for k in range(2):
        given = dict(zip(names, chance[:, k].tolist(), strict=False))
        assert got[:, k] == pytest.approx([brute_log(w, given, 1e-7) for w in words], rel=1e-9)
    lattice, size = pieces.lattice(words[:2])
    assert np.log(language.forward(lattice, size, chance)[[0, 1], size]) == pytest.approx(got[:2], rel=1e-9)


def test_expected_counts_of_a_long_word() -> None:
    """A count is the change of the log sum with the log chance of its piece."""
    r = random.Random(18)
    names = ["a", "b", "ab", "ba", "aba", "▁"]
    chance = np.array([[r.random() / 9] for _ in names] + [[1e-7]])
    pieces, word, h = language.Pieces(names), "▁" + "".join(r.choices("ab", k=900)), 1e-6
    log = pieces.log_sums([word], chance)[0, 0]
    got = language.expected_counts(*pieces.lattice([word]), np.array([3.0]), chance, np.array([np.exp(-log / len(word))]))
    for k in range(len(names)):
        more = chance.copy()
        more[k] *= 1 + h
        assert got[k] == pytest.approx(3 * (pieces.log_sums([word], more)[0, 0] - log) / h, rel=1e-3)


def test_language_of_texts_without_blanks_and_many_languages(spark: SparkSession) -> None:
    r = random.Random(19)
    rows = [(4 * k, "".join(r.choices(letters, k=3000)), lang) for lang, letters in (("p", "abcde"), ("q", "vwxyz")) for k in range(6)]
    rows += [(1000 + k, "".join(r.choices(letters, k=10_000)), None) for k, letters in enumerate(("abcde", "vwxyz"))]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string")
    found = {x["doc_id"]: x["lang_pred"] for x in language.predicted(df).collect()}
    assert (found[1000], found[1001]) == ("p", "q")
    many = spark.range(600).select("id", F.concat(F.lit("l"), F.lpad((F.col("id") % 150).cast("string"), 3, "0")).alias("lang"))
    many = many.select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sha2("lang", 256), F.sha2("lang", 224)).alias("text"), "lang")
    counts = language.training_words(many).select("lang").distinct().count()
    assert counts == 150


# 8


def test_bpe_as_the_library(docs: DataFrame, small: DataFrame) -> None:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.RANK_FILE), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (docs, small):
        found = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.token_digests(df).collect()), key=str)
        want = []
        for i, text in pairs_of(df):
            ids = library.encode_ordinary(text or "")
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
        assert found == sorted(want, key=str)
        encoded = bpe.encoded(df).select("doc_id", "ids")
        assert sorted(map(str, ((r["doc_id"], r["text"]) for r in bpe.decode(encoded).collect()))) == sorted(map(str, ((i, t or "") for i, t in pairs_of(df))))


def test_bpe_of_wide_words_and_an_empty_table(spark: SparkSession) -> None:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.RANK_FILE), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(12)
    texts = ["".join(r.choices("abcdefgh", k=n)) for n in (257, 600, 2048, 2049, 12_000)] + [passage(13, 300_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x["doc_id"]: x for x in bpe.encoded(df).collect()}
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text)
        assert np.frombuffer(found[i]["ids"], "<u4").tolist() == ids
        assert found[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.token_digests(df.limit(0)).count() == 0


# 9


def test_top_k_with_ties_and_odd_vectors(spark: SparkSession) -> None:
    r = random.Random(5)
    rows = [(i, [r.randint(-3, 3) / 4 for _ in range(8)]) for i in range(-50, 350)]
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (400, rows[3][1]), (None, rows[3][1]), (7, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    sound = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in sound:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in sound if i != q)
            want += [(q, k, i, -s) for k, (s, i) in enumerate(scored[:10], 1)]
    assert sorted(tuple(x) for x in topk.top_k(df).collect()) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_repeated_queries_and_large_parts(spark: SparkSession) -> None:
    df = spark.createDataFrame([(100, [3.0, 0.0]), (100, [1.0, 9.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    for parts in (1, 3):
        got = [tuple(x) for x in topk.top_k(df.repartition(parts)).orderBy("query_id", "rank").collect()]
        assert got == [(100, 1, 2, 9 << 20), (100, 2, 1, 1 << 20)]
    with pytest.raises(Exception, match="too large"):
        topk.top_k(spark.createDataFrame([(0, [1e300]), (1, [1.0])], df.schema)).collect()


# 10


def brute_components(rows: list[tuple]) -> list[tuple]:
    prints = []
    for _, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(LOWER).encode())
        grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        counts = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
        prints.append(sum(1 << b for b in range(64) if counts[b] * 2 > len(grams)))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least: dict[int, int | None] = {}
    for g, (i, _) in zip(group, rows, strict=True):
        least[g] = i if least.get(g) is None else (least[g] if i is None else min(i, least[g]))
    return sorted(((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, group, strict=True)), key=str)


@pytest.mark.parametrize("which", ["docs", "small"])
def test_near_duplicates(request: pytest.FixtureRequest, which: str) -> None:
    df = request.getfixturevalue(which)
    assert sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str) == brute_components(pairs_of(df))


def test_links_of_close_fingerprints(spark: SparkSession) -> None:
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(6)]
    values = {b ^ sum(1 << k for k in r.sample(range(64), n)) for b in base for n in range(7) for _ in range(6)}
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    alone = nodes.select("fp", F.col("fp").alias("root"))
    got = {tuple(x) for x in simhash.links(nodes, alone).select("a", "b").collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    wide = {tuple(x) for x in simhash.links(nodes, alone, 5).select("a", "b").collect()}
    assert wide == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 5}


def test_crowded_fingerprints_are_connected_by_few_links(spark: SparkSession) -> None:
    r = random.Random(7)
    values = [b ^ sum(1 << k for k in r.sample(range(64), r.randrange(5))) for b in (r.getrandbits(64) for _ in range(3)) for _ in range(150)]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    first = simhash._first_links(nodes, 5)
    groups = simhash.components(nodes, first)
    left = {(x["a"], x["b"]) for x in simhash.links(nodes, groups, 5).collect()}
    near = {(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 5}
    chosen = {tuple(x) for x in first.collect()}
    assert chosen <= near
    root = {x["fp"]: x["root"] for x in groups.collect()}
    assert left == {(a, b) for a, b in near if root[a] != root[b]}
    assert len(left) * 10 < len(near)


def test_one_row_of_each_group_stays(spark: SparkSession, docs: DataFrame) -> None:
    texts = [passage(40 + k, 60) for k in range(4)]
    rows = [(7, texts[0], 1), (7, texts[0], 1), (None, texts[0], 2), (None, texts[1], 3), (None, texts[1], 3), (9, texts[2] + " x", 4), (9, texts[2], 5), (3, texts[2], 6), (9, texts[3], 7)]
    out = simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string, fp int").repartition(4)).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"], r["fp"]) for r in out))) == sorted(map(str, [rows[0], rows[3], rows[7], rows[8]]))
    groups = {r["top"] for r in simhash.simhash_components(docs).collect()}
    assert simhash.one_of_each_group(docs).count() == len(groups)


def test_near_duplicates_of_nothing(docs: DataFrame) -> None:
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.one_of_each_group(docs).dtypes == docs.dtypes
