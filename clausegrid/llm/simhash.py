"""SimHash near-duplicate groups through deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ
in four bits or fewer have a segment that differs in one bit or none, so they
agree on that segment with one bit blanked out. Every fingerprint is indexed
under its 64 blanked segments, an equality join finds the candidates, and the
join condition checks the distance and keeps each pair under one key only.

Only distinct fingerprints are joined, so exact copies cost one row however
many they are. Before the join, every fingerprint is linked to the one before it
and the first one under each key, where they are near enough, and what these
links connect is contracted; the join then returns no pair whose ends are in one
group already, so crowded neighbourhoods do not return all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.llm.common import cut, slices, under_plain_names, utf8

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
#: First bit of each segment, and the end.
SEGMENTS = (0, 21, 42, 64)


def fingerprint_of(data: bytes, width: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text's bytes, unsigned; zero without words."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        bits = np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _text_key() -> list[Column]:
    """128 bits of a text, by which equal rows know each other; null as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("tx"), F.xxhash64(F.lit(1), text).alias("ty")]


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, tx and ty, which tell texts apart, and the fingerprint as a signed 64-bit integer; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, at = utf8(batch.column("text"))
            raw = data.tobytes()
            found = np.array([fingerprint_of(raw[a:b], width) for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "tx", "ty")), pa.array(found.view(np.int64))], ["doc_id", "tx", "ty", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), *_text_key())
    return rows.mapInArrow(run, "doc_id long, tx long, ty long, fp long")


def _mask(k: int) -> int:
    m = (1 << SEGMENTS[k + 1]) - (1 << SEGMENTS[k])
    return m - (1 << 64) if m >> 63 else m


def _variants(nodes: DataFrame) -> DataFrame:
    """64 rows a fingerprint: the bit that is blanked out, and its segment without that bit."""
    parts = []
    for k in range(3):
        bits = F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(_mask(k))), SEGMENTS[k])
        for p in range(SEGMENTS[k], SEGMENTS[k + 1]):
            blank = ~(1 << (p - SEGMENTS[k]))
            parts.append(bits.bitwiseAND(F.lit(blank)).bitwiseOR(F.lit(p << 32)))
    return nodes.withColumn("key", F.explode(F.array(*parts)))


def _first_key(x: Column) -> Column:
    """The bit under which a pair with difference ``x`` is reported: of the first segment that differs in at most one bit."""
    out = F.lit(None).cast("int")
    for k in reversed(range(3)):
        part = x.bitwiseAND(F.lit(_mask(k)))
        one = F.lit(SEGMENTS[k])
        for p in range(SEGMENTS[k] + 1, SEGMENTS[k + 1]):
            bit = 1 << p
            one = F.when(part == F.lit(bit - (1 << 64) if p == 63 else bit), p).otherwise(one)
        out = F.when(F.bit_count(part) <= 1, one).otherwise(out)
    return out


def _first_links(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Pairs at ``max_bits`` or fewer, of each fingerprint and at most two others under each of its keys: the one before it in order, and the first.

    Their number grows with the fingerprints, not with their pairs, yet they
    connect nearly all of a crowded neighbourhood.
    """
    order = Window.partitionBy("key").orderBy("fp")
    beside = _variants(nodes).select("fp", F.lag("fp").over(order).alias("before"), F.first("fp").over(order).alias("first"))
    pairs = beside.select(F.col("fp").alias("b"), F.explode(F.array("before", "first")).alias("a"))
    return pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """fp and root, the smallest fingerprint of its connected component.

    Each round gives a node the smallest root among its own and its
    neighbours', hooks roots onto smaller ones and shortens the paths. Rounds
    grow with the logarithm of the longest path; each is checkpointed.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if not both.take(1):
        return nodes.select("fp", F.col("fp").alias("root"))
    labels = both.select(F.col("a").alias("fp")).distinct().withColumn("root", F.col("fp"))
    labels = cut(labels)
    while True:
        near = both.join(labels.select(F.col("fp").alias("b"), F.col("root").alias("other")), "b").groupBy(F.col("a").alias("fp")).agg(F.min("other").alias("other"))
        met = labels.join(near, "fp").select("fp", "root", F.least("root", "other").alias("low"))
        hooks = met.groupBy("root").agg(F.min("low").alias("low"))
        hooked = met.drop("low").join(hooks, "root").select("fp", F.col("low").alias("root"), (F.col("low") < F.col("root")).alias("moved"))
        up = hooks.select(F.col("root").alias("mid"), F.col("low").alias("top"))
        new = cut(hooked.join(up, hooked["root"] == up["mid"], "left").select("fp", F.coalesce("top", "root").alias("root"), "moved"))
        labels = new.select("fp", "root")
        if not new.where("moved").take(1):
            break
    return nodes.select("fp").join(labels, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def links(nodes: DataFrame, groups: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs at ``max_bits`` or fewer whose ends are in different ``groups``."""
    if max_bits >= 2 * (len(SEGMENTS) - 1):
        raise ValueError("three segments find pairs of at most five differing bits")
    keyed = _variants(groups.select("fp", "root"))
    a, b = keyed.select("key", F.col("fp").alias("a"), F.col("root").alias("ra")), keyed.select("key", F.col("fp").alias("b"), F.col("root").alias("rb"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    near = (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & (F.bit_count(x) <= max_bits) & (_first_key(x) == F.shiftright("key", 32).cast("int"))
    return a.join(b, "key").where(near).select("ra", "rb", "a", "b")


def simhash_components(docs: DataFrame, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, tx, ty, fp, component_id: the smallest doc_id that links of ``max_bits`` or fewer differing bits reach; top, one fp of the component.

    Null and empty texts have fingerprint zero and link like any other. Rows
    may repeat; a group without any non-null doc_id has a null component_id.
    Other columns are ignored. An empty table gives an empty result. More than
    five bits are an error, as then no segment need agree but for one bit.
    """
    prints = cut(fingerprints(docs, width))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    close = cut(components(nodes.select("fp"), _first_links(nodes.select("fp"), max_bits)))
    found = links(nodes, close, max_bits)
    edges = cut(found.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    top = components(close.select(F.col("root").alias("fp")).distinct(), edges)
    roots = close.join(top.select(F.col("fp").alias("root"), F.col("root").alias("top")), "root").select("fp", "top")
    named = nodes.join(roots, "fp")
    named = cut(named.select("fp", "first", "top"))
    smallest = cut(named.groupBy("top").agg(F.min("first").alias("component_id")))
    named = named.join(smallest, "top").select("fp", "top", "component_id")
    return prints.join(named, "fp").select("doc_id", "tx", "ty", "fp", "component_id", "top")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id."""
    return simhash_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents, all columns whatever their names, of which exactly one row stays for each near-duplicate group.

    It is the row with the smallest doc_id, nulls last; of several with that
    doc_id one by its text, and of rows that repeat both any one. An empty
    table gives an empty result.
    """
    return under_plain_names(docs, ("doc_id", "text"), lambda rows: _one_of_each(rows, width, max_bits))


def _one_of_each(docs: DataFrame, width: int, max_bits: int) -> DataFrame:
    rows = simhash_components(docs, width, max_bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tx", "ty")).alias("one")
    kept = rows.groupBy("top").agg(first).select(F.col("one.doc_id").alias("_id"), F.col("one.tx").alias("_x"), F.col("one.ty").alias("_y"))
    tx, ty = _text_key()
    keyed = docs.select(F.col("doc_id").cast("long").alias("_d"), tx.alias("_tx"), ty.alias("_ty"), F.struct(*docs.columns).alias("doc"))
    own = keyed["_d"].eqNullSafe(kept["_id"]) & (keyed["_tx"] == kept["_x"]) & (keyed["_ty"] == kept["_y"])
    return keyed.join(kept, own, "left_semi").groupBy("_d", "_tx", "_ty").agg(F.first("doc").alias("doc")).select("doc.*")
