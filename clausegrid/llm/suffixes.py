"""Removal of long repeated byte strings by suffix sorting.

A byte goes if a string of MATCH bytes that covers it also starts elsewhere in
the collection. Equal texts are brought together first: of texts that occur
more than once every byte goes, and one of them stands for all in what follows.
Sorting every suffix of a large collection in one place is out of the question,
so equal strings are brought together: of the ANCHOR-byte
substrings inside each MATCH-byte window those with the least hash are its
anchors. Equal windows have equal anchors at equal places, so only the
contexts of anchors whose hash occurs more than once go on, about one for each
70 bytes. Contexts that are equal as a whole repeat in all their windows and
need no sorting. The others, one of each kind, meet by anchor; there the
suffixes that start their windows are put in order by deep-shallow sorting:
multikey quicksort on eight-byte words to a shallow depth, then blind tries for
the groups that still share a prefix, all groups of a chunk in step, in numpy.
A window repeats if it shares MATCH bytes with a neighbour in that order.

An anchor with very many different contexts would outgrow a task. Its windows
are counted by digest instead, in grouped aggregations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausegrid.llm.common import cut, slices, stored, under_plain_names, utf8
from clausegrid.llm.words import _CODES, _power, mix

MATCH = 200
ANCHOR = 64
#: Bytes to which the quicksort orders before the tries take over.
SHALLOW = 24
#: Different contexts of one anchor that are still sorted in one task.
HOT_CONTEXTS = 16_000
#: Contexts that are sorted at once, about.
SORT_AT_ONCE = 8000
#: Windows of a context that are first taken together.
RANGE = 17
_CHUNK = 1 << 20
_LEFT = MATCH - ANCHOR


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The least or greatest of each run of ``width`` values, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    return best(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def anchors_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows that lie within one row of the data."""
    width = MATCH - ANCHOR + 1
    places, hashes = [], []
    step = np.zeros(len(data) + 1, np.int32)
    long = np.diff(offsets) >= MATCH
    np.add.at(step, offsets[:-1][long], 1)
    np.add.at(step, offsets[1:][long] - MATCH + 1, -1)
    valid = np.cumsum(step) > 0
    for at in range(0, max(0, len(data) - MATCH + 1), _CHUNK):
        part = data[at : at + _CHUNK + MATCH - 1]
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[part] * _power("up", n), out=sums[1:])
        h = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * _power("down", n)[: n - ANCHOR + 1])
        order = np.maximum((h >> np.uint64(32)).astype(np.uint32), 1)
        least = np.where(valid[at : at + n - MATCH + 1], _sliding(order, width, np.minimum), 0).astype(np.uint32)
        pad = np.zeros(width - 1, np.uint32)
        chosen = np.flatnonzero(_sliding(np.concatenate((pad, least, pad)), width, np.maximum) == order)
        places.append(chosen + at)
        hashes.append(h[chosen])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches, the bytes of their packed texts, and the offsets of the rows in them."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in slices(batches, "n_bytes"):
        texts = [unpack(x) for x in batch.column("packed").to_pylist()]
        yield batch, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, at in _unpacked(batches):
        place, h = anchors_in(data, at)
        row = np.searchsorted(at, place, side="right") - 1
        low, high = np.maximum(at[row], place - _LEFT), np.minimum(at[row + 1], place + MATCH)
        raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
        context = np.fromiter((digest(raw[a:b], s) for a, b, s in zip(low.tolist(), high.tolist(), (place - low).tolist(), strict=True)), np.uint64, len(place))
        k = batch.column("k").to_numpy()[row]
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array((place - at[row]).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(context.view(np.int64))], ["k", "pos", "anchor", "context"])


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of the text, zeros past its end, as big-endian integers."""
    out = np.concatenate((text, np.zeros(MATCH + RANGE + 8, np.uint8))).astype(np.uint64)
    for have in (1, 2, 4):
        out = (out[:-have] << np.uint64(8 * have)) | out[have:]
    return out


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray, known: np.ndarray | int = 0) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, ``limit`` at most; ``known`` bytes are known to agree."""
    out = np.zeros(len(a), np.int64) + known
    active = np.flatnonzero(out < limit)
    while len(active):
        x = words[a[active] + out[active]] ^ words[b[active] + out[active]]
        same = x == 0
        differ = active[~same]
        gap = x[~same]
        first = np.zeros(len(gap), np.int64)
        for bits in (32, 16, 8):
            high = gap >> np.uint64(64 - bits) == 0
            first += np.where(high, bits // 8, 0)
            gap = np.where(high, gap << np.uint64(bits), gap)
        out[differ] += first
        active = active[same]
        out[active] += 8
        active = active[out[active] < limit[active]]
    return np.minimum(out, limit)


def _regroup(order: np.ndarray, group: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts by group and keys, stably: the permutation, where new groups begin, and their sizes."""
    by = np.lexsort((*keys[::-1], group))
    g = group[by]
    new = np.ones(len(by), bool)
    new[1:] = g[1:] != g[:-1]
    for key in keys:
        s = key[by]
        new[1:] |= s[1:] != s[:-1]
    begin = np.flatnonzero(new)
    return by, begin, np.diff(np.append(begin, len(by)))


def deep_shallow_sort(words: np.ndarray, starts: np.ndarray, groups: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orders the suffixes at ``starts`` within each group by their first ``limit`` bytes, as many for all of a group.

    Returns the order, groups one after another, and for each place in it the
    prefix shared with the place before: zero at a group's start.
    """
    n = len(starts)
    order = np.lexsort((starts, groups))
    slot_group = groups[order]
    head = np.ones(n, bool)
    head[1:] = slot_group[1:] != slot_group[:-1]
    outer = head.copy()
    begin = np.flatnonzero(head)
    size = np.diff(np.append(begin, n))
    depth = np.zeros(len(begin), np.int64)

    # Multikey quicksort: three parts around a pivot word, the middle one a word deeper.
    deep: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        for_tries = (size > 1) & (depth >= SHALLOW)
        deep.append((begin[for_tries], size[for_tries], depth[for_tries]))
        keep = (size > 1) & (depth < SHALLOW)
        begin, size, depth = begin[keep], size[keep], depth[keep]
        if not len(begin):
            break
        of = np.repeat(np.arange(len(begin)), size)
        slot = np.arange(len(of)) + np.repeat(begin - (np.cumsum(size) - size), size)
        item = order[slot]
        w = words[starts[item] + depth[of]]
        pivot = w[(np.cumsum(size) - size) + size // 2]
        side = (w > pivot[of]).astype(np.int8) - (w < pivot[of])
        by, first, sizes = _regroup(order, of, side)
        order[slot] = item[by]
        of, side = of[by][first], side[by][first]
        begin, size, depth = slot[first], sizes, depth[of] + np.where(side == 0, 8, 0)
    begin, size, depth = (np.concatenate(x) for x in zip(*deep, strict=True))

    # Blind tries: the first suffix of a group is the spine; the others hang off it by the
    # place and byte of their branch, and those of one branch make the next group.
    while len(begin):
        of = np.repeat(np.arange(len(begin)), size)
        slot = np.arange(len(of)) + np.repeat(begin - (np.cumsum(size) - size), size)
        item = order[slot]
        spine = starts[order[begin]][of]
        own = starts[item]
        most = limit[item]
        shared = common_prefix(words, own, spine, most, depth[of])
        branch = (words[own + shared] >> np.uint64(56)).astype(np.int64)
        side = np.where(shared >= most, 0, np.sign(branch - (words[spine + shared] >> np.uint64(56)).astype(np.int64)))
        branch[side == 0] = 0
        by, first, sizes = _regroup(order, of, side, np.where(side < 0, shared, -shared), branch)
        order[slot] = item[by]
        more = (sizes > 1) & (side[by][first] != 0)
        begin, size, depth = slot[first][more], sizes[more], shared[by][first][more] + 1
    lcp = np.zeros(n, np.int64)
    inner = np.flatnonzero(~outer)
    lcp[inner] = common_prefix(words, starts[order[inner - 1]], starts[order[inner]], limit[order[inner]])
    return order, lcp


def classes(words: np.ndarray, starts: np.ndarray, groups: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix: whether another of its group has the same first ``limit`` bytes, and whether it comes first of those that do."""
    order, lcp = deep_shallow_sort(words, starts, groups, limit)
    same = lcp >= limit[order]
    same[:1] = False
    often, first = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    often[order] = same | np.append(same[1:], False)
    first[order] = ~same
    return often, first


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the contexts in a batch: their bytes, and the context, start in the bytes and distance to the anchor of each window."""
    column = batch.column("bytes")
    data, at = utf8_bytes(column)
    left = batch.column("left").to_numpy(zero_copy_only=False).astype(np.int64)
    right = np.diff(at) - left
    least = np.maximum(0, MATCH - right)
    count = np.maximum(0, left - least + 1)
    of = np.repeat(np.arange(len(left)), count)
    distance = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + least[of]
    return data, of, at[of] + left[of] - distance, distance


def utf8_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the offsets of its rows."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _covered_in(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Covered stretches of the contexts of whole anchors.

    The windows of a context are taken in ranges of RANGE distances from the
    anchor. Sorted by all bytes of a range, those that occur twice repeat as a
    whole and one of each kind goes on. Sorted by the bytes that the windows of
    a range share, those without a peer cannot repeat. The windows of the
    others are sorted one by one.
    """
    data, at = utf8_bytes(batch.column("bytes"))
    words = _words(data)
    left = batch.column("left").to_numpy(zero_copy_only=False).astype(np.int64)
    least = np.maximum(0, MATCH - (np.diff(at) - left))
    _, anchor = np.unique(batch.column("anchor").to_numpy(zero_copy_only=False), return_inverse=True)
    count = np.maximum(0, left // RANGE - least // RANGE + 1)
    of = np.repeat(np.arange(len(left)), count)
    r = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + (least // RANGE)[of]
    d1, d2 = np.maximum(r * RANGE, least[of]), np.minimum(r * RANGE + RANGE - 1, left[of])
    real = d1 <= d2
    of, r, d1, d2 = of[real], r[real], d1[real], d2[real]
    place, ranges = at[of] + left[of], _LEFT // RANGE + 1
    group = anchor[of] * ranges + r
    often, first = classes(words, place - d2, (group * RANGE + d1 - r * RANGE) * RANGE + d2 - r * RANGE, MATCH + d2 - d1)
    kept = np.flatnonzero(first)
    peers, _ = classes(words, (place - r * RANGE)[kept], group[kept], np.full(len(kept), MATCH - RANGE + 1))
    kept = kept[peers]
    length = (d2 - d1 + 1)[kept]
    item = np.repeat(kept, length)
    d = np.arange(len(item)) - np.repeat(np.cumsum(length) - length, length) + d1[item]
    again, _ = classes(words, place[item] - d, anchor[of[item]] * (_LEFT + 1) + d, np.full(len(item), MATCH))
    settled = batch.column("settled").to_numpy(zero_copy_only=False).astype(bool)
    single = again & ~often[item] & ~settled[of[item]]
    whole = often & ~settled[of]
    row = np.concatenate((of[whole], of[item[single]]))
    pos = batch.column("pos").to_numpy(zero_copy_only=False).astype(np.int64)[row]
    a = pos - np.concatenate((d2[whole], d[single]))
    b = pos - np.concatenate((d1[whole], d[single])) + MATCH
    return _joined(batch, row, a, b)


def _joined(batch: pa.RecordBatch, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Stretches [a, b) of the batch's rows, those of a row that touch as one."""
    by = np.lexsort((a, row))
    row, a, b = row[by], a[by], b[by]
    if len(row):
        reach = np.maximum.accumulate(b + row * (1 << 32)) - row * (1 << 32)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (a[1:] > reach[:-1])
        begin = np.flatnonzero(new)
        row, a, b = row[begin], a[begin], np.maximum.reduceat(b, begin)
    k = batch.column("k").to_numpy()[row]
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["k", "a", "b"])


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts whole anchors, which come one after another, a bounded number of contexts at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def join(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            held.append(batch.slice(at, 2000))
            rows += held[-1].num_rows
            if rows < SORT_AT_ONCE:
                continue
            whole = join(held)
            anchor = whole.column("anchor").to_numpy(zero_copy_only=False)
            end = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if (anchor != anchor[-1]).any() else 0
            if end:
                yield _covered_in(whole.slice(0, end))
            held, rows = [whole.slice(end)], whole.num_rows - end
    if rows:
        yield _covered_in(join(held))


def _range_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each context in ranges of RANGE distances: digests of all their bytes and of those they share."""
    schema = pa.schema([*((c, pa.int32()) for c in ("r", "d1", "d2")), *((c, pa.int64()) for c in ("x", "y", "core"))])
    for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
        data, at = utf8_bytes(batch.column("bytes"))
        raw, rows, parts = data.tobytes(), [], []
        lefts = batch.column("left").to_pylist()
        for n, (low, high, left) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), lefts, strict=True)):
            anchor = low + left
            for r in range(max(0, MATCH - (high - anchor)) // RANGE, left // RANGE + 1):
                d1, d2 = max(r * RANGE, MATCH - (high - anchor)), min(r * RANGE + RANGE - 1, left)
                if d1 > d2:
                    continue
                whole = xxhash.xxh3_128_digest(raw[anchor - d2 : anchor - d1 + MATCH])
                core = xxhash.xxh3_64_digest(raw[anchor - r * RANGE : anchor - r * RANGE - RANGE + 1 + MATCH])
                rows.append(n)
                parts.append((r, d1, d2, *np.frombuffer(whole + core, np.int64).tolist()))
        own = pa.Table.from_batches([batch.select(["k", "pos", "settled", "anchor"])]).take(pa.array(rows, pa.int64()))
        made = pa.table(dict(zip(schema.names, map(list, zip(*parts, strict=True)), strict=True)), schema) if parts else schema.empty_table()
        for name in schema.names:
            own = own.append_column(name, made.column(name))
        yield from own.combine_chunks().to_batches()


def _window_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of each window in the ranges that are asked for."""
    for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
        data, of, start, distance = _windows(batch)
        asked = np.zeros((batch.num_rows, _LEFT // RANGE + 1), np.int8)
        for n, ranges in enumerate(batch.column("ranges").to_pylist()):
            for x in ranges:
                asked[n, x["r"]] = 1 + x["often"]
        how = asked[of, distance // RANGE]
        of, start, distance, how = of[how > 0], start[how > 0], distance[how > 0], how[how > 0]
        raw = data.tobytes()
        digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[s : s + MATCH]) for s in start.tolist()), np.int64).reshape(-1, 2)
        own = [pa.array(batch.column(c).to_numpy(zero_copy_only=False)[of]) for c in ("k", "anchor")]
        settled = pa.array(batch.column("settled").to_numpy(zero_copy_only=False).astype(bool)[of] | (how > 1))
        begin = batch.column("pos").to_numpy(zero_copy_only=False).astype(np.int64)[of] - distance
        yield pa.RecordBatch.from_arrays(
            [own[0], settled, own[1], *(pa.array(x.astype(np.int32)) for x in (begin, distance)), pa.array(digest[:, 0]), pa.array(digest[:, 1])],
            ["k", "settled", "anchor", "a", "d", "x", "y"],
        )


def _counted_windows(around: DataFrame) -> DataFrame:
    """Covered stretches of the contexts of hot anchors, without sorting.

    Windows are taken in ranges. A range whose bytes occur twice repeats as a
    whole; one whose shared bytes occur in no other kind of range does not
    repeat at all. Only windows of the ranges between are counted one by one.
    """
    schema = "k long, pos int, settled boolean, anchor long, r int, d1 int, d2 int, x long, y long, core long"
    ranges = stored(around.mapInArrow(_range_digests, schema), "ranges")
    same = ["anchor", "r", "d1", "d2", "x", "y"]
    kinds = cut(ranges.groupBy(*same, "core").agg((F.count(F.lit(1)) >= 2).alias("often"), F.min(F.struct("k", "pos")).alias("one")))
    whole = ranges.where("not settled").join(kinds.where("often").select(*same), same).select("k", (F.col("pos") - F.col("d2")).alias("a"), (F.col("pos") - F.col("d1") + MATCH).alias("b"))
    between = kinds.groupBy("anchor", "r", "core").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
    asked = kinds.join(between, ["anchor", "r", "core"]).groupBy("one.k", "one.pos", "anchor").agg(F.collect_list(F.struct("r", "often")).alias("ranges"))
    windows = around.join(asked, ["k", "pos", "anchor"]).mapInArrow(_window_digests, "k long, settled boolean, anchor long, a int, d int, x long, y long")
    windows = stored(windows, "windows")
    often = windows.groupBy("anchor", "d", "x", "y").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
    single = windows.where("not settled").join(often, ["anchor", "d", "x", "y"]).select("k", "a", (F.col("a") + MATCH).alias("b"))
    return whole.unionByName(single)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 128-bit digest and the size of each text in place of it."""
    for batch in slices(batches, "text"):
        data, at = utf8(batch.column("text"))
        raw = memoryview(data.tobytes())
        found = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), *map(pa.array, (found[:, 0], found[:, 1], np.diff(at)))], ["doc", "x", "y", "n_bytes"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _hashed, with the compressed texts, so that moving them costs less."""
    press = zstandard.ZstdCompressor(level=1).compress
    for batch in slices(batches, "text"):
        data, at = utf8(batch.column("text"))
        raw = data.tobytes()
        texts = pa.array([press(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
        for own in _hashed(iter([batch])):
            yield own.append_column("packed", texts)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the anchors that each text is asked for."""
    schema = pa.schema([("k", pa.int64()), ("pos", pa.int32()), ("anchor", pa.int64()), ("settled", pa.bool_()), ("hot", pa.bool_()), ("left", pa.int32()), ("bytes", pa.binary())])
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in slices(batches, "n_bytes"):
        rows = []
        for r in batch.to_pylist():
            text = unpack(r["packed"])
            for x in r["asked"]:
                low = max(0, x["pos"] - _LEFT)
                rows.append({"k": r["k"], **x, "left": x["pos"] - low, "bytes": text[low : x["pos"] + MATCH]})
                if len(rows) == 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def _long_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows as text and doc, a struct of the other columns, and the table of different texts of MATCH bytes or more.

    That table has k, a number of its own for each text, n, how many rows have
    the text, its digest x, y, its size, the packed text and one row's doc.
    """
    others = [c for c in docs.columns if c != "text"]
    doc = F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), doc.alias("doc"))
    digests = T.StructType([rows.schema["doc"], T.StructField("x", T.LongType()), T.StructField("y", T.LongType()), T.StructField("n_bytes", T.LongType())])
    packed = T.StructType([*digests, T.StructField("packed", T.BinaryType())])
    long = rows.where(F.octet_length("text") >= MATCH)
    one = long.mapInArrow(_packed, packed).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("doc", "n_bytes", "packed")).alias("one"))
    texts = stored(one.select(F.monotonically_increasing_id().alias("k"), "n", "x", "y", "one.*"), "texts")
    return rows, texts


def repeated_spans(texts: DataFrame, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """k and marks: of each text with repeats, places of anchors whose windows all repeat (b is -1), and covered stretches [a, b).

    ``texts`` is a stored table of different texts: k, n_bytes, packed.
    """
    kinds = stored(texts.select("k", "n_bytes", "packed").mapInArrow(_anchors, "k long, pos int, anchor long, context long"), "all-anchors")
    live = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).where("n >= 2")
    live = cut(live.select("anchor", (F.col("low") != F.col("high")).alias("various")))
    met = stored(kinds.join(live, "anchor"), "anchors")
    various = met.where("various")
    kinds = cut(various.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "pos")).alias("one")))
    hot = cut(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_contexts).select("anchor", F.lit(True).alias("hot")))
    asked = kinds.join(hot, "anchor", "left").select("one.k", F.struct("one.pos", "anchor", (F.col("n") >= 2).alias("settled"), F.coalesce("hot", F.lit(False)).alias("hot")).alias("asked"))
    asked = asked.groupBy("k").agg(F.collect_list("asked").alias("asked"))
    around = asked.join(texts.select("k", "n_bytes", "packed"), "k")
    around = around.mapInArrow(_contexts, "k long, pos int, anchor long, settled boolean, hot boolean, left int, bytes binary")
    around = stored(around, "contexts")
    cool = around.where("not hot").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_groups, "k long, a int, b int")
    marks = met.where("not various").select("k", F.col("pos").alias("a"), F.lit(-1).alias("b"))
    times = kinds.select("anchor", "context", "n")
    # Every anchor keeps its row, so that the join has as many rows as anchors however many share a context.
    twice = various.join(times, ["anchor", "context"], "left").select("k", F.col("pos").alias("a"), F.when(F.col("n") >= 2, -1).alias("b"))
    marks = marks.unionByName(twice).unionByName(cool)
    if hot.take(1):
        marks = marks.unionByName(_counted_windows(around.where("hot")))
    return marks.groupBy("k").agg(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("a", "b"))).alias("marks"))


def _covered(size: int, marks: list[dict]) -> np.ndarray:
    """Which bytes of a text of this size the marks cover."""
    step = np.zeros(size + 1, np.int32)
    if marks and size >= MATCH:
        a, b = np.array([(m["a"], m["b"]) for m in marks], np.int64).T
        whole = b < 0
        low = np.where(whole, np.maximum(0, a - _LEFT), a)
        high = np.where(whole, np.minimum(a, size - MATCH) + MATCH, b)
        np.add.at(step, low, 1)
        np.add.at(step, high, -1)
    return np.cumsum(step[:-1]) > 0


def without_repeats(docs: DataFrame, as_text: bool = False, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """doc, a struct of all columns but text, n_bytes, n_removed, n_spans and kept, what remains of the text.

    Texts count as UTF-8 bytes, null as empty; matches never cross documents.
    ``kept`` holds bytes, or with ``as_text`` a string in which the halves of
    characters that were cut in two are left out. Rows may repeat, doc_ids too
    or be null: every row is judged by itself, and equal rows of MATCH bytes or
    more remove each other, however many they are. An empty table gives an
    empty result.
    """
    rows, texts = _long_texts(docs)
    marks = repeated_spans(texts, hot_contexts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "n_bytes"):
            removed, spans, kept = [], [], []
            for packed_text, own in zip(batch.column("packed").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                text = unpack(packed_text)
                gone = _covered(len(text), own or [])
                rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
                removed.append(len(text) - len(rest))
                spans.append(int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum()))
                kept.append(rest.decode(errors="ignore") if as_text else rest)
            columns = [pa.array(x, pa.int64()) for x in (removed, spans)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("n_bytes"), *columns, pa.array(kept, pa.string() if as_text else pa.binary())], ["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    fields = [rows.schema["doc"], T.StructField("n_bytes", T.LongType())]
    schema = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in ("n_removed", "n_spans")), T.StructField("kept", T.StringType() if as_text else T.BinaryType())])
    once = texts.where("n = 1").select("k", "doc", "n_bytes", "packed").join(marks, "k", "left").mapInArrow(run, schema)
    kind = "string" if as_text else "binary"
    whole = F.col("text") if as_text else F.encode("text", "UTF-8")
    zero = F.lit(0).cast("long")
    short = rows.where(F.octet_length("text") < MATCH).select("doc", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), whole.alias("kept"))
    digests = T.StructType([fields[0], T.StructField("x", T.LongType()), T.StructField("y", T.LongType()), fields[1]])
    again = rows.where(F.octet_length("text") >= MATCH).mapInArrow(_hashed, digests).join(texts.where("n > 1").select("x", "y"), ["x", "y"])
    again = again.select("doc", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit("").cast(kind).alias("kept"))
    return once.unionByName(again).unionByName(short)


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes."""
    return without_repeats(docs.select("doc_id", "text")).select(F.col("doc.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def texts_without_repeats(docs: DataFrame) -> DataFrame:
    """The documents, all columns whatever their names, with what remains of the text; n_chars, where there, is counted again."""
    return under_plain_names(docs, ("doc_id", "text", "n_chars"), _rest_of_texts)


def _rest_of_texts(docs: DataFrame) -> DataFrame:
    found = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return without_repeats(docs, as_text=True).select(*(found.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))
