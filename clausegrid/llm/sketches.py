"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line that is not blank; texts here keep a paragraph on a line.
A sketch has three tables of cells; a digest goes into one cell of each, where
it adds to a count, a sum of keys and a sum of checks (by exclusive or). Equal
sets have equal sketches, and one sketch less another holds the digests that
only one of them has. Peeling takes out cells that hold a single digest until
none is left, which recovers the differing digests. If it gets stuck, or has
not ended after as many rounds as there are cells, the two texts are sketched
again with twice the cells.

To compare each document with the next one, documents are dealt to ranges of
doc_id and go through a task in falling order; only the last of each range
meets its next one, the first of the range below, in a second, small step.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.llm.common import stored
from clausegrid.llm.words import mix

TABLES = 3
CELLS = 12
#: Documents that are sketched together, and the rows of a range, about.
TOGETHER = 1000
RANGE_ROWS = 4096
#: Ranges, at most: their numbers are put into order in one task.
MOST_RANGES = 20_000

_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def digests(text: str) -> list[int]:
    """A 64-bit digest of each non-blank line; a line that repeats gets another one each time."""
    seen: Counter[str] = Counter()
    out = []
    for line in text.split("\n"):
        if line.strip():
            out.append(xxhash.xxh3_64_intdigest(line.encode(), seed=seen[line]))
            seen[line] += 1
    return out


def _check(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


def _cells(keys: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each key in each table."""
    own = np.uint64(cells // TABLES)
    return np.stack([(mix(keys + np.uint64(0x9E3779B97F4A7C15 * (t + 1) % (1 << 64))) % own).astype(np.int64) + t * int(own) for t in range(TABLES)])


class Sketches:
    """A sketch of the same size for each of several sets."""

    def __init__(self, sets: int, cells: int):
        self.cells = cells
        self.count = np.zeros((sets, cells), np.int32)
        self.key = np.zeros((sets, cells), np.uint64)
        self.check = np.zeros((sets, cells), np.uint32)

    def add(self, of: np.ndarray, keys: np.ndarray, sign: np.ndarray | int = 1) -> Sketches:
        """Puts keys into the sketches ``of``; with a sign of -1 takes them out."""
        if len(keys):
            check, sign = _check(keys), np.broadcast_to(np.asarray(sign, np.int32), keys.shape)
            for at in _cells(keys, self.cells):
                flat = of * self.cells + at
                by = np.argsort(flat, kind="stable")
                cell = flat[by]
                first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
                cell = cell[first]
                self.count.ravel()[cell] += np.add.reduceat(sign[by], first)
                self.key.ravel()[cell] ^= np.bitwise_xor.reduceat(keys[by], first)
                self.check.ravel()[cell] ^= np.bitwise_xor.reduceat(check[by], first)
        return self

    def minus(self, other: Sketches) -> Sketches:
        """The sketches of what only one side has; counts of the other side's are negative."""
        out = Sketches(0, self.cells)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Empties the sketches: whether each came empty, and of all digests recovered the set, key and side (1 or -1).

        A cell of several digests can look like one of a single digest by
        chance. Its key then mostly belongs elsewhere, and is left; where it
        does not, the rounds are bounded and the sketch does not come empty.
        """
        parts = []
        for _ in range(self.cells):
            row, cell = np.nonzero((np.abs(self.count) == 1) & (self.check == _check(self.key)))
            keys = self.key[row, cell]
            own = (_cells(keys, self.cells) == cell).any(axis=0)
            row, cell, keys = row[own], cell[own], keys[own]
            if not len(row):
                break
            side = self.count[row, cell]
            by = np.lexsort((keys, row))
            new = np.ones(len(by), bool)
            new[1:] = (row[by][1:] != row[by][:-1]) | (keys[by][1:] != keys[by][:-1])
            row, keys, side = row[by][new], keys[by][new], side[by][new]
            self.add(row, keys, -side)
            parts.append((row, keys, side))
        done = ~(self.count.any(axis=1) | self.key.any(axis=1) | self.check.any(axis=1))
        row, keys, side = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32))
        return done, row, keys, side


def _flat(sets: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.repeat(np.arange(len(sets)), sizes), np.array([k for s in sets for k in s], np.uint64)


def likeness(a: list[list[int]], b: list[list[int]]) -> np.ndarray:
    """Jaccard similarity of each pair of digest sets, from sketches that grow until they peel; two empty sets are alike."""
    out = np.ones(len(a))
    todo, cells = np.arange(len(a)), CELLS
    while len(todo):
        left, right = [a[i] for i in todo], [b[i] for i in todo]
        apart = Sketches(len(todo), cells).add(*_flat(left)).minus(Sketches(len(todo), cells).add(*_flat(right)))
        done, row, _, _ = apart.peel()
        differ = np.bincount(row, minlength=len(todo))
        total = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)])
        either = (total + differ) / 2
        similar = np.where(either > 0, (total - differ) / 2 / np.maximum(either, 1), 1.0)
        out[todo[done]] = similar[done]
        todo, cells = todo[~done], cells * 2
    return out


def packed(sets: list[list[int]]) -> list[bytes]:
    """The sketches of CELLS cells as bytes: how many digests, then counts, keys and checks."""
    s = Sketches(len(sets), CELLS).add(*_flat(sets))
    return [len(d).to_bytes(4, "little") + s.count[i].astype("<i2").tobytes() + s.key[i].astype("<u8").tobytes() + s.check[i].astype("<u4").tobytes() for i, d in enumerate(sets)]


def edited(text: str, following: str) -> str:
    """The text whose last third is replaced by as much of the following one's start."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _compared(ids: list[int | None], texts: list[str], following: list[str]) -> dict[str, list]:
    changed = [edited(t, n) for t, n in zip(texts, following, strict=True)]
    own, new = [digests(t) for t in texts], [digests(t) for t in changed]
    known: dict[str, list[int]] = dict(zip(texts, own, strict=True))
    after = [known[n] if n in known else digests(n) for n in following]
    return {
        "doc_id": ids,
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": packed(own),
        "edited_fingerprint": packed(new),
        "near_edited": likeness(own, new).tolist(),
        "near_next": likeness(own, after).tolist(),
    }


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.binary()),
        ("edited_fingerprint", pa.binary()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)
_EDGE = [("edge", pa.int32()), ("range", pa.int32()), ("text", pa.string())]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the documents of a range, which come in falling order; its first and last one are given as edges."""
    schema = pa.schema([*_SCHEMA, *_EDGE])
    here = TaskContext.get().partitionId()

    def edge(kind: int, doc_id: int | None, text: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"doc_id": doc_id, "edge": kind, "range": here, "text": text}], schema)

    held: tuple[int | None, str] | None = None
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            rows = [(i, t or "") for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)]
            if held is None:
                yield edge(1, *rows[0])
            else:
                rows.insert(0, held)
            held = rows[-1]
            if len(rows) > 1:
                made = _compared([i for i, _ in rows[:-1]], [t for _, t in rows[:-1]], [t for _, t in rows[1:]])
                none = [None] * (len(rows) - 1)
                yield pa.RecordBatch.from_pydict(made | {"edge": [0] * len(none), "range": [here] * len(none), "text": none}, schema)
    if held is not None:
        yield edge(2, *held)


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            yield pa.RecordBatch.from_pydict(_compared(*(part.column(c).to_pylist() for c in ("doc_id", "text", "following"))), _SCHEMA)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The next document is the one before in doc_id; after the least comes the
    greatest, and a lone document follows itself. Rows of one doc_id stand in
    falling order of their texts, a null doc_id after all others. A null text
    counts as empty; two texts without any line are alike. Other columns are
    ignored; an empty table gives an empty result. Fingerprints are hex.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, -(-docs.count() // RANGE_ROWS)))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()]
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order, F.desc("text"))
    made = stored(dealt.mapInArrow(_in_order, f"{_FIELDS}, edge int, range int, text string"), "fingerprints")
    within = made.where("edge = 0").select(*_SCHEMA.names)
    edges = made.where("edge = 1").select("range")
    pairs = edges.select("range", F.coalesce(F.lead("range").over(Window.orderBy("range")), F.min("range").over(Window.partitionBy())).alias("below"))
    first = made.where("edge = 1").select(F.col("range").alias("below"), F.col("text").alias("following"))
    last = made.where("edge = 2").select("doc_id", "text", "range").join(pairs, "range").join(first, "below")
    across = last.select("doc_id", "text", "following").mapInArrow(_at_edges, _FIELDS)
    hexed = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return within.unionByName(across).withColumns(hexed)
