"""Byte-level BPE encoding and decoding by a public rank file.

The words of a slice of texts are made distinct, sorted into buckets of similar
length and laid out as padded matrices of ids. In each round every row merges
its leftmost pair of minimum rank; pairs are looked up in a hash table of numpy
arrays, finished rows leave the matrix and the others move one column to the
left. Rounds grow with a word's length and each costs as much again, so words
beyond WIDEST bytes (no blank in two thousand) are merged with a heap instead,
to the same result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import slices

RANK_FILE = "byte_bpe_50k.tiktoken"
#: Words of more bytes are merged one by one.
WIDEST = 2048
#: Distinct words that a worker remembers from slice to slice, and their bytes, at most.
REMEMBERED, REMEMBERED_BYTES = 60_000, 2 << 20
#: Bytes of text, matches of a text and ids that are worked on at once.
_SLICE_BYTES, _MATCHES, _IDS = 1 << 20, 100_000, 100_000
_NONE = np.int32(2**31 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Rank of the token that two neighbouring tokens make together: open addressing in arrays."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, int(len(pairs) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        at, left, self.probes = self._slot(pairs), np.arange(len(pairs)), 0
        while len(left):
            self.probes += 1
            free = self.keys[at[left]] < 0
            trying = left[free]
            self.keys[at[trying]] = pairs[trying]
            self.ranks[at[trying]] = ranks[trying]
            left = left[self.keys[at[left]] != pairs[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks; _NONE where the pair makes no token or an id is padding."""
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        keys[(a < 0) | (b < 0)] = -2
        flat = keys.ravel()
        at = self._slot(flat)
        seen = self.keys[at]
        out = np.where(seen == flat, self.ranks[at], _NONE)
        left = np.flatnonzero((seen != flat) & (seen >= 0) & (flat >= 0))
        for _ in range(1, self.probes):
            if not len(left):
                break
            at = (self._slot(flat[left]) + _) & ((1 << self.bits) - 1)
            seen = self.keys[at]
            hit = seen == flat[left]
            out[left[hit]] = self.ranks[at[hit]]
            left = left[~hit & (seen >= 0)]
        return out.reshape(keys.shape)


class Vocabulary:
    """The tokens of a rank file and the pairs that make them."""

    def __init__(self, content: bytes):
        self.rank = {base64.b64decode(t): int(r) for t, r in map(bytes.split, content.splitlines()) if t}
        size = max(self.rank.values()) + 1
        token = [b""] * size
        for t, r in self.rank.items():
            token[r] = t
        self.length = np.array([len(t) for t in token], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(token), np.uint8)
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        get = self.rank.get
        pairs, ranks = array("q"), array("i")
        for t, r in self.rank.items():
            for k in range(1, len(t)):
                if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None:
                    pairs.append(a << 32 | b)
                    ranks.append(r)
        self.pairs = PairTable(np.array(pairs, np.int64), np.array(ranks, np.int32))

    def merge_wide(self, word: bytes) -> np.ndarray:
        """One long word: a heap of ranks and places over a linked list."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)]
        first = self.pairs.find(ids[:-1], ids[1:]).tolist()
        ids, n = ids.tolist(), len(word)
        text = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, j = heapq.heappop(heap)
            if text[i] is None or after[i] != j or j >= n or self.rank.get(text[i] + text[j]) != r:
                continue
            text[i], text[j], ids[i] = text[i] + text[j], None, r
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (made := self.rank.get(text[x] + text[y])) is not None:
                    heapq.heappush(heap, (made, x, y))
        return np.array([ids[i] for i in range(n) if text[i] is not None], np.int32)

    def merge_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A matrix of byte ids, padded with -1: the merged matrix and the lengths of its rows."""
        out, rows = np.full_like(ids, -1), np.arange(len(ids))
        lengths = np.zeros(len(ids), np.int64)
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(rows):
            place = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), place]
            done = best == _NONE
            if done.any():
                out[rows[done], : ids.shape[1]] = ids[done]
                lengths[rows[done]] = (ids[done] >= 0).sum(axis=1)
                rows, ids, ranks, place, best = rows[~done], ids[~done], ranks[~done], place[~done], best[~done]
                if not len(rows):
                    break
            here = np.arange(len(rows))
            ids[here, place] = best
            width = ids.shape[1] - 1
            cols = np.arange(width)
            ids = np.take_along_axis(ids, cols + (cols > place[:, None]), axis=1)
            if width == 1:
                out[rows, :1], lengths[rows] = ids, 1
                break
            cols = cols[: width - 1]
            ranks = np.take_along_axis(ranks, cols + (cols >= place[:, None]), axis=1)
            inner = place < width - 1
            k, p = here[inner], place[inner]
            ranks[k, p] = self.pairs.find(ids[k, p], ids[k, p + 1])
            inner = place > 0
            k, p = here[inner], place[inner] - 1
            ranks[k, p] = self.pairs.find(ids[k, p], ids[k, p + 1])
        return out, lengths

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has."""
        counts = np.ones(len(words), np.int64)
        whole = np.fromiter((self.rank.get(w, -1) for w in words), np.int32, len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        todo = np.flatnonzero(whole < 0)
        found: dict[int, np.ndarray] = {}
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for width in (4, 6, 8, 10, 12, 16, 24, 32, 64, 128, 256, 512, 1024, WIDEST):
            here, todo = todo[size[todo] <= width], todo[size[todo] > width]
            for chunk in (here[k : k + (1 << 18) // width] for k in range(0, len(here), (1 << 18) // width)):
                flat = np.frombuffer(b"".join(words[i] for i in chunk), np.uint8)
                mask = np.arange(width) < size[chunk][:, None]
                ids = np.full((len(chunk), width), -1, np.int32)
                ids[mask] = self.of_byte[flat]
                merged, counts[chunk] = self.merge_rows(ids)
                parts.append((chunk, merged[merged >= 0]))
        for i in todo.tolist():
            found[i] = self.merge_wide(words[i])
            counts[i] = len(found[i])
        start = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        single = whole >= 0
        out[start[single]] = whole[single]
        for chunk, ids in parts:
            out[ragged(start[chunk], counts[chunk])] = ids
        for i, ids in found.items():
            out[start[i] : start[i] + counts[i]] = ids
        return out, counts

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one after another."""
        return self.data[ragged(self.start[ids], self.length[ids])]


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... for each run of the given length."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - length), length)


class Encoder:
    """Encodes texts and remembers words it has seen, up to REMEMBERED of REMEMBERED_BYTES together."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.find = vocabulary, regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes = 0
        self.ids, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        if sum(map(len, texts)) > _SLICE_BYTES:
            parts = [self._long(t) for t in texts]
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        words = [self.find.findall(t) for t in texts]
        per_text = np.fromiter(map(len, words), np.int64, len(words))
        ids, count = self._words(list(chain.from_iterable(words)))
        ends = np.concatenate(([0], np.cumsum(count)))
        return ids, np.diff(ends[np.concatenate(([0], np.cumsum(per_text)))])

    def _long(self, text: str) -> np.ndarray:
        """The ids of one text, some matches at a time."""
        matches = self.find.finditer(text)
        parts = [np.zeros(0, np.int32)]
        while some := [m.group() for m in islice(matches, _MATCHES)]:
            parts.append(self._words(some)[0])
        return np.concatenate(parts)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and how many each has."""
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self.forget()
        if new := [w for w in distinct if w not in self.known]:
            raw = [w.encode() for w in new]
            ids, count = self.vocabulary.encode_words(raw)
            for k, w in enumerate(new, len(self.known)):
                self.known[w] = k
            self.bytes += sum(map(len, raw))
            self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(count) - count))
            self.ids, self.count = np.concatenate((self.ids, ids)), np.concatenate((self.count, count))
        place = np.fromiter((self.known[w] for w in distinct), np.int64, len(distinct))
        place = place[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else place
        count = self.count[place]
        return self.ids[ragged(self.start[place], count)], count


_encoders: dict[tuple[bytes, str], Encoder] = {}


def _encoder(content: bytes, pattern: str) -> Encoder:
    """One encoder a worker: the next task of the same rank file and pattern uses it again."""
    key = (hashlib.sha256(content).digest(), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(content), pattern)
    return _encoders[key]


def _column(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column whose rows are consecutive runs of ``data``."""
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    buffers = [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())]
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), buffers).cast(pa.binary())


def _shared(docs: DataFrame, rank_path: str | None) -> Broadcast[bytes]:
    """The rank file, of fixed size, read on the driver and broadcast."""
    with open(rank_path or public_tokenizers.path(RANK_FILE), "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _hex(parts: Iterator[bytes]) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part)
    return digest.hexdigest()


def encoded(docs: DataFrame, rank_path: str | None = None, pattern: str = public_tokenizers.PATTERN, keep: tuple[str, ...] = (), with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids, the digests ids_sha256 and decoded_sha256, and the columns named in ``keep``.

    ids are little-endian unsigned 32-bit integers, left out without
    ``with_ids``; decoded_sha256 is that of the bytes that they decode to. Each
    match of ``pattern`` is encoded separately, without special tokens. A null
    or empty text has no ids. Rows may repeat and keep their own result; other
    columns are ignored; an empty table gives an empty result. A task holds a
    slice of texts at a time, and of a long text one part.
    """
    content = _shared(docs, rank_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value, pattern)
        decode = encoder.vocabulary.decode
        for batch in slices(batches, "text", _SLICE_BYTES):
            ids, counts = encoder([t or "" for t in batch.column("text").to_pylist()])
            ends = np.cumsum(counts)
            rows = list(zip((ends - counts).tolist(), ends.tolist(), strict=True))
            wide = ids.astype("<u4")
            hashed = [hashlib.sha256(wide[a:b]).hexdigest() for a, b in rows]
            decoded = [_hex(decode(ids[k : min(k + _IDS, b)]).tobytes() for k in range(a, b, _IDS)) for a, b in rows]
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts), "ids_sha256": pa.array(hashed), "decoded_sha256": pa.array(decoded)}
            if with_ids:
                columns["ids"] = _column(wide.view(np.uint8), counts * 4)
            yield pa.RecordBatch.from_pydict(columns | {c: batch.column(c) for c in keep})

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), *keep)
    kept = "".join(f", {c} {texts.schema[c].dataType.simpleString()}" for c in keep)
    own = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else "")
    return texts.mapInArrow(run, own + kept)


def decode(encoded: DataFrame, rank_path: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids; null or empty ids give an empty text, broken UTF-8 is replaced."""
    content = _shared(encoded, rank_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _encoder(content.value, public_tokenizers.PATTERN).vocabulary
        for batch in slices(batches, "ids", _SLICE_BYTES // 4):
            rows = [np.frombuffer(x or b"", "<u4") for x in batch.column("ids").to_pylist()]
            texts = [b"".join(vocabulary.decode(x[k : k + _IDS]).tobytes() for k in range(0, len(x), _IDS)).decode(errors="replace") for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def token_digests(docs: DataFrame, rank_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the decoded bytes."""
    return encoded(docs, rank_path, with_ids=False)
