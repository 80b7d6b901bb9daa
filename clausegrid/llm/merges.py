"""BPE encoding and decoding by a public tokenizer file of ranked merges.

The symbols of many words stand in one flat array. In each round every word
merges all places of its lowest-ranked pair, from the left; ranks are found by
binary search over the sorted keys of the pairs, merged symbols leave the array
and finished words go. A merge's product can only enter merges of higher rank,
so the round is what merging one place after another comes to. No token is
longer than ``span`` bytes, so a merge cannot be prepared from further away: a
long word is cut into blocks of several spans, and a block whose lowest rank is
below its left neighbour's and not above its right one's takes its turn beside
the others. Its rounds then depend on the blocks, not on the word's length.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.bpe import Encoder, ragged
from clausegrid.llm.common import slices

MERGE_FILE = "byte_bpe_50k.json"
#: Bytes of text and symbols that are worked on at once.
_SLICE_BYTES, _SYMBOLS = 1 << 20, 1 << 18
_NONE = np.int32(2**31 - 1)

#: Letters and numbers that Unicode has assigned since version 16, which the tokenizer takes as neither.
LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


def byte_signs() -> list[str]:
    """The sign that stands for each byte: itself where it prints, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


def _is_latin(text: str) -> bool:
    """Whether no sign is beyond U+00FF, and so none is in LATER."""
    try:
        return text.isascii() or text.encode("latin-1") is not None
    except UnicodeEncodeError:
        return False


class Splitter:
    """Cuts a text into added tokens and, between them, the matches of a pattern."""

    def __init__(self, added: list[str], pattern: str):
        self.names = added
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.plain = regex.compile(pattern)
        self.later = regex.compile(f"[{LATER}]")
        old = {k: rf"[\p{{{k}}}--[{LATER}]]" for k in "LN"}
        neither = rf"[[^\s\p{{L}}\p{{N}}]||[{LATER}]]"
        self.careful = regex.compile("(?V1)" + pattern.replace(r"[^\s\p{L}\p{N}]", neither).replace(r"\p{L}+", old["L"] + "+").replace(r"\p{N}+", old["N"] + "+"))

    def _between(self, part: str) -> regex.Pattern:
        return self.careful if not _is_latin(part) and self.later.search(part) else self.plain

    def findall(self, text: str) -> list[str]:
        return [m.group() for m in self.finditer(text)] if any(t in text for t in self.names) else self._between(text).findall(text)

    def finditer(self, text: str) -> Iterator[regex.Match]:
        at = 0
        for m in self.added.finditer(text) if self.added else ():
            part = text[at : m.start()]
            yield from self._between(part).finditer(part)
            yield m
            at = m.end()
        rest = text[at:] if at else text
        yield from self._between(rest).finditer(rest)


class Merges:
    """The tokens and ranked merges of a tokenizer file."""

    def __init__(self, content: bytes):
        made = json.loads(content)
        model, kind = made["model"], (made["pre_tokenizer"] or {})
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for k in ("single_word", "lstrip", "rstrip") if any(t[k] for t in made["added_tokens"])]
        if model["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or made["normalizer"] or odd:
            raise ValueError(f"not a plain byte-level BPE tokenizer: {odd or kind}")
        signs = byte_signs()
        of_sign = {s: b for b, s in enumerate(signs)}
        self.added = {t["content"].encode(): t["id"] for t in made["added_tokens"]}
        vocab = model["vocab"]
        token = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for t, i in vocab.items():
            token[i] = bytes(of_sign[s] for s in t) if all(s in of_sign for s in t) else t.encode()
        for raw, i in self.added.items():
            token[i] = raw
        self.length = np.array([len(t) for t in token], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(token), np.uint8)
        self.of_byte = np.array([vocab[s] for s in signs], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right, whole = (np.array([vocab[x] for x in xs], np.int64) for xs in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), whole.astype(np.int32)
        born = np.full(len(token), -1, np.int64)
        np.maximum.at(born, whole, np.arange(len(whole)))
        #: Whether each merge's parts come from merges of lower rank only; else only one place is merged a round.
        self.ordered = bool((np.maximum(born[left], born[right]) < np.arange(len(whole))).all())
        self.span = int(self.length[whole].max(initial=1))

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of the pairs; _NONE where there is no merge."""
        keys = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE) if len(self.keys) else np.full(len(keys), _NONE)

    def _blocks(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block of each byte, numbered through, and the word of each block."""
        width = 4 * self.span if self.ordered else int(sizes.max(initial=1))
        blocks = np.maximum(1, sizes // width)
        inner = np.minimum(ragged(np.zeros(len(sizes), np.int64), sizes) // width, np.repeat(blocks - 1, sizes))
        return np.repeat(np.cumsum(blocks) - blocks, sizes) + inner, np.repeat(np.arange(len(sizes)), blocks)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that are not empty, one word after another, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        block, word_of = self._blocks(sizes)
        symbol = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        last = np.zeros(len(symbol), bool)
        last[np.cumsum(sizes) - 1] = True
        rank = np.full(len(symbol), _NONE)
        inside = np.flatnonzero(~last)
        rank[inside] = self.find(symbol[inside], symbol[inside + 1])
        counts, parts = np.zeros(len(words), np.int64), []
        while len(symbol):
            first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            word, low = word_of[block[first]], np.minimum.reduceat(rank, first)
            begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            done = np.minimum.reduceat(low, begin) == _NONE
            if done.any():
                at = np.append(first[begin], len(symbol))
                of_symbol = np.repeat(done, np.diff(at))
                counts[word[begin[done]]] = np.diff(at)[done]
                parts.append((word[begin[done]], symbol[of_symbol]))
                symbol, block, last, rank = symbol[~of_symbol], block[~of_symbol], last[~of_symbol], rank[~of_symbol]
                continue
            turn, near = low < _NONE, word[1:] == word[:-1]
            turn[1:] &= ~near | (low[1:] < low[:-1])
            turn[:-1] &= ~near | (low[:-1] <= low[1:])
            wanted = np.repeat(np.where(turn, low, -1), np.diff(np.append(first, len(symbol))))
            hits = np.flatnonzero(rank == wanted)
            k = np.arange(len(hits))
            fresh = np.concatenate(([True], np.diff(hits) != 1))
            if self.ordered:
                hits = hits[(k - np.maximum.accumulate(np.where(fresh, k, 0))) % 2 == 0]
            else:
                hits = hits[np.concatenate(([True], block[hits[1:]] != block[hits[:-1]]))]
            symbol[hits] = self.made[rank[hits]]
            last[hits] = last[hits + 1]
            stays = np.ones(len(symbol), bool)
            stays[hits + 1] = False
            symbol, block, last, rank = symbol[stays], block[stays], last[stays], rank[stays]
            hits -= np.arange(len(hits))
            before = hits[hits > 0] - 1
            rank[hits] = _NONE
            changed = np.concatenate((hits, before))
            changed = changed[~last[changed]]
            rank[changed] = self.find(symbol[changed], symbol[changed + 1])
        start = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for which, ids in parts:
            out[ragged(start[which], counts[which])] = ids
        return out, counts

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, added tokens among them, one word after another, and how many each has."""
        ends, groups, k = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))), [], 0
        while k < len(words):
            stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + _SYMBOLS, side="right")))
            groups.append(words[k:stop])
            k = stop
        merged = [self._with_added(g) for g in groups] or [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
        return tuple(np.concatenate(x) for x in zip(*merged, strict=True))

    def _with_added(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = np.fromiter((self.added.get(w, -1) for w in words), np.int32, len(words))
        if (whole < 0).all():
            return self.merge(words)
        ids, some = self.merge([w for w, i in zip(words, whole, strict=True) if i < 0])
        counts = np.ones(len(words), np.int64)
        counts[whole < 0] = some
        out = np.repeat(whole, counts)
        out[out < 0] = ids
        return out, counts

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one after another; ids that no token has give none."""
        ids = ids[(ids >= 0) & (ids < len(self.start))]
        return self.data[ragged(self.start[ids], self.length[ids])]


class MergeEncoder(Encoder):
    """Encodes texts by merges, remembering words it has seen."""

    def __init__(self, merges: Merges, pattern: str):
        super().__init__(merges, pattern)
        self.find = Splitter([t.decode() for t in merges.added], pattern)


_encoders: dict[tuple[bytes, str], MergeEncoder] = {}


def _encoder(content: bytes, pattern: str) -> MergeEncoder:
    """One encoder a worker."""
    key = (hashlib.sha256(content).digest(), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = MergeEncoder(Merges(content), pattern)
    return _encoders[key]


def _shared(docs: DataFrame, path: str | None) -> Broadcast[bytes]:
    """The tokenizer file, of fixed size, read on the driver and broadcast."""
    with open(path or public_tokenizers.path(MERGE_FILE), "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _text(merges: Merges, ids: np.ndarray) -> str:
    return merges.decode(ids).tobytes().decode(errors="replace")


def encoded(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (an array, left out without ``with_ids``), ids_sha256 and decoded_sha256.

    ids_sha256 is the digest of the decimal ids joined by commas, decoded_sha256
    that of the text that the ids decode to. No special tokens are added; added
    tokens that stand in a text are one id each. A null or empty text has no
    ids. Rows may repeat and keep their own result, null ids too; other columns
    are ignored; an empty table gives an empty result. A task holds a slice of
    texts at a time, and of a long text some matches.
    """
    content = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value, pattern)
        for batch in slices(batches, "text", _SLICE_BYTES):
            ids, counts = encoder([t or "" for t in batch.column("text").to_pylist()])
            ends = np.cumsum(counts)
            rows = [ids[a:b] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
            hashed = [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in rows]
            decoded = [hashlib.sha256(_text(encoder.vocabulary, x).encode()).hexdigest() for x in rows]
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts), "ids_sha256": pa.array(hashed), "decoded_sha256": pa.array(decoded)}
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), ids)
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decoded(encodings: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids; null or empty ids give an empty text, broken UTF-8 is replaced."""
    content = _shared(encodings, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _encoder(content.value, public_tokenizers.PATTERN).vocabulary
        for batch in slices(batches, "size", _SLICE_BYTES // 4):
            texts = [_text(merges, np.array([i for i in x or () if i is not None], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encodings.select("doc_id", "ids", F.size("ids").alias("size")).mapInArrow(run, "doc_id long, text string")


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the decoded text."""
    return encoded(docs, path, with_ids=False)
