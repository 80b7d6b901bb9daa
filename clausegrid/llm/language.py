"""Language identification with segmentation-marginalised unigram models.

The pieces of a fixed public vocabulary get one probability for each language.
A word's likelihood is the sum over all its segmentations into pieces, which a
forward algorithm adds up; a text's is the product over its words. The
probabilities come from expectation maximisation: forward and backward sums
give every piece its expected count under all segmentations of the words of a
bounded number of texts for each language, drawn from documents that are not
held out. Each language is learned in a task of its own.

Words may have any length. Those of more than TOGETHER code points are summed
in a rolling window, with the sums scaled as they shrink; when learning, every
code point of such a word counts as many times more likely as keeps its whole
likelihood near one, which leaves the expected counts as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.llm.common import cut, slices

MODEL_FILE = "piece_bpe_32k.model"
#: Texts that each language is learned from, at most, whatever their length.
TEXTS_PER_LANGUAGE = 300
ROUNDS = 4
#: Code points, with the leading mark, of words that are summed side by side; longer ones go through a window.
TOGETHER = 41
#: Share of each language's mass that is given to the mean of all languages, and the chance of a sign without a piece.
SHARED = 0.02
UNKNOWN = 1e-7
HELD_OUT = 2
REMEMBERED = 100_000
#: Words that are looked up at once, and positions of long words that a window looks ahead.
_AT_ONCE, _AHEAD = 100_000, 512
#: Code points of long words that are learned from side by side, padding included; a longer word is learned from alone.
_CELLS = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xBF58476D1CE4E5B9)
_LETTER = regex.compile(r"\p{L}")
#: What str.split() leaves.
_WORD = regex.compile(r"[^\s\x1c-\x1f\x85]+")


def _extend(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The hash of a string that is one code point longer."""
    h = (h + code.astype(np.uint64) + np.uint64(1)) * _BASE
    return h ^ (h >> np.uint64(29))


class Pieces:
    """The vocabulary as a hash table of its pieces, and the lattice of the pieces in words."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        h = np.zeros(len(pieces), np.uint64)
        for k, piece in enumerate(pieces):
            x = np.zeros(1, np.uint64)
            for c in piece:
                x = _extend(x, np.array([ord(c)]))
            h[k] = x[0]
        self.bits = max(4, (4 * len(pieces)).bit_length())
        self.keys, self.ids = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        for k, x in enumerate(h.tolist()):
            at = (x * int(_SPREAD) % (1 << 64)) >> (64 - self.bits)
            while self.ids[at] >= 0:
                at = (at + 1) % (1 << self.bits)
            self.keys[at], self.ids[at] = x, k

    def find(self, h: np.ndarray) -> np.ndarray:
        """The pieces with these hashes, -1 for none."""
        flat = h.ravel()
        at = ((flat * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[at] == flat, self.ids[at], -1)
        left = np.flatnonzero((self.keys[at] != flat) & (self.ids[at] >= 0))
        while len(left):
            at[left] = (at[left] + 1) % (1 << self.bits)
            hit = self.keys[at[left]] == flat[left]
            out[left[hit]] = self.ids[at[left[hit]]]
            left = left[~hit & (self.ids[at[left]] >= 0)]
        return out.reshape(h.shape)

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of words, each with its leading mark, the piece of every start and length, -1 for none, and the words' lengths."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(size.max(initial=1))
        codes = np.zeros((len(words), width), np.uint32)
        codes[np.arange(width) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        return self.lattice_of(codes, size), size

    def lattice_of(self, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """As lattice, of rows of code points of which ``size`` count."""
        width = codes.shape[1]
        longest = min(self.longest, width)
        out = np.full((longest, len(codes), width), -1, np.int32)
        h = np.zeros((len(codes), width), np.uint64)
        for length in range(1, longest + 1):
            h = _extend(h[:, : width - length + 1], codes[:, length - 1 :])
            found = self.find(h)
            found[np.arange(width - length + 1) + length > size[:, None]] = -1
            out[length - 1, :, : width - length + 1] = found
        return out

    def log_sums(self, words: list[str], chance: np.ndarray) -> np.ndarray:
        """Logarithms of the forward sums of words of any length: (word, language)."""
        out = np.zeros((len(words), chance.shape[1]))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for k in range(0, len(order), 64):
            part = order[k : k + 64]
            out[part] = self._windowed([words[i] for i in part], chance)
        return out

    def _windowed(self, words: list[str], chance: np.ndarray) -> np.ndarray:
        size = np.fromiter(map(len, words), np.int64, len(words))
        # before[j] is the sum up to j positions back, in units of exp(scale).
        before = [np.ones((len(words), chance.shape[1]))]
        scale, out = np.zeros((len(words), chance.shape[1])), np.zeros((len(words), chance.shape[1]))
        pending: list[np.ndarray] = []
        for at in range(0, int(size.max()), _AHEAD):
            parts = [w[at : at + _AHEAD + self.longest - 1] for w in words]
            width = max(map(len, parts))
            codes = np.zeros((len(words), width), np.uint32)
            left = np.fromiter(map(len, parts), np.int64, len(parts))
            codes[np.arange(width) < left[:, None]] = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
            lattice = self.lattice_of(codes, left)
            for step in range(min(_AHEAD, width)):
                pending = [lattice[:, :, step], *pending[: self.longest - 1]]
                now = before[0] * chance[pending[0][0]]
                for length in range(2, len(pending) + 1):
                    if length > len(pending[length - 1]):
                        continue
                    piece = pending[length - 1][length - 1]
                    hit = np.flatnonzero(piece >= 0)
                    if len(hit):
                        now[hit] += before[length - 1][hit] * chance[piece[hit]]
                before = [now, *before[: self.longest - 1]]
                small = now < 1e-100
                if small.any():
                    factor = np.where(small, now, 1.0)
                    before = [b / factor for b in before]
                    scale += np.log(factor)
                ended = np.flatnonzero(size == at + step + 1)
                if len(ended):
                    out[ended] = np.log(before[0][ended]) + scale[ended]
        return out


def forward(lattice: np.ndarray, size: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of the first characters: (word, characters, language). chance: (pieces + 1, languages), the last row of unknown signs."""
    longest, n, width = lattice.shape
    alpha = np.zeros((n, width + 1, chance.shape[1]))
    alpha[:, 0] = 1
    for end in range(1, width + 1):
        for length in range(1, min(longest, end) + 1):
            piece = lattice[length - 1, :, end - length]
            if length == 1:
                alpha[:, end] += alpha[:, end - 1] * chance[piece]
            elif len(hit := np.flatnonzero(piece >= 0)):
                alpha[hit, end] += alpha[hit, end - length] * chance[piece[hit]]
    return alpha


def expected_counts(lattice: np.ndarray, size: np.ndarray, weight: np.ndarray, chance: np.ndarray, tilt: np.ndarray | None = None) -> np.ndarray:
    """Of one language: how often each piece is expected, the words counting ``weight`` times.

    ``tilt`` makes each code point of a word as many times more likely; as all
    segmentations have the same code points, it cancels out.
    """
    longest, n, width = lattice.shape
    tilt = np.ones(n) if tilt is None else tilt
    gain = tilt ** np.arange(1, longest + 1)[:, None]
    alpha, beta = np.zeros((n, width + 1)), np.zeros((n, width + 1))
    alpha[:, 0] = 1
    for end in range(1, width + 1):
        for length in range(1, min(longest, end) + 1):
            piece = lattice[length - 1, :, end - length]
            p = chance[piece, 0] if length == 1 else np.where(piece >= 0, chance[piece, 0], 0)
            alpha[:, end] += alpha[:, end - length] * p * gain[length - 1]
    beta[np.arange(n), size] = 1
    for start in range(width - 1, -1, -1):
        for length in range(1, min(longest, width - start) + 1):
            piece = lattice[length - 1, :, start]
            p = chance[piece, 0] if length == 1 else np.where(piece >= 0, chance[piece, 0], 0)
            beta[:, start] += np.where(start + length <= size, p * gain[length - 1] * beta[:, start + length], 0)
    scale = weight / alpha[np.arange(n), size]
    out = np.zeros(len(chance))
    for length in range(1, longest + 1):
        piece = lattice[length - 1, :, : width - length + 1]
        word, start = np.nonzero(piece >= 0)
        p = piece[word, start]
        share = alpha[word, start] * chance[p, 0] * gain[length - 1][word] * beta[word, start + length] * scale[word]
        out += np.bincount(p, weights=share, minlength=len(chance))
    return out


def learn(pieces: Pieces, seen: dict[str, int]) -> np.ndarray:
    """How often each piece is expected in the words of one language, given how often each word is seen; the last one is unused."""
    size = len(pieces.pieces)
    marked = sorted((("▁" + w, n) for w, n in seen.items()), key=lambda x: (len(x[0]), x[0]))
    short, long = [x for x in marked if len(x[0]) <= TOGETHER], [x for x in marked if len(x[0]) > TOGETHER]
    chance = np.full((size + 1, 1), 1 / max(size, 1))
    chance[-1] = UNKNOWN
    found = np.zeros(size + 1)
    for _ in range(ROUNDS):
        found = np.zeros(size + 1)
        for a in range(0, len(short), 5000):
            part = short[a : a + 5000]
            found += expected_counts(*pieces.lattice([w for w, _ in part]), np.array([n for _, n in part], float), chance)
        logs = pieces.log_sums([w for w, _ in long], chance)[:, 0] if long else np.zeros(0)
        at = 0
        while at < len(long):
            stop = at + 1
            while stop < len(long) and (stop + 1 - at) * len(long[stop][0]) <= _CELLS:
                stop += 1
            lattice, length = pieces.lattice([w for w, _ in long[at:stop]])
            found += expected_counts(lattice, length, np.array([n for _, n in long[at:stop]], float), chance, np.exp(-logs[at:stop] / length))
            at = stop
        chance[:-1, 0] = np.maximum(found[:-1] / max(found[:-1].sum(), 1e-300), 1e-12)
    return found


def chances(counts: np.ndarray) -> np.ndarray:
    """The chance of each piece in each language from its expected counts: (pieces + 1, languages), the last row of unknown signs."""
    share = counts[:-1] / np.maximum(counts[:-1].sum(axis=0), 1e-300)
    mean = share.mean(axis=1, keepdims=True) if counts.shape[1] else share
    chance = np.full(counts.shape, UNKNOWN)
    chance[:-1] = np.maximum((1 - SHARED) * share + SHARED * mean, UNKNOWN / 10)
    return chance


def _word_runs(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The words of the texts and the text of each, some at a time."""
    rows: list[int] = []
    words: list[str] = []
    for k, text in enumerate(texts):
        found = _WORD.finditer(text) if len(text) > 1 << 20 else None
        while some := [m.group() for m in islice(found, _AT_ONCE)] if found else text.split():
            rows += [k] * len(some)
            words += some
            if len(words) >= _AT_ONCE:
                yield np.array(rows), words
                rows, words = [], []
            if not found:
                break
    if words:
        yield np.array(rows), words


def _remainder(doc_id: str) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def training_words(docs: DataFrame) -> DataFrame:
    """lang, word and n: the words of at most TEXTS_PER_LANGUAGE texts of each language, by a hash of doc_id, from documents that are not held out.

    Rows that repeat a doc_id and its text count as one text.
    """
    tx = F.xxhash64("text").alias("tx")
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & (_remainder("doc_id") != HELD_OUT)).select("lang", "doc_id", "text", tx)
    keys = ["lang", "doc_id", "tx"]
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "tx"))
    chosen = cut(known.select(keys).distinct().withColumn("place", order).where(F.col("place") <= TEXTS_PER_LANGUAGE).select(keys))
    texts = known.join(chosen, keys, "left_semi").groupBy(keys).agg(F.first("text").alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            languages = batch.column("lang").to_pylist()
            for row, found in _word_runs(batch.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([languages[k] for k in row.tolist()], pa.string()), pa.array(found, pa.string())], ["lang", "word"])

    return texts.select("lang", "text").mapInArrow(words, "lang string, word string").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def learned(docs: DataFrame, names: list[str]) -> tuple[list[str], np.ndarray]:
    """The languages in order, and the chance of each piece in each; the driver gets one vector of the vocabulary's size for each language."""

    def one(words: pa.Table) -> pa.Table:
        counts = learn(Pieces(names), dict(zip(words.column("word").to_pylist(), words.column("n").to_pylist(), strict=True)))
        return pa.table({"lang": words.column("lang")[:1], "counts": pa.array([counts.tobytes()], pa.binary())})

    rows = training_words(docs).groupBy("lang").applyInArrow(one, "lang string, counts binary").collect()
    found = {r["lang"]: np.frombuffer(r["counts"]) for r in rows}
    languages = sorted(found)
    return languages, chances(np.stack([found[k] for k in languages], axis=1) if languages else np.zeros((len(names) + 1, 0)))


def predicted(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score, the posterior of the predicted language among the learned ones.

    Models are learned from text and non-null lang of the documents whose CRC-32
    of doc_id modulo 4 is not HELD_OUT; predictions see the text alone. A null
    text, one without letters, or any text where nothing could be learned is
    ``und`` with score 0. A null doc_id is not held out, and never learned
    from. Of languages that are as likely the first by name is predicted. Other
    columns are ignored; an empty table gives an empty result.
    """
    file = sentencepiece.SentencePieceProcessor(model_file=model_path or public_tokenizers.path(MODEL_FILE))
    names = [file.id_to_piece(k) for k in range(file.get_piece_size()) if not (file.is_control(k) or file.is_unknown(k) or file.is_byte(k))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    languages, chance = learned(rows, names)
    shared = docs.sparkSession.sparkContext.broadcast((names, languages, chance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, languages, chance = shared.value
        pieces = Pieces(names)
        known: dict[str, int] = {}
        logs = np.zeros((0, max(1, len(languages))))
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            lettered = np.array([bool(languages) and _LETTER.search(t) is not None for t in texts])
            total = np.zeros((len(texts), logs.shape[1]))
            for row, words in _word_runs([t if ok else "" for t, ok in zip(texts, lettered, strict=True)]):
                coded = pa.array(words, pa.large_string()).dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                if len(known) > REMEMBERED:
                    known, logs = {}, logs[:0]
                new = sorted((w for w in distinct if w not in known), key=len)
                short = sum(len(w) < TOGETHER for w in new)
                found = []
                for a in range(0, short, 4000):
                    part = new[a : min(a + 4000, short)]
                    lattice, size = pieces.lattice(["▁" + w for w in part])
                    found.append(np.log(np.maximum(forward(lattice, size, chance)[np.arange(len(part)), size], 1e-300)))
                if short < len(new):
                    found.append(pieces.log_sums(["▁" + w for w in new[short:]], chance))
                if new:
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                    logs = np.concatenate((logs, *found))
                place = np.fromiter((known[w] for w in distinct), np.int64, len(distinct))[coded.indices.to_numpy(zero_copy_only=False)]
                total += np.stack([np.bincount(row, weights=logs[place, k], minlength=len(texts)) for k in range(logs.shape[1])], axis=1)
            best = total.argmax(axis=1)
            score = 1 / np.exp(np.maximum(total - total.max(axis=1, keepdims=True), -700)).sum(axis=1)
            named = [languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(named, pa.string()), pa.array(np.where(lettered, score, 0.0))], ["doc_id", "lang_pred", "score"])

    out = rows.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(_remainder("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
