"""License scans by an exact set-similarity join of text blocks with notice templates.

A block is a line of text; a longer one is cut into overlapping blocks. As
notices are wrapped over several lines, the words of a text of more than one
line are cut into overlapping blocks as well, across its lines. A template is found in a block if the block holds at least THRESHOLD of its
distinct words. The words of all templates are ordered by how many blocks of
the whole corpus hold them, rarest first. A block that meets the threshold must
hold one of a template's first few words in that order (prefix filter), have
words enough (length filter), and enough of them must come after the first
common word on both sides (positional filter); only then the overlap is counted.

Beside that, base phrases are found wherever their words stand consecutively.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import slices, utf8
from clausegrid.llm.words import lower, pieces, span_hashes

THRESHOLD = 0.9
BLOCK_WORDS = 48
_STEP = BLOCK_WORDS // 2

# Base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Sentences of public license notices and their labels.
TEMPLATES = (
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BLOCK = "struct<label:string,word:bigint,words:int,containment:double>"
_PLACE = "struct<label:string,word:bigint>"


def _hash(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    size = np.array([len(w.encode()) for w in words])
    ends = np.cumsum(size + 1) - 1
    return span_hashes(data, ends - size, ends)


class Scanner:
    """The templates as sets of numbered words, and slices of text as blocks of them."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES):
        sets = [sorted(set(text.split())) for text, _ in templates]
        words = sorted({w for s in sets for w in s})
        h = _hash(words)
        by = np.argsort(h)
        self.hashes, self.words = h[by], [words[i] for i in by]
        place = {w: i for i, w in enumerate(self.words)}
        self.member = np.zeros((len(words), len(templates)), bool)
        for t, s in enumerate(sets):
            self.member[[place[w] for w in s], t] = True
        self.size = self.member.sum(axis=0)
        self.need = np.ceil(THRESHOLD * self.size - 1e-9).astype(np.int64)
        self.labels = [label for _, label in templates]
        self.phrases = [(_hash(text.split()), text.split(), label) for text, label in phrases]

    def read(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """The words of the texts: starts, ends, row, hash, place in the row, and place in the line."""
        data = lower(data)
        parts, lines = [], 0
        for row, low, part, at in pieces(data, offsets):
            inside = _WORD[part]
            edge = np.zeros(len(part) + 1, bool)
            edge[at] = True
            starts = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | edge[:-1])) if len(part) else np.zeros(0, np.int64)
            ends = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | edge[1:])) + 1 if len(part) else starts
            breaks = np.flatnonzero(part == 10)
            parts.append((starts + low, ends + low, np.searchsorted(at, starts, side="right") - 1 + row, np.searchsorted(breaks, starts) + lines))
            lines += len(breaks)
        starts, ends, row, line = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
        line = line + row
        first = np.searchsorted(row, np.arange(len(offsets) - 1))
        new = np.ones(len(starts), bool)
        new[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        n = np.arange(len(starts))
        sizes = np.diff(np.append(begin, len(starts)))
        h = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        return {"data": data, "start": starts, "end": ends, "row": row, "hash": h, "in_row": n - first[row] if len(n) else n, "in_line": n - begin[number] if len(n) else n, "line": number, "line_size": sizes}

    def views(self, w: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        """The words by lines, and those of texts of more than one line once more, each text as a single line."""
        yield w
        first_line = np.concatenate(([True], w["row"][1:] != w["row"][:-1]))[: len(w["row"])]
        lines = np.bincount(w["row"][w["in_line"] == 0], minlength=int(w["row"][-1]) + 1) if len(w["row"]) else np.zeros(0, np.int64)
        more = lines[w["row"]] > 1
        if more.any():
            number = np.cumsum(first_line[more]) - 1
            whole = {c: w[c][more] for c in ("start", "end", "row", "hash", "in_row")}
            yield {"data": w["data"], **whole, "in_line": whole["in_row"], "line": number, "line_size": np.bincount(number)}

    def blocks(self, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of block and template word: block numbers, words, and a word of the text that stands for the block; and the first block of each line."""
        at = np.minimum(np.searchsorted(self.hashes, w["hash"]), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == w["hash"]) if len(w["hash"]) else np.zeros(0, np.int64)
        steps = np.maximum(1, -(-w["line_size"] // _STEP))
        base = np.cumsum(steps) - steps
        cell = base[w["line"][hit]] + w["in_line"][hit] // _STEP
        earlier = w["in_line"][hit] >= _STEP
        block, word, source = np.concatenate((cell, cell[earlier] - 1)), np.concatenate((at[hit], at[hit][earlier])), np.concatenate((hit, hit[earlier]))
        _, first = np.unique(block * len(self.words) + word, return_index=True)
        return block[first], word[first], source[first], base

    def found(self, w: dict[str, np.ndarray], rank: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """Row, template, first word of the block, words in it and containment of every block that meets the threshold."""
        block, word, source, base = self.blocks(w)
        if not len(block):
            return []
        by = np.lexsort((rank[word], block))
        block, word, source = block[by], word[by], source[by]
        new = np.ones(len(block), bool)
        new[1:] = block[1:] != block[:-1]
        begin, number = np.flatnonzero(new), np.cumsum(new) - 1
        sizes = np.diff(np.append(begin, len(block)))
        order = np.argsort(rank)
        member = self.member[order]
        position = np.cumsum(member, axis=0) - 1
        out = []
        for t in range(len(self.size)):
            prefix = self.size[t] - self.need[t] + 1
            i = position[rank[word], t]
            meets = np.flatnonzero(self.member[word, t] & (i < prefix))
            if not len(meets):
                continue
            _, first = np.unique(number[meets], return_index=True)
            meets = meets[first]
            b, j = number[meets], meets - begin[number[meets]]
            room = 1 + np.minimum(self.size[t] - i[meets] - 1, sizes[b] - j - 1)
            b = b[(sizes[b] >= self.need[t]) & (room >= self.need[t])]
            if not len(b):
                continue
            overlap = np.add.reduceat(self.member[word, t].astype(np.int64), begin)[b]
            for k, n in zip(b[overlap >= self.need[t]].tolist(), overlap[overlap >= self.need[t]].tolist(), strict=True):
                any_word = int(source[begin[k]])
                line, inside = int(w["line"][any_word]), int(w["in_line"][any_word])
                cell = int(block[begin[k]] - base[line])
                start = cell * _STEP
                size = min(BLOCK_WORDS, int(w["line_size"][line]) - start)
                out.append((int(w["row"][any_word]), t, int(w["in_row"][any_word]) - inside + start, size, n / int(self.size[t])))
        return out

    def places(self, w: dict[str, np.ndarray]) -> list[tuple[int, int, str]]:
        """Row, word and label of every place where the words of a base phrase stand consecutively."""
        out = []
        h, row = w["hash"], w["row"]
        for hashes, words, label in self.phrases:
            n = len(h) - len(hashes) + 1
            if n <= 0:
                continue
            ok = (h[:n] == hashes[0]) & (row[:n] == row[len(hashes) - 1 :])
            for k in range(1, len(hashes)):
                ok &= h[k : n + k] == hashes[k]
            for i in np.flatnonzero(ok).tolist():
                if all(w["data"][w["start"][i + k] : w["end"][i + k]].tobytes() == x.encode() for k, x in enumerate(words)):
                    out.append((int(row[i]), int(w["in_row"][i]), label))
        return out


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    counts = np.zeros(len(scanner.words), np.int64)
    for batch in slices(batches, "text"):
        for w in scanner.views(scanner.read(*utf8(batch.column("text")))):
            _, word, _, _ = scanner.blocks(w)
            counts += np.bincount(word, minlength=len(counts))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts), dtype=np.int32)), pa.array(counts)], ["word", "n"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (label and word of each base place) and blocks (label, first word, words, containment).

    Words are runs of digits, a-z after lower-casing A-Z, and characters beyond
    ASCII, numbered from 0. A null or empty text has none. Rows may repeat and
    keep their own result; other columns are ignored; an empty table gives an
    empty result. The order of template words is broadcast; it is as long as
    the fixed templates.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = len(Scanner().words)
    counts = np.zeros(size, np.int64)
    for r in texts.select("text").mapInArrow(_block_counts, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        counts[r.word] = r.n
    rank = np.empty(size, np.int64)
    rank[np.lexsort((np.arange(size), counts))] = np.arange(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        kinds = [pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())])), pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int32()), ("containment", pa.float64())]))]
        for batch in slices(batches, "text"):
            w = scanner.read(*utf8(batch.column("text")))
            base: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            blocks: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for row, word, label in scanner.places(w):
                base[row].append({"label": label, "word": word})
            for row, t, word, words, share in dict.fromkeys(x for v in scanner.views(w) for x in scanner.found(v, rank)):
                blocks[row].append({"label": scanner.labels[t], "word": word, "words": words, "containment": share})
            n_words = np.bincount(w["row"], minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(base, kinds[0]), pa.array(blocks, kinds[1])], ["doc_id", "n_words", "base", "blocks"])

    return texts.mapInArrow(run, f"doc_id long, n_words long, base array<{_PLACE}>, blocks array<{_BLOCK}>")


def license_labels(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score, the greatest containment found (1 with a base place)."""
    found = scan(docs)
    names = F.transform("base", lambda x: x["label"])
    more = F.transform("blocks", lambda x: x["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["word"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(names, more))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda x: x["containment"])), F.lit(0.0))).alias("score"),
    )
