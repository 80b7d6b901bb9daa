"""Hashes of the words of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that are hashed at a time; the tables of powers are no longer.
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (SplitMix64's finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = mix(np.arange(1, 257, dtype=np.uint64))


def lower(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z in lower case."""
    return _LOWER[data]


def _power(which: str, n: int) -> np.ndarray:
    """The first n powers, at most PIECE and a few more."""
    if len(_powers[which]) < n:
        steps = np.full(max(n, 1 << 16), _BASE if which == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[which] = np.multiply.accumulate(steps)
    return _powers[which][:n]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space, and the row of each; no run crosses a row's end."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _short_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[data] * _power("up", n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", n)[starts] + (ends - starts).astype(np.uint64))


def _long_hash(data: np.ndarray) -> int:
    """The hash of one span longer than a piece, a piece at a time."""
    total, factor = 0, 1
    for at in range(0, len(data), PIECE):
        part = data[at : at + PIECE]
        total += factor * int((_CODES[part] * _power("up", len(part))).sum(dtype=np.uint64))
        factor = factor * pow(_BASE, len(part), 1 << 64) % (1 << 64)
    return int(mix(np.array([(total + len(data)) % (1 << 64)], np.uint64))[0])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, spans in rising order: a polynomial in a fixed base, spread."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        low = int(starts[at])
        stop = int(np.searchsorted(ends, low + PIECE, side="right"))
        if stop <= at:
            out[at] = _long_hash(data[low : int(ends[at])])
            at += 1
            continue
        out[at:stop] = _short_hashes(data[low : int(ends[stop - 1])], starts[at:stop] - low, ends[at:stop] - low)
        at = stop
    return out


def _part_end(data: np.ndarray, low: int, high: int, limit: int) -> int:
    """Where a part of a row that starts at ``low`` ends: after its last blank within ``limit``, else after the next one."""
    blank = np.flatnonzero(_BLANK[data[low : low + limit]])
    if len(blank):
        return low + int(blank[-1]) + 1
    for at in range(low + limit, high, limit):
        blank = np.flatnonzero(_BLANK[data[at : min(at + limit, high)]])
        if len(blank):
            return at + int(blank[0]) + 1
    return high


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = 4 * PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of ``limit`` bytes at most, and longer rows in parts that end at white space.

    Each run has the number of its first row, where it starts, its bytes, and
    the offsets of its rows. A part is longer than the limit only where a word is.
    """
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        low, high = int(offsets[start]), int(offsets[stop])
        while high - low > limit:
            end = _part_end(data, low, high, limit)
            yield start, low, data[low:end], np.array([0, end - low])
            low = end
        yield start, low, data[low:high], np.maximum(offsets[start : stop + 1] - low, 0)
        start = stop


def word_count(data: np.ndarray, offsets: np.ndarray) -> int:
    """How many words the texts have."""
    return sum(len(word_spans(part, at)[0]) for _, _, part, at in pieces(data, offsets))


def word_pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hash and the row of each lower-cased word of the texts, a piece of these at a time."""
    for first, _, part, at in pieces(data, offsets):
        part = lower(part)
        begin, end, row = word_spans(part, at)
        if len(begin):
            yield span_hashes(part, begin, end), row + first


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)
