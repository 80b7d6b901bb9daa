"""How far the sources of a language differ in their words, in exact integers.

Terms are counted in Arrow batches and summed by Spark; those in enough
documents of their language are kept. The kept counts are dealt by hash of the
term into chunks of bounded size, each chunk meets the list of its language's
sources, and gives every pair of sources one partial sum. In a chunk, terms that
many sources have go into a dense tile of terms by sources. The others are
sparse: first they count as if no source had them, then each (source, count)
that occurs is corrected against all sources at once, and last each pair of
postings of a term is corrected for both having it. Both sums are integers and
are added exactly by a grouped shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.llm.bpe import ragged
from clausegrid.llm.common import cut, slices

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that must hold a term.
LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
#: Ranks that part ``term`` returns for a group.
RANKS = 200
#: A term is dense if this share of the sources or more have it.
DENSE = 0.5
#: Kept counts of a chunk and sources of a tile, about.
CHUNK, TILE = 1 << 17, 256
#: Distinct (lang, source, term) that a task holds, of so many bytes of text, bytes of a text and cells of a matrix at once.
_HELD, _BYTES, _PIECE, _CELLS = 1 << 20, 1 << 26, 1 << 20, 1 << 20
#: A document more, beside the occurrences, in the number that a task holds for a term.
_DOCUMENT = 1 << 40
#: The bytes of terms, A-Z in lower case, and blanks for all others.
_LETTERS = bytes(b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b > 127 else 32 for b in range(256))


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), digit by digit, so that no product overflows."""
    out, rest = np.divmod(np.asarray(counts, np.int64) + 1, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    return (p - q) * (p - q) // q


def _terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text's UTF-8 bytes, some at a time; every byte of a sign beyond ASCII belongs to a term."""
    raw, at = raw.translate(_LETTERS), 0
    while at < len(raw):
        stop = raw.find(b" ", at + _PIECE)
        stop = len(raw) if stop < 0 else stop
        yield raw[at:stop].split()
        at = stop


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents) over all documents; nulls are empty strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        within = signs = 0

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in held.items():
                both = np.fromiter(found.values(), np.int64, len(found))
                names = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(found), np.int8))) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(both & (_DOCUMENT - 1)), pa.array(both >> 40)], ["lang", "source", "term", "n", "docs"])

        for batch in slices(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for raw, lang, source in zip(texts, batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
                found = held.setdefault((lang, source), {})
                before, own = len(found), Counter()
                for some in _terms(raw):
                    own.update(some)
                get = found.get
                for t, n in own.items():
                    found[t] = get(t, 0) + n + _DOCUMENT
                within, signs = within + len(found) - before, signs + len(raw)
                if within > _HELD or signs > _BYTES:
                    yield from given()
                    held, within, signs = {}, 0, 0
        yield from given()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    partial = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, source, n, and total, the term's occurrences in its language, for the terms in enough documents."""
    of_term = Window.partitionBy("lang", "term")
    held = counts.withColumn("total", F.sum("n").over(of_term)).withColumn("found", F.sum("docs").over(of_term))
    return held.where(F.col("found") >= least).select("lang", "term", "source", "n", "total")


class Chunk:
    """Some terms of a language: of each posting its term, source (by number) and count, and the sources' denominators."""

    def __init__(self, term: np.ndarray, source: np.ndarray, n: np.ndarray, below: np.ndarray, dense: float = DENSE):
        self.below, self.absent = below, shares(np.zeros(len(below), np.int64), below)
        having = np.bincount(term) if len(term) else np.zeros(0, np.int64)
        heavy = having >= max(2.0, dense * len(below))
        row = np.cumsum(heavy) - 1
        of_heavy = heavy[term]
        self.tile = np.tile(self.absent, (int(heavy.sum()), 1))
        self.tile[row[term[of_heavy]], source[of_heavy]] = shares(n[of_heavy], below[source[of_heavy]])
        self.light = int((~heavy & (having > 0)).sum())
        order = np.lexsort((source[~of_heavy], term[~of_heavy]))
        self.term, self.source, self.n = (x[~of_heavy][order] for x in (term, source, n))
        self.p = shares(self.n, below[self.source])
        by = np.lexsort((self.p, self.source))
        s, p = self.source[by], self.p[by]
        first = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (p[1:] != p[:-1])))) if len(s) else np.zeros(0, np.int64)
        #: Each (source, share) of the light terms that occurs, and how often.
        self.own, self.value, self.often = s[first], p[first], np.diff(np.append(first, len(s)))

    def sums(self, g: int) -> np.ndarray:
        """The sum over the chunk's terms of gap(source g's share, another's), for each other source, but for light terms that both have."""
        p0 = self.absent
        nothing = gap(p0[g], p0)
        out = self.light * nothing
        step = max(1, _CELLS // max(1, len(p0)))
        for k in range(0, len(self.tile), step):
            part = self.tile[k : k + step]
            out += gap(part[:, g, None], part).sum(axis=0)
        mine = slice(*np.searchsorted(self.own, (g, g + 1)))
        for k in range(mine.start, mine.stop, step):
            some = slice(k, min(k + step, mine.stop))
            out += ((gap(self.value[some, None], p0) - nothing) * self.often[some, None]).sum(axis=0)
        np.add.at(out, self.own, (gap(p0[g], self.value) - nothing[self.own]) * self.often)
        return out

    def both(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Sources g, t and the correction for light terms that both have, summed for some terms at a time."""
        if not len(self.term):
            return
        first = np.flatnonzero(np.concatenate(([True], self.term[1:] != self.term[:-1])))
        size = np.diff(np.append(first, len(self.term)))
        ends = np.cumsum(size * size)
        k = 0
        while k < len(first):
            stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + _CELLS, side="right")))
            f, s = first[k:stop], size[k:stop]
            a = np.repeat(ragged(f, s), np.repeat(s, s))
            b = ragged(np.repeat(f, s), np.repeat(s, s))
            a, b = a[a != b], b[a != b]
            g, t, p, q = self.source[a], self.source[b], self.p[a], self.p[b]
            p0 = self.absent
            more = gap(p, q) - gap(p, p0[t]) - gap(p0[g], q) + gap(p0[g], p0[t])
            key = g * len(p0) + t
            order = np.argsort(key, kind="stable")
            key, more = key[order], more[order]
            if len(key):
                at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                yield key[at] // len(p0), key[at] % len(p0), np.add.reduceat(more, at)
            k = stop


def _ranked(terms: pa.Array, source: np.ndarray, value: np.ndarray, ranks: int) -> np.ndarray:
    """Of each source the places of the highest values, ties to the smaller term in UTF-8."""
    order = pc.sort_indices(pa.table([pa.array(source), pa.array(value), terms.cast(pa.binary())], ["s", "v", "t"]), [("s", "ascending"), ("v", "descending"), ("t", "ascending")]).to_numpy()
    s = source[order]
    first = np.searchsorted(s, s)
    return order[np.arange(len(s)) - first < ranks]


def partial_sums(rows: DataFrame, sources: DataFrame, chunks: int, tiles: int, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value: partial sums of pairs, and the best terms of each chunk.

    ``rows`` is what kept() returns, ``sources`` has lang, source, below (the
    denominator of a source's shares) and all_below (that of its language's).
    Every chunk and tile meets all sources of its language, also one without terms.
    """

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        tile = key[2].as_py()
        right = right.sort_by("source")
        names, below = right.column("source").combine_chunks(), right.column("below").to_numpy()
        lang = key[0].as_py()
        coded = left.column("term").combine_chunks().dictionary_encode()
        place = pc.index_in(left.column("source"), value_set=names).to_numpy().astype(np.int64)
        n = left.column("n").to_numpy()
        chunk = Chunk(coded.indices.to_numpy().astype(np.int64), place, n, below)
        mine = range(tile * len(names) // tiles, (tile + 1) * len(names) // tiles)
        g, t, value = [], [], []
        for i in mine:
            others = np.flatnonzero(np.arange(len(names)) != i)
            g.append(np.full(len(others), i))
            t.append(others)
            value.append(chunk.sums(i)[others])
        for a, b, more in chunk.both():
            own = (a >= mine.start) & (a < mine.stop)
            g.append(a[own])
            t.append(b[own])
            value.append(more[own])
        g, t, value = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (g, t, value))
        here = np.flatnonzero((place >= mine.start) & (place < mine.stop))
        p, q = shares(n[here], below[place[here]]), shares(left.column("total").to_numpy()[here], right.column("all_below").to_numpy()[0])
        here, p, q = here[p > q], p[p > q], q[p > q]
        best = _ranked(coded.dictionary.take(coded.indices.take(pa.array(here))), place[here], gap(p, q), ranks)
        own, value = np.concatenate((g, place[here][best])), np.concatenate((value, gap(p, q)[best]))
        item = pa.concat_arrays([names.take(pa.array(t)), coded.dictionary.take(coded.indices.take(pa.array(here[best])))])
        part = pa.array(["pair"] * len(t) + ["term"] * len(best), pa.string())
        return pa.table([pa.array([lang] * len(own), pa.string()), names.take(pa.array(own)), part, item, pa.array(value)], ["lang", "source", "part", "item", "value"])

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int")).withColumn("tile", every(tiles))
    right = sources.withColumn("chunk", every(chunks)).withColumn("tile", every(tiles))
    by = ("lang", "chunk", "tile")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, "lang string, source string, part string, item string, value long")


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = RANKS, chunk: int = CHUNK, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: pairs of sources in full, and each source's most telling terms.

    Null texts, langs and sources count as ''; every (lang, source) that occurs
    is a group, also without terms; repeated rows are documents each; other
    columns are ignored; an empty table gives an empty result. Ranks go by
    value, ties by the item's UTF-8 bytes.
    """
    rows = cut(kept(counted(docs), least))
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sizes = rows.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = rows.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("all_n"))
    filled = lambda c: F.coalesce(F.col(c), F.lit(0))
    # Without kept terms a share is never used; 1 keeps its denominator from being 0.
    below = lambda c: F.greatest(F.lit(1), filled(c) + filled("v")).alias(c.replace("n", "below"))
    sources = cut(named.join(sizes, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", below("n"), below("all_n")))
    most = sources.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1)).alias("n")).first()["n"]
    found = partial_sums(rows, sources, max(1, -(-rows.count() // chunk)), max(1, -(-most // tile)), ranks)
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return summed.withColumn("rank", rank.cast("int")).where((F.col("part") == "pair") | (F.col("rank") <= ranks))


#: The rows of divergence() with its defaults.
DIVERGENCE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT i) >= {LEAST_DOCUMENTS}),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w SEMI JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
sizes AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + CAST({SCALE} AS HUGEINT) * (coalesce(c.n, 0) + 1) // (coalesce(s.n, 0) + l.v) AS p,
         1 + CAST({SCALE} AS HUGEINT) * (k.total + 1) // (l.n + l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
         CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {RANKS}
"""
