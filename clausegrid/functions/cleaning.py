r"""Clean-ups and small readings of strings as Column expressions.

Classes such as \s and \w are those of ASCII.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from clausegrid.functions.texts import replaced

# Words that say nothing about a statute, and about a decision.
STATUTE_STOPS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "this", "that", "is", "are", "was", "were",
    "be", "been", "have", "has", "had", "do", "does", "did", "will", "would",
    "shall", "should", "may", "might", "can", "could", "tenant", "landlord",
)
DECISION_STOPS = ("the", "a", "an", "and", "or", "in", "on", "to", "of", "with", "tenant", "landlord", "lease", "agreement")
# Where the sources of a family stand.
STANDARD_LEASE_URL = "https://www.ontario.ca/laws/statute/06r17"
MAINTENANCE_URL = "https://www.ontario.ca/laws/regulation/060516"
RENT_URL = "https://www.ontario.ca/laws/regulation/060517"
#: White space that is more or other than one blank.
_SPACES = r"(?:[\t\n\x0B\f\r]| (?=\s))\s*"
_QUOTES_AND_DASHES = "‘’‚‛′‵`“”„‟″‶–—"
#: Signs of a text in which its first words are looked for before the others.
HEAD = 600


def trimmed(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def plain_quotes(text: Column) -> Column:
    """Curly quotes and replacement signs as plain quotes."""
    return F.translate(text, "’‘“”□�", "''\"\"''")


def normalized(text: Column) -> Column:
    """Lower case, plain quotes and dashes, single blanks: for comparing wordings."""
    return _plain(F.lower(text))


def normalized_head(text: Column, n: int) -> Column:
    """The first n signs of the normalised text; only its begin is cleaned."""
    # One more is taken, so that a blank at the end of these n is seen not to end the text.
    begin = F.regexp_extract(F.lower(text), rf"^\s*+((?:\S|\s++){{0,{n + 1}}}+)", 1)
    return F.substring(_plain(begin), 1, n)


def _plain(low: Column) -> Column:
    """Plain quotes and dashes, single blanks."""
    # Most texts have none of these signs, and a translation looks up each sign by itself.
    plain = F.when(low.rlike(f"[{_QUOTES_AND_DASHES}]"), F.translate(low, _QUOTES_AND_DASHES, "'''''''\"\"\"\"\"\"--")).otherwise(low)
    return trimmed(F.regexp_replace(plain, _SPACES, " "))


# Blocks of signs of which most stay as they are under Unicode's compatibility composition.
_BLOCKS = ((0x0, 0x24F), (0x370, 0x52F), (0x5D0, 0x5EA), (0x620, 0x64A), (0xE01, 0xE32), (0x2010, 0x203A), (0x3041, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


def _changing() -> str:
    """A class of the signs that the composition may change, or join with the sign before; all outside of the blocks are in it."""
    pairs = (unicodedata.decomposition(chr(n)).split() for n in range(0x30000))
    second = {int(p[1], 16) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
    stays = [n for lo, hi in _BLOCKS for n in range(lo, hi + 1) if n not in second and not unicodedata.combining(chr(n)) and unicodedata.normalize("NFKC", chr(n)) == chr(n)]
    runs: list[list[int]] = []
    for n in stays:
        if runs and runs[-1][1] == n - 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    # The first block is looked at alone, since a class of many ranges is slow.
    return r"(?:(?![\x00-\x9F])[^" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs) + "])"


_CHANGING = _changing()


@F.arrow_udf(ArrayType(StringType()))
def _composed(runs: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in runs:
        yield pa.array([None if r is None else [unicodedata.normalize("NFKC", x) for x in r] for r in batch.to_pylist()], pa.list_(pa.string()))


def nfkc(text: Column) -> Column:
    """Unicode's compatibility composition; null stays null.

    Of texts with signs that it may change, runs beyond ASCII go through Python,
    each with the sign before. The text should be a column, as it is read several times.
    """
    run = r"[\x00-\x9F]?[^\x00-\x9F]+"
    runs = F.when(text.rlike(_CHANGING), F.regexp_extract_all(text, F.lit(run), 0)).otherwise(F.array().cast("array<string>"))
    composed = _composed(runs)
    pieces = F.zip_with(F.split(text, run, -1), composed, lambda p, c: F.concat(p, F.coalesce(c, F.lit(""))))
    return F.when(F.size(composed) > 0, F.array_join(pieces, "")).otherwise(text)


def without_addresses(text: Column) -> Column:
    """Street addresses and units replaced."""
    streets = r"(?i)(?<![A-Za-z0-9_])\d{1,5}\s+\w[\w\s]{2,25}(?:Street|St|Avenue|Ave|Drive|Dr|Road|Rd|Boulevard|Blvd|Lane|Ln|Court|Ct|Way|Place|Pl|Crescent|Cres|Circle|Cir)(?![A-Za-z0-9_])[.,]?"
    units = r"(?i)(?<![A-Za-z0-9_])(?:Unit|Apt|Apartment|Suite)\s*\d+[A-Za-z]?(?![A-Za-z0-9_])"
    return F.regexp_replace(F.regexp_replace(text, streets, "[ADDRESS]"), units, "[UNIT]")


def safe_file_name(name: Column) -> Column:
    """Anything but ASCII letters, digits, dot, underscore and hyphen as underscores."""
    return F.regexp_replace(name, r"[^a-zA-Z0-9._-]", "_")


def base_name(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")


def title_case(text: Column) -> Column:
    """The first sign of each word in upper case; the others stay."""
    words = F.split(text, r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def form_slug(number: Column, heading: Column) -> Column:
    """form_NN_ and the heading's letters and digits, other signs as underscores, cut to 40."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(heading), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.concat(F.lit("form_"), F.lpad(number.cast("string"), 2, "0"), F.lit("_"), F.substring(slug, 1, 40))


def safe_name(name: Column) -> Column:
    """A person's name without control signs, brackets and backslashes, at most 120 signs."""
    plain = F.regexp_replace(F.regexp_replace(name, r"[\x00-\x1F\x7F]", " "), r"[<>{}\[\]\\`]", "")
    return F.substring(trimmed(F.regexp_replace(plain, r"\s{2,}", " ")), 1, 120)


def _with_steps(text: Column, steps: tuple[tuple[str, ...], ...]) -> Column:
    """The text after replacements one by one: a pattern, what stands for it, and strings of which a text must hold one where the pattern is found."""
    for pattern, by, *signs in steps:
        text = replaced(text, pattern, by, lambda t, signs=signs: reduce(lambda a, b: a | b, (t.contains(s) for s in signs)))
    return text


def safe_chat(text: Column) -> Column:
    """A chat message without control signs and a model's own marks; four line breaks or more become two."""
    steps = ((r"<\|[^|]*\|>", "", "<|"), (r"(?i)\[/?INST\]", "", "["), (r"(?i)<</?SYS>>", "", "<<"), (r"\n{4,}", "\n\n", "\n\n\n\n"))
    return trimmed(_with_steps(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), steps))


def cited_section(reference: Column) -> Column:
    """act, section and title of a reference like ``Act s.26 — Entry``; empty where it has none."""
    pattern = r"s\.(\S+)\s*[—–-]\s*(.+)"
    act = F.trim(F.element_at(F.split(reference, r"s\."), 1))
    return F.struct(act.alias("act"), F.regexp_extract(reference, pattern, 1).alias("section"), F.regexp_extract(reference, pattern, 2).alias("title"))


def source_url(act: Column, section: Column, url: Column) -> Column:
    """Where a source stands: a stable place for the families that have one, else its own."""
    name = F.lower(F.coalesce(act, F.lit("")))
    number = F.lower(F.coalesce(section, F.lit("")))
    standard = name.contains("standard form") | name.contains("standard lease") | number.startswith("form_")
    return (
        F.when(standard, STANDARD_LEASE_URL)
        .when(name.contains("516/06") | name.contains("reg. 516"), MAINTENANCE_URL)
        .when(name.contains("517/06") | name.contains("reg. 517"), RENT_URL)
        .otherwise(F.nullif(url, F.lit("")))
    )


def covers(expected: Column, found: Column) -> Column:
    """Whether a found section is the expected one or a part of it: 26 is met by 26, 26(2) and 26.1, not by 126 or 26.x."""
    inside = F.substring(found, F.length(expected) + 1, F.length(found))
    return (found == expected) | (found.startswith(expected) & (inside.startswith("(") | inside.rlike(r"^(\.\d+)+$")))


def non_ascii_share(text: Column) -> Column:
    """The share of signs beyond ASCII; 0 for an empty text."""
    return F.coalesce(F.length(F.regexp_replace(text, r"[\x00-\x7F]+", "")) / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def control_share(text: Column) -> Column:
    """The share of control signs; more than a tenth makes a text unreadable."""
    return F.coalesce(F.length(F.regexp_replace(text, r"[^\x00-\x08\x0E-\x1F\x7F-\x{9F}]+", "")) / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def decision_slug(url: Column) -> Column:
    """The case id in a decision's address, else the last part of its path in 40 signs at most."""
    case = F.upper(F.regexp_extract(url, r"(?i)/(\d{4}onltb\d+)/", 1))
    last = F.element_at(F.split(F.regexp_replace(url, "/$", ""), "/"), -1)
    return F.coalesce(F.nullif(case, F.lit("")), F.substring(F.upper(F.regexp_replace(last, r"[^a-zA-Z0-9]", "-")), 1, 40))


def clean_text(text: Column) -> Column:
    """Plain line breaks, no blanks before them, three of them at most in a row."""
    steps = ((r"\r\n?", "\n", "\r"), (r"[ \t]+\n", "\n", " \n", "\t\n"), (r"\n{4,}", "\n\n\n", "\n\n\n\n"), (r"\[object Object\]", "", "[object Object]"))
    return trimmed(_with_steps(F.coalesce(text, F.lit("")), steps))


def without_paths(message: Column) -> Column:
    """An error message without file paths, 200 signs at most; null and empty give null."""
    hidden = F.regexp_replace(message, r"(?:/[^\s,;:'\"]{2,}|[A-Z]:\\[^\s,;:'\"]{2,})", "[path]")
    return F.nullif(F.substring(hidden, 1, 200), F.lit(""))


def sentences(text: Column, ends: str = ".;") -> Column:
    """The sentences of a text, which white space after one of ``ends`` parts."""
    return F.split(text, rf"(?<=[{ends}])\s+")


def best_sentence(text: Column, words: list[str]) -> Column:
    """The first sentence with the most of the words, 300 signs at most; without any, the start of the text."""
    hits = lambda s: reduce(lambda a, b: a + b, (F.when(F.lower(s).contains(w.lower()), 1).otherwise(0) for w in words), F.lit(0))
    best = F.array_max(F.transform(sentences(text), lambda s, i: F.struct(hits(s).alias("hits"), (-i).alias("place"), trimmed(s).alias("s"))))
    dots = lambda s, n: F.when(F.length(s) > n, F.concat(trimmed(F.substring(s, 1, n)), F.lit("…"))).otherwise(s)
    start = F.concat(trimmed(F.substring(text, 1, 250)), F.when(F.length(text) > 250, "…").otherwise(""))
    return F.when((best["hits"] == 0) | (best["s"] == ""), start).otherwise(dots(best["s"], 300))


def search_words(text: Column, stops: tuple[str, ...] = STATUTE_STOPS, longer_than: int = 3, most: int = 5, once: bool = True) -> Column:
    """The first words of letters that say something, in order; each once with ``once``. A text's first signs are read, and all only where these have too few."""

    def among(low: Column) -> Column:
        words = F.split(F.regexp_replace(low, r"[^a-z\s]+", " "), r"\s+")
        kept = F.filter(words, lambda w: (F.length(w) > longer_than) & ~w.isin(*stops))
        return F.slice(F.array_distinct(kept) if once else kept, 1, most)

    # The last word of the head may go on behind it.
    head = F.regexp_replace(F.lower(F.substring(text, 1, HEAD)), r"[a-z]+$", "")
    return F.get(F.transform(F.array(among(head)), lambda found: F.when(F.size(found) >= most, found).otherwise(among(F.lower(text)))), F.lit(0))
