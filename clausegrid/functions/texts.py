"""Text expressions: tokens, sanitising, personal data."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether the lower-cased text holds any of the terms."""
    return reduce(lambda a, b: a | b, (F.lower(text).contains(t.lower()) for t in terms))


_PARTS = (r"\\.(?:[?*+]|\{[^}]*\})?", r"\[[^\]]*\](?:[?*+]|\{[^}]*\})?", r"\(\?[a-z]+\)", r"[^|()\\][?*]")


def plain_words(pattern: str) -> list[str]:
    """Runs of three letters or more, in lower case, that any text must hold where the pattern is found; none if that is not plain."""
    for part in _PARTS:
        pattern = re.sub(part, " ", pattern)
    while (inner := re.sub(r"\([^()]*\)(?:[?*+]|\{[^}]*\})?", " ", pattern)) != pattern:
        pattern = inner
    return [] if "|" in pattern else re.findall(r"[a-z]{3,}", pattern.lower())


def _alternatives(pattern: str) -> list[list[str]]:
    """The alternatives of each group that must be there, nested ones as they are written."""
    for part in _PARTS[:3]:
        pattern = re.sub(part, " ", pattern)
    out, depth, begin, cuts = [], 0, 0, []
    for i, sign in enumerate(pattern):
        depth += (sign == "(") - (sign == ")")
        if sign == "(" and depth == 1:
            begin, cuts = i + 1, []
        elif sign == "|" and depth < 2:
            if not depth:
                return []
            cuts.append(i)
        elif sign == ")" and not depth and pattern[i + 1 : i + 2] not in ("?", "*", "{") and not re.match(r"\?[^:]", pattern[begin:]):
            out.append([pattern[a:b].removeprefix("?:") for a, b in zip([begin, *(c + 1 for c in cuts)], [*cuts, i], strict=True)])
    return out


def needed(pattern: str) -> list[list[str]]:
    """Sets of words of three letters or more, of each of which any text must hold one where the pattern is found.

    The words are in lower case if the pattern takes any case, else as they are written.
    """
    sets = [[w] for w in plain_words(pattern)]
    for alternatives in _alternatives(pattern):
        each = [max(plain_words(a), key=len, default="") for a in alternatives]
        if all(each):
            sets.append(sorted(set(each)))
    if "(?i)" in pattern:
        return sets
    written = set(re.findall(r"[A-Za-z]+", re.sub(r"\\.", " ", pattern)))
    forms = [[[x for x in sorted(written) if x.lower() == w] for w in ws] for ws in sets]
    return [[x for xs in each for x in xs] for each in forms if all(each)]


def found(text: Column, low: Column, pattern: str, as_given: str | None = None) -> Column:
    """Whether the pattern is found in the text, which is searched for the words that the pattern needs first; ``low`` is the text in lower case.

    ``as_given`` is the pattern before it was put into Java's form.
    """
    given = as_given or pattern
    where = low if "(?i)" in given else text
    some = [reduce(lambda a, b: a | b, (where.contains(w) for w in ws)) for ws in needed(given)]
    return reduce(lambda a, b: a & b, [*some, text.rlike(pattern)])


def replaced(text: Column, pattern: str, by: str, if_: Callable[[Column], Column]) -> Column:
    """The text with the pattern replaced, for which only texts are read that meet a condition; the others must not hold it."""
    return F.get(F.transform(F.array(text), lambda t: F.when(if_(t), F.regexp_replace(t, pattern, by)).otherwise(t)), F.lit(0))
