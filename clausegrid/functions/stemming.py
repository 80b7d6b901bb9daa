"""Stems of English words, by the published Porter2 rules."""

from __future__ import annotations

import re
from functools import lru_cache

# Words with stems of their own, words that stay, and words that stay after plurals are cut.
_OWN = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_LATER = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# Endings and what replaces them, longest first among those that end alike.
_STEP2 = (
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"),
    ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"),
    ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")
_REGION = re.compile(r"^(?:gener|commun|arsen)|.*?[aeiouy][^aeiouy]")
_SHORT = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_VOWEL = re.compile(r"[aeiouy]")

# Words that an English search leaves out.
STOP_WORDS = frozenset(
    (
        "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
        "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
        "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
        "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
        "few more most other some such no nor not only own same so than too very s t can will just don should now"
    ).split()
)


def _ending(word: str, endings: tuple[str, ...]) -> str | None:
    return next((e for e in endings if word.endswith(e)), None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a word in lower case; words of one or two signs and words without letters stay."""
    if len(word) <= 2:
        return word
    if word in _OWN:
        return _OWN[word]
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", word.removeprefix("'"))
    first = m.end() if (m := _REGION.match(w)) else len(w)
    second = first + m.end() if (m := re.match(r".*?[aeiouy][^aeiouy]", w[first:])) else len(w)

    for e in ("'s'", "'s", "'"):
        if w.endswith(e):
            w = w[: -len(e)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in _LATER:
        return w

    if e := _ending(w, ("eedly", "eed")):
        w = w[: -len(e)] + "ee" if len(w) - len(e) >= first else w
    elif (e := _ending(w, ("ingly", "edly", "ing", "ed"))) and _VOWEL.search(w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif len(w) <= first and _SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    if e := _ending(w, tuple(a for a, _ in _STEP2)):
        at = len(w) - len(e)
        if at >= first and (e != "ogi" or w[at - 1 : at] == "l") and (e != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
            w = w[:at] + dict(_STEP2)[e]
    if e := _ending(w, tuple(a for a, _ in _STEP3)):
        at = len(w) - len(e)
        if at >= (second if e == "ative" else first):
            w = w[:at] + dict(_STEP3)[e]
    if (e := _ending(w, _STEP4)) and (at := len(w) - len(e)) >= second and (e != "ion" or w[at - 1 : at] in ("s", "t")):
        w = w[:at]
    if w.endswith("e") and (len(w) - 1 >= second or len(w) - 1 >= first and not _SHORT.search(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= second:
        w = w[:-1]
    return w.replace("Y", "y")
