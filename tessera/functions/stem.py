"""Porter's suffix-stripping algorithm, for distinct vocabulary terms only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The suffix rules of the published algorithm, in its order.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")


def _consonant(w: str, i: int) -> bool:
    c = w[i]
    return c not in "aeiou" and not (c == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    shape = [_consonant(w, i) for i in range(len(w))]
    return sum(1 for a, b in zip(shape, shape[1:], strict=False) if not a and b)


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _short(w: str) -> bool:
    n = len(w)
    return n >= 3 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


def porter(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        for end, new in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted((*STEP4, "ion"), key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


_known: dict[str, str] = {}


def known_stem(term: str) -> str:
    """The stem of a term in running text; a worker remembers up to 200,000 terms, then it starts anew."""
    found = _known.get(term)
    if found is None:
        if len(_known) >= 200_000:
            _known.clear()
        found = _known[term] = porter(term)
    return found


def _stems(terms: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in terms:
        yield s.map(lambda t: porter(t) if t is not None else None)


def stem(term: Column | str) -> Column:
    """The stem of a term; for columns of distinct terms."""
    return F.pandas_udf(_stems, "string")(term)
