"""The Porter stemmer with the common extensions (irregular forms, short ``ies``/``ied`` words, ``alli`` and ``logi``).

Written from the published algorithm. ``stem_tokens`` runs in an Arrow function with a dictionary per worker, so each
distinct term is stemmed once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

# Words with a stem of their own, and the suffix tables of steps 2 to 4.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _m(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(stem).count("vc")


def _cvc(word: str) -> bool:
    s = _shape(word)
    return s == "vc" or s[-3:] == "cvc" and word[-1] not in "wxy"


def _first(word: str, rules: tuple, holds: Callable[[str], bool]) -> str:
    """Apply the first rule whose suffix the word has, if its condition holds."""
    for suffix, to in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + to if holds(stem) else word
    return word


def _plural(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-1]
    return _first(w, (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")), lambda _: True)


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _m(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if "v" not in _shape(stem):
                continue
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c":
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _m(stem) == 1 and _cvc(stem) else stem
    return w


def _step2(w: str) -> str:
    if w.endswith("alli") and _m(w[:-4]) > 0:
        return _step2(w[:-2])
    if w.endswith("logi"):
        return w[:-1] if _m(w[:-3]) > 0 else w
    return _first(w, STEP2, lambda s: _m(s) > 0)


def _step4(w: str) -> str:
    for suffix in STEP4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem if _m(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")) else w
    return w


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters stay."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and len(w) > 2 and _shape(w)[-2] == "c":
        w = w[:-1] + "i"
    w = _step4(_first(_step2(w), STEP3, lambda s: _m(s) > 0))
    if w.endswith("e"):
        m = _m(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _m(w[:-1]) > 1 else w


def stem_term(term: str, keep: str = "tubingen") -> str:
    return term if term == keep else stem(term)


def _stems(terms: pa.Array) -> pa.Array:
    """Stems of terms, each distinct one stemmed once."""
    coded = terms.dictionary_encode()
    return pa.array([stem_term(t) for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


@F.arrow_udf(ArrayType(StringType()))
def _stem_lists(lists: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(lists.offsets, _stems(lists.values))


def stem_tokens(lists: Column) -> Column:
    """Stems of each list's terms in order; the town's name stays whole. Null stays null."""
    lists = F.col(lists) if isinstance(lists, str) else lists
    stems = _stem_lists(F.coalesce(lists, F.array().cast("array<string>")))
    return F.when(lists.isNotNull(), stems)


@F.arrow_udf(StringType())
def stem_column(terms: pa.Array) -> pa.Array:
    return _stems(terms)
