"""A page's language, by a byte n-gram model fitted on labelled texts or by closed-class words, and the test for English pages."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.urls import url_part

# Closed-class words that tell the languages apart.
PROFILES = {
    "en": "the and of to in is that it with for was on are as at by from this which but not have".split(),
    "de": "der die das und ist nicht ein eine mit von den dem des auf für sich auch bei aus oder wird sind".split(),
    "fr": "le les des est une dans et du qui que pour pas sur au avec ce cette sont par plus ou".split(),
    "es": "el los las una es del que en por con para se su al como más pero son está muy y".split(),
    "it": "il gli della che è un di una per non del con sono nel alla dei anche più ma si lo".split(),
}


def _among(words: list[str]):
    return lambda w: w.isin(*words)


def detect_language(text: Column, html_lang: Column | None = None) -> Column:
    """The language with most closed-class words in the text, the first of the list on a tie; where none stands there the
    primary part of ``html_lang``; else ``unknown``. The whole text counts, natively."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    scores = [F.struct(F.size(F.filter(words, _among(ws))).alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, (lang, ws) in enumerate(PROFILES.items())]
    best = F.array_max(F.array(*scores))
    fallback = F.lit("unknown")
    if html_lang is not None:
        fallback = F.coalesce(F.nullif(F.substring_index(F.lower(html_lang), "-", 1), F.lit("")), fallback)
    return F.when(best["n"] > 0, best["lang"]).otherwise(fallback)


def looks_english(url: Column, language: Column) -> Column:
    """English by its label; unlabelled pages by ``/en`` in the path."""
    known = F.coalesce(language, F.lit(""))
    return F.when(known == "en", True).when(~known.isin("", "unknown"), False).otherwise(F.lower(url_part(url, "path")).contains("/en"))


#: Buckets of the hashed n-grams, their length in bytes, and labelled texts that a model is fitted on at most.
BUCKETS, GRAM, SAMPLE = 1 << 16, 3, 4000


def _grams(text: str) -> np.ndarray:
    """Hashed n-grams of a text's letters, words apart."""
    low = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    b = np.frombuffer(low.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(b) < GRAM:
        return np.zeros(0, np.int64)
    code = b[: len(b) - GRAM + 1].copy()
    for i in range(1, GRAM):
        code = code * np.uint32(257) + b[i : len(b) - GRAM + 1 + i]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


class NgramLanguages:
    """Multinomial naive Bayes over byte n-grams; any number of languages, those of the labels."""

    def __init__(self, langs: list[str], weights: np.ndarray) -> None:
        self.langs, self.weights = langs, weights

    @classmethod
    def fit(cls, labelled: Iterable[tuple[str, str]]) -> NgramLanguages:
        """From (text, language) pairs."""
        counts: dict[str, np.ndarray] = {}
        for text, lang in labelled:
            counts.setdefault(lang, np.zeros(BUCKETS)).__iadd__(np.bincount(_grams(text), minlength=BUCKETS))
        langs = sorted(counts)
        table = np.stack([counts[x] for x in langs], axis=1) + 0.1 if langs else np.zeros((BUCKETS, 0))
        return cls(langs, np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32))

    def detect(self, text: str | None) -> tuple[str | None, float]:
        """(language, confidence 0..1) of the whole text; no language where it has no letters or nothing was fitted."""
        grams = _grams(text) if text and self.langs else ()
        if len(grams) <= 1:
            return None, 0.0
        scores = self.weights[grams].astype(np.float64).sum(axis=0)
        odds = np.exp((scores - scores.max()) / np.sqrt(len(grams)))  # n-grams of a text overlap, so they count by their root
        best = int(scores.argmax())
        return self.langs[best], float(odds[best] / odds.sum())


def fit_languages(texts: DataFrame, text: str, label: str, langs: Iterable[str] = tuple(PROFILES), sample: int = SAMPLE) -> NgramLanguages:
    """Fit on at most ``sample`` rows labelled with one of ``langs``, those with the lowest hash of their text. Some labels may be
    wrong; a model of counts bears that."""
    rows = texts.where(F.lower(label).isin(*langs) & (F.length(text) > 0)).select(F.col(text).alias("t"), F.lower(label).alias("l"))
    picked = rows.orderBy(F.xxhash64("t"), "l").limit(sample)
    return NgramLanguages.fit((r.t, r.l) for r in picked.collect())


def detect_by_ngrams(text: Column, model: NgramLanguages) -> Column:
    """(lang, confidence) by a fitted model; nulls and texts without letters have a null language."""

    @F.arrow_udf("lang string, confidence double")
    def run(texts: pa.Array) -> pa.Array:
        found = [model.detect(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], names=["lang", "confidence"])

    return run(text)
