"""Text functions: folding, accents, tokens, stopwords, snippets, sentences, as Column expressions where Spark can."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# The stopwords of the default analyzer. English, then German.
ENGLISH_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "by",
    "can", "cannot", "could", "did", "do", "does", "doing", "down", "during", "each",
    "few", "for", "from", "further", "had", "has", "have", "having", "he", "her",
    "here", "hers", "herself", "him", "himself", "his", "how", "i", "if", "in",
    "into", "is", "it", "its", "itself", "just", "me", "more", "most", "my",
    "myself", "no", "nor", "not", "of", "off", "on", "once", "only", "or",
    "other", "our", "ours", "ourselves", "out", "over", "own", "same", "she", "should",
    "so", "some", "such", "than", "that", "the", "their", "theirs", "them", "themselves",
    "then", "there", "these", "they", "this", "those", "through", "to", "too", "under",
    "until", "up", "very", "was", "we", "were", "what", "when", "where", "which",
    "while", "who", "whom", "why", "will", "with", "you", "your", "yours", "yourself",
)
GERMAN_STOPWORDS = (
    "aber", "alle", "als", "also", "am", "an", "auch", "auf", "aus", "bei",
    "bin", "bis", "bist", "da", "damit", "dann", "das", "dass", "dein", "deine",
    "dem", "den", "der", "des", "dich", "die", "dies", "diese", "dieser", "dieses",
    "doch", "dort", "du", "durch", "ein", "eine", "einen", "einer", "eines", "er",
    "es", "euch", "eure", "für", "hatte", "hatten", "hier", "ich", "ihm", "ihn",
)
STOPWORDS = tuple(dict.fromkeys(ENGLISH_STOPWORDS + GERMAN_STOPWORDS))

# Spellings of the town's name that are one term, in the order in which they are replaced. Only the first
# one counts inside longer words.
TOWN = "tubingen"
TOWN_FOLDINGS = (
    (r"(?iu)tübingen", TOWN),
    (r"(?iU)\btuebingen\b", TOWN),
    (r"(?iU)\btubingen\b", TOWN),
    (r"(?iU)\bt(?:ü|Ã¼|ã¼|ãœ|ăź)bingen\b", TOWN),
)
# Fixed value: the topic of a crawl, searched in lower-cased url, title and body.
TOPIC_PATTERN = r"t(?:[ueü]{1,6}|&#?x?[0-9a-z]{2,6};|(?:%[0-9a-f]{2}){2})bingen"

#: Latin letters whose accents a translate() can take off: decomposed by the rule of Unicode, up to Latin Extended-A.
_FOLDABLE = {chr(c): d for c in range(0xC0, 0x180) if len(d := "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) == 1 and d != chr(c)}
_FROM, _TO = "".join(_FOLDABLE), "".join(_FOLDABLE.values())


@F.pandas_udf(StringType())
def _nfkd(texts: pd.Series) -> pd.Series:
    """Unicode's own decomposition without combining signs, for texts that translate() can't settle."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def strip_accents(text: Column, exact: bool = True) -> Column:
    """Letters without accents; ``ß`` stays, ligatures and fractions come apart (NFKD).

    Latin letters are handled inside the JVM; with ``exact``, rows with other signs that decompose go through an Arrow
    function. Without it they stay as they are.
    """
    plain = F.translate(text, _FROM, _TO)
    if not exact:
        return plain
    return F.when(plain.rlike(r"[^\x00-\x7fßÆæØøÐðÞþĐđĦħıĸŁłŊŋŒœŦŧ“”„‘’‚–—€•«»©]"), _nfkd(text)).otherwise(plain)


def fold_town(text: Column, foldings: Sequence[tuple[str, str]] = TOWN_FOLDINGS) -> Column:
    """Spellings of the town's name made one; the table is a parameter."""
    return reduce(lambda t, f: F.regexp_replace(t, *f), foldings, text)


def tokens(text: Column, stopwords: Sequence[str] = STOPWORDS, foldings: Sequence[tuple[str, str]] = TOWN_FOLDINGS, exact: bool = True) -> Column:
    """Unstemmed terms: folded, without accents, lower case, runs of letters and digits, no stopwords, two signs at least.

    Null and empty texts give an empty array. Accents go before the stopwords are looked up, so ``für`` stays as ``fur``.
    """
    low = F.lower(strip_accents(fold_town(F.coalesce(text, F.lit("")), foldings), exact))
    found = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*stopwords) if stopwords else F.length(t) > 1)


def list_tokens(values: Column, **kw) -> Column:
    """Terms of a list of texts, as of the texts joined by spaces."""
    return tokens(F.array_join(F.coalesce(values, F.array().cast("array<string>")), " "), **kw)


def snippet(text: Column, length: int = 1000) -> Column:
    """The text's beginning, cut at a space and marked by dots where it is longer."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(F.length(t) <= length, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, length), " [^ ]*$", ""), F.lit("...")))


def clean_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def sentences(text: Column, least: int = 35, most: int = 340) -> Column:
    """Sentences of ``least`` to ``most`` characters, split after ``.``, ``!`` or ``?`` and white space."""
    parts = F.transform(F.split(clean_spaces(text), r"(?<=[.!?])\s+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: (F.length(s) >= least) & (F.length(s) <= most))


def is_on_topic(url: Column, title: Column, body: Column, pattern: str = TOPIC_PATTERN) -> Column:
    """Whether the topic stands in url, title or body; headings don't count."""
    return F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))).rlike(pattern)


def duration(seconds: Column) -> Column:
    """``1h02m03s``, ``2m03s`` or ``3s``."""
    s = F.floor(seconds).cast("bigint")
    h, m, r = F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), s % 60
    return F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, r)).when(m > 0, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", r))


def runtime(seconds: Column) -> Column:
    """``<0.001s`` or seconds with three decimals."""
    return F.when(seconds < 0.001, F.lit("<0.001s")).otherwise(F.format_string("%.3fs", seconds))


def iso_time(ts: Column) -> Column:
    """A timestamp as ISO text in UTC seconds; the session's time zone has to be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
