"""Problem 2: garbled text from wrong character encoding.

A wrong decoding replaces each letter by one fixed sign or run of signs, so within a source it is a substitution cipher.

1. *Scan.* Fields whose non-ASCII runs aren't ordinary give their cipher units with the characters on both sides. Units of
   common swaps are built from Python's code pages by rule (every pair of a true and a wrong encoding, also applied twice and
   with lowered case). Units of any other swap are *free*: runs of signs of other scripts that touch a Latin letter, which no
   language writes. Units inside proper quotation marks are citations and left out.
2. *EM per source.* The units' contexts are counted per site. Expectation: how likely is each target letter in its
   context under a character-bigram model of clean text, times the source's current table; maximisation: the table's new
   weights. The code pages only give the start weights of their units; the reading of a sign itself ("it is right as it
   stands") is one of the targets. A free unit may stand for any target, starting from the letters' own frequencies; which
   signs begin a letter (misread UTF-8 writes several for one) is learned from the source's runs.
3. *Decision.* A field is reported when reading its units by the source's table makes them more likely than they are as
   they stand, by at least ``GAIN`` nats. A second rule reports the replacement sign, which nothing can read back.
4. *Repair.* The table is applied with ``str.translate`` for single signs and one regular expression for runs.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.functions.urls import site
from gleaner.session import materialize

#: Nats by which a field's units must gain from being read through the table, and the most that one unit counts for.
GAIN, MOST = 4.0, 20.0
#: Start weight of letters that no code page gives a unit, all together beside 1 of a usual swap.
UNLISTED = 0.05
#: Free units: fewest in a source, least mean log probability of a bigram with the target, signs of a run at most; different
#: contexts in which a listed unit must be met before it is given an unlisted letter.
FREE_UNITS, FREE_FIT, FREE_SIGNS, FREE_CONTEXTS = 2, -5.0, 12, 3
#: Characters of a citation in quotation marks at most; longer ones are passages of the text itself.
CITED = 60
#: Rounds of EM, weight of the start table in counts, least log probability of a bigram.
ROUNDS, PRIOR, FLOOR = 6, 1.0, math.log(1e-6)
LOST = "�"

_PUNCTUATION = "“”„‘’‚–—…€•«»©®°·¿¡§\xa0ºª"
#: Letters and marks that the five languages write: Latin-1's letters, the oe ligatures and typographic marks.
TARGETS = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)) + "œŒ" + _PUNCTUATION
_PLAIN = "äöüßéèêëàâîïôûùçœáíóúñìòÄÖÜÉÈÀÂÊÎÔÛÙÇŒÑÁÍÓÚÌÒ" + _PUNCTUATION
_CLEAN = frozenset(_PLAIN).union(map(chr, range(128)))
_DOUBTFUL = frozenset("ÈÍÓÙÁÒÛÌÚÏÎÔ")  # capitals that a wrong table puts into words
_INSIDE = re.compile(r"[a-zß-ÿ][ÈÍÓÙÁÒÛÌÚÏÎÔ]")
_EARLY = frozenset("âÂÃãĂ")  # what misread UTF-8 often begins with
_HARMLESS = "".join(sorted(_CLEAN - _EARLY - _DOUBTFUL)).encode("cp1252")
_LATE = re.compile(f"[{''.join(sorted(_EARLY))}][^\\x00-\\x7f]")
_QUOTED = re.compile("|".join(f"{a}[^{a}{b}\\n]{{1,{CITED}}}[{b}]" for a, b in (("“", "”"), ("„", "“”"), ("«", "»"), ("‘", "’"))))

# Code pages by which UTF-8 is often read, and pairs of one-byte pages (true, read as).
WIDE = ("cp1252", "latin_1", "cp437", "cp850", "cp1251", "mac_roman", "cp1250", "iso8859_2", "iso8859_15")
NARROW = (
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1252", "cp1250"),
    ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"),
)


def _read(raw: bytes, page: str) -> str:
    """Bytes in a code page; bytes that it doesn't define become the control signs of the same number."""
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(page))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@cache
def units() -> dict[str, dict[str, float]]:
    """Cipher unit -> target -> start weight. Twice and three times read text counts for the pages where it is common."""
    table: dict[str, dict[str, float]] = defaultdict(dict)

    def add(unit: str, target: str, weight: float) -> None:
        if unit != target and not unit.isascii():
            table[unit][target] = max(weight, table[unit].get(target, 0.0))

    for t in TARGETS:
        for page in WIDE:
            once = _read(t.encode(), page)
            add(once, t, 1.0)
            add(once.lower(), t.lower(), 0.5)
            if page in ("cp1252", "latin_1"):
                twice = _read(once.encode(), page)
                add(twice, t, 1.0)
                add(twice.lower(), t.lower(), 0.5)
                add(_read(twice.encode(), page), t, 0.5)
                add(_read(once.encode(), "latin_1" if page == "cp1252" else "cp1252"), t, 0.3)
        for true, page in NARROW:
            try:
                raw = t.encode(true)
            except UnicodeEncodeError:
                continue
            once = _read(raw, page)
            if len(once) == 1:
                add(once, t, 0.2)
    return dict(table)


@cache
def _unit_pattern() -> re.Pattern[str]:
    """All runs, grouped by first sign and longest first, then any other sign of a run. No unit holds an ASCII character."""
    by_first: dict[str, list[str]] = defaultdict(list)
    for u in units():
        if len(u) > 1:
            by_first[u[0]].append(u[1:])
    runs = [re.escape(a) + "(?:" + "|".join(map(re.escape, sorted(rest, key=len, reverse=True))) + ")" for a, rest in sorted(by_first.items())]
    return re.compile(r"(?=[^\x00-\x7f])(?:" + "|".join(runs) + r"|[^\x00-\x7f])")  # ASCII is passed over by one test


def suspicious(text: str) -> bool:
    """A cheap test that clean text passes: whether a field has to be looked at at all."""
    if text.isascii():
        return False
    try:  # all clean signs are in this page, so what it can't write isn't clean
        left = text.encode("cp1252").translate(None, _HARMLESS)
    except UnicodeEncodeError:
        return True
    if not left:
        return False
    signs = set(left.decode("cp1252"))
    if not signs <= _CLEAN:
        return True
    return not _EARLY.isdisjoint(signs) and _LATE.search(text) is not None or not _DOUBTFUL.isdisjoint(signs) and _INSIDE.search(text) is not None


_FREE = re.compile(rf"[^\x00-\x7f{LOST}]{{1,{FREE_SIGNS}}}+")


@lru_cache(10_000)
def _foreign(sign: str) -> bool:
    """Whether a sign is of another script than Latin and no mark or sign of Latin-1. Wide signs (ideographs, kana, Hangul), which no
    one-byte code page gives and which stand beside Latin letters in right text, are none."""
    return ord(sign) > 0xFF and sign not in _CLEAN and not unicodedata.name(sign, "").startswith("LATIN ") and unicodedata.east_asian_width(sign) not in "WF"


@lru_cache(50_000)
def _known_run(run: str) -> bool:
    """Whether no sign of a run is of another script, or the code pages' units make it up."""
    return not any(map(_foreign, run)) or run in units() or all(len(u) > 1 or not _foreign(u) for u in _unit_pattern().findall(run))


def free_runs(text: str) -> Iterator[re.Match[str]]:
    """Runs inside or beside Latin words that hold signs of other scripts and aren't made up of known units."""
    for m in _FREE.finditer(text):
        a, b = m.span()
        if (a and text[a - 1].isascii() and text[a - 1].isalpha() or b < len(text) and text[b].isascii() and text[b].isalpha()) and not _known_run(m.group()):
            yield m


def occurrences(text: str) -> Counter:
    """(unit, left, right) -> count of a field's cipher units outside citations.

    A single sign is a unit only where no other non-ASCII sign touches it (foreign words and line drawings are runs), and an
    ordinary letter or mark only as a capital inside a word. A free run is one unit, whatever number of letters it stands for.
    """
    table, out = units(), Counter()
    cited = [m.span() for m in _QUOTED.finditer(text)]
    free: set[int] = set()
    for m in free_runs(text):
        a, b = m.span()
        if not any(s < a and b < e for s, e in cited):
            left, right = text[a - 1] if a else "\n", text[b] if b < len(text) else "\n"
            out[m.group(), left if left.isascii() else "", right if right.isascii() else ""] += 1
        free.update(range(a, b))
    for m in _unit_pattern().finditer(text):
        u, (a, b) = m.group(), m.span()
        if a in free or u not in table and u != LOST:
            continue
        left, right = text[a - 1] if a else "\n", text[b] if b < len(text) else "\n"
        if len(u) == 1 and u != LOST and not (left.isascii() and right.isascii()):
            continue
        if len(u) == 1 and u in _PLAIN and not (u in _DOUBTFUL and left.islower()):
            continue
        if any(s < a and b < e for s, e in cited):
            continue
        out[u, left if left.isascii() else "", right if right.isascii() else ""] += 1
    return out


def count_pairs(texts: Iterable[str]) -> Counter:
    pairs: Counter = Counter()
    for t in texts:
        pairs.update(zip(t, t[1:]))
    return pairs


class Bigrams:
    """ln P(next sign | sign) of clean text, with a floor; an unknown neighbour ('') says nothing."""

    def __init__(self, texts: Iterable[str]) -> None:
        self._weigh(count_pairs(texts))

    @classmethod
    def of(cls, pairs: dict[tuple[str, str], int]) -> Bigrams:
        """From counted pairs."""
        m = cls.__new__(cls)
        m._weigh(pairs)
        return m

    def _weigh(self, pairs: dict[tuple[str, str], int]) -> None:
        first = Counter()
        for (a, _), n in pairs.items():
            first[a] += n
        self.table = {ab: math.log(n / (first[ab[0]] + 5.0)) for ab, n in pairs.items()}

        self.signs = {a: n / sum(first.values()) for a, n in first.items()}

    def around(self, left: str, sign: str, right: str) -> float:
        """Log probability of a sign (or several) between its neighbours."""
        get = self.table.get
        inner = sum(get(ab, FLOOR) for ab in zip(sign, sign[1:])) if len(sign) > 1 else 0.0
        return inner + (get((left, sign[0]), FLOOR) if left else 0.0) + (get((sign[-1], right), FLOOR) if right else 0.0)

    def gain(self, left: str, unit: str, right: str, target: str) -> float:
        """By how much the context fits the target better than the unit as it stands; a run's inner pairs count too."""
        stands = sum(self.table.get(ab, FLOOR) for ab in zip(unit, unit[1:])) + (self.table.get((left, unit[0]), FLOOR) if left else 0.0) + (self.table.get((unit[-1], right), FLOOR) if right else 0.0)
        return self.around(left, target, right) - stands


def fit_bigrams(pages: DataFrame) -> Bigrams:
    """From all clean titles and bodies; each task sends one count of a pair, and the driver gets the sums alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter = Counter()
        for b in batches:
            pairs.update(count_pairs(x for c in b.columns for x in c.to_pylist() if x and not suspicious(x)))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string()), pa.array(pairs.values(), pa.int64())], names=["a", "b", "n"])

    counts = pages.where("doc_id is not null").select("title", "body").mapInArrow(run, "a string, b string, n bigint")
    sums = counts.groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    return Bigrams.of({(a, b): n for a, b, n in zip(*(sums.column(c).to_pylist() for c in ("a", "b", "n")))})


def expect_maximise(contexts: list[tuple[str, str, int]], start: dict[str, float], lm: Bigrams) -> dict[str, float]:
    """Weights of a unit's targets after EM over its (left, right, count)."""
    total = sum(start.values())
    theta = {t: w / total for t, w in start.items()}
    if len(theta) == 1:
        return theta
    fits = [(n, {t: lm.around(left, t, right) for t in theta}) for left, right, n in contexts]
    for _ in range(ROUNDS):
        new = {t: PRIOR * w / total for t, w in start.items()}
        for n, fit in fits:
            top = max(fit.values())
            post = {t: theta[t] * math.exp(x - top) for t, x in fit.items()}
            z = sum(post.values()) or 1.0
            for t, x in post.items():
                new[t] += n * x / z
        z = sum(new.values())
        theta = {t: x / z for t, x in new.items()}
    return theta


def fits(contexts: list[tuple[str, str, int]], target: str, lm: Bigrams) -> bool:
    """Whether a target stands in its contexts as letters of clean text do."""
    sides = sum(n * (bool(left) + bool(right)) for left, right, n in contexts)
    return sides > 0 and sum(n * lm.around(left, target, right) for left, right, n in contexts) >= FREE_FIT * sides


def lead_signs(runs: Counter) -> set[str]:
    """The signs that begin a letter, where nearly all of a source's free runs are of two signs or more (misread UTF-8): the
    commonest first signs that begin 95 % of the runs. Empty where single signs are letters by themselves."""
    total = runs.total()
    if sum(n for u, n in runs.items() if len(u) > 1) < 0.9 * total:
        return set()
    first, covered, out = Counter(), 0, set()
    for u, n in runs.items():
        first[u[0]] += n
    for sign, n in sorted(first.items(), key=lambda x: (-x[1], x[0])):
        if covered >= 0.95 * total:
            break
        out.add(sign)
        covered += n
    return out


def letters_of(run: str, leads: set[str]) -> list[str]:
    """A free run split into the units of its letters: a lead and what follows it up to the next, or single signs."""
    if not leads:
        return list(run)
    out: list[str] = []
    for c in run:
        if not out or c in leads and not (len(out[-1]) == 1 and out[-1] in leads):
            out.append(c)
        else:
            out[-1] += c
    return out


def learn_free(seen: dict[str, list[tuple[str, str, int]]], lm: Bigrams) -> dict[str, tuple[str, float]]:
    """EM over a source's free runs: run -> (letters, least weight of one). Where the letters don't fit their contexts as clean
    text does, the run stands for itself."""
    runs = Counter({u: sum(n for *_, n in c) for u, c in seen.items()})
    leads = lead_signs(runs)
    contexts: dict[str, Counter] = defaultdict(Counter)
    for u, c in seen.items():
        parts = letters_of(u, leads)
        for i, p in enumerate(parts):
            for left, right, n in c:
                contexts[p][left if i == 0 else "", right if i == len(parts) - 1 else ""] += n
    start = {t: lm.signs[t] for t in TARGETS if t in lm.signs}
    best: dict[str, tuple[str, float]] = {}
    if start and sum(runs.values()) >= FREE_UNITS:
        for p, c in contexts.items():
            around = [(left, right, n) for (left, right), n in c.items() if left or right]
            theta = expect_maximise(around, start, lm)
            t = max(sorted(theta), key=theta.__getitem__)
            if fits(around, t, lm):
                best[p] = t, theta[t]
    out = {}
    for u in seen:
        parts = letters_of(u, leads)
        read = [best.get(p) for p in parts]
        out[u] = ("".join(t for t, _ in read), min(w for _, w in read)) if all(read) else (u, 1.0)
    return out


def learn_table(rows: list[tuple[str, str, str, int]], lm: Bigrams) -> dict[str, tuple[str, float]]:
    """EM over one source's (unit, left, right, count): unit -> (best target, its weight). The code pages say what is likely at
    the start, and the unit itself is a target of single signs; where none of these fits its contexts, any letter is. Single
    Latin letters, which may be rightly written foreign ones, have the code pages' targets only."""
    table = units()
    seen: dict[str, list[tuple[str, str, int]]] = defaultdict(list)
    free: dict[str, list[tuple[str, str, int]]] = defaultdict(list)
    for u, left, right, n in rows:
        if u != LOST:
            (seen if u in table else free)[u].append((left, right, n))
    out = learn_free(free, lm)
    any_letter = {t: UNLISTED * lm.signs[t] for t in TARGETS if t in lm.signs}
    for u, contexts in seen.items():
        start = table[u] | {u: 0.2} if len(u) == 1 else table[u]
        theta = expect_maximise(contexts, start, lm)
        best = max(sorted(theta), key=theta.__getitem__)
        if (len(u) > 1 or _foreign(u)) and len(contexts) >= FREE_CONTEXTS and not fits(contexts, best, lm):
            wide = expect_maximise(contexts, any_letter | start, lm)
            other = max(sorted(wide), key=wide.__getitem__)
            if sum(n * (lm.around(left, other, right) - lm.around(left, best, right)) for left, right, n in contexts) >= 2 * MOST:
                best, theta = other, wide
        out[u] = (best, theta[best])
    return out


def scan_units(pages: DataFrame) -> DataFrame:
    """(doc_id, field, source, unit, l, r, n) of the suspicious fields; null and clean fields give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            for d, s, title, body in zip(*(c.to_pylist() for c in b.columns)):
                for name, text in (("title", title), ("body", body)):
                    if text and suspicious(text):
                        for (u, left, right), n in occurrences(text).items():
                            for c, x in zip(cols, (d, name, s, u, left, right, n)):
                                c.append(x)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "field", "source", "unit", "l", "r", "n"])

    own = pages.where("doc_id is not null").select("doc_id", F.coalesce(site(F.col("url")), F.lit("")).alias("source"), "title", "body")
    return own.mapInArrow(run, "doc_id bigint, field string, source string, unit string, l string, r string, n bigint")


def cipher_tables(found: DataFrame, lm) -> DataFrame:
    """(source, unit, target, weight): each source's learned table. A source's group holds its distinct contexts only,
    which the units and the characters beside them bound, however many pages it has; free runs are of few signs, as those of one
    misread word."""

    def em(pdf: pd.DataFrame) -> pd.DataFrame:
        table = learn_table(list(zip(pdf.unit, pdf.l, pdf.r, pdf.n)), lm.value)
        return pd.DataFrame([(pdf.source.iloc[0], u, t, w) for u, (t, w) in table.items()], columns=["source", "unit", "target", "weight"])

    counts = found.groupBy("source", "unit", "l", "r").agg(F.sum("n").alias("n"))
    return counts.groupBy("source").applyInPandas(em, "source string, unit string, target string, weight double")


def learn(pages: DataFrame, lm: Bigrams | None = None) -> tuple[DataFrame, DataFrame, object]:
    """The units of the suspicious fields and the sources' tables, both written once, and the broadcast bigrams."""
    shared = pages.sparkSession.sparkContext.broadcast(lm or fit_bigrams(pages))
    found = materialize(scan_units(pages), "units")
    return found, materialize(cipher_tables(found, shared), "tables"), shared


def garbled_fields(pages: DataFrame, lm: Bigrams | None = None) -> DataFrame:
    """(doc_id, field, units, gain, repairable): fields that hold wrongly decoded text.

    Repeated rows give one result; rows of one page that differ are judged together. Empty tables give no rows.
    """
    return _judged(*learn(pages, lm))


def _judged(found: DataFrame, tables: DataFrame, shared) -> DataFrame:
    once = found.groupBy("doc_id", "field", "source", "unit", "l", "r").agg(F.max("n").alias("n"))
    read = once.join(tables, ["source", "unit"], "left")

    def gains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            g = [
                GAIN * 2 if u == LOST else 0.0 if t is None or t == u else min(MOST, shared.value.gain(left, u, right, t)) * n
                for u, left, right, t, n in zip(b.unit, b.l, b.r, b.target, b.n)
            ]
            yield pd.DataFrame({"doc_id": b.doc_id, "field": b.field, "n": b.n, "gain": g, "lost": b.unit == LOST})

    scored = read.mapInPandas(gains, "doc_id bigint, field string, n bigint, gain double, lost boolean")
    return (
        scored.groupBy("doc_id", "field")
        .agg(F.sum("n").alias("units"), F.round(F.sum("gain"), 3).alias("gain"), (~F.max("lost")).alias("repairable"))
        .where(F.col("gain") >= GAIN)
    )


_MAC_MARKS = re.compile(r"[A-Za-z][¸ˆ‰ﬂ˚‡ƒ‹÷]|[¸ˆ‰ﬂ˚‡ƒ‹÷][a-z]")


@cache
def _likeliest() -> tuple[dict[str, str], dict[int, str]]:
    """Target of each run by start weight alone, and of single signs by the commonest pair of one-byte pages."""
    common = {c: -i for i, c in enumerate(_PLAIN)}
    runs = {u: max(sorted(t), key=lambda c: (t[c], common.get(c, -999))) for u, t in units().items() if len(u) > 1}  # noqa: B023
    single = {ord(_read(bytes([b]), "mac_roman")): _read(bytes([b]), "cp1252") for b in range(0x80, 0x100)}
    return runs, single


def readable(text: str) -> str:
    """A garbled text read by the code pages alone, line for line, for operators that look at words and marks; clean text
    comes back as it is. Unlike ``repair_text`` it knows nothing of the source and doesn't spare citations."""
    if not suspicious(text):
        return text
    out = _BEYOND.sub(_read_run, text)
    if out == text and (_MAC_MARKS.search(text) or _INSIDE.search(text)):
        return text.translate(_likeliest()[1])
    return out


_BEYOND = re.compile(r"[^\x00-\x7f]+")


def _read_run(m: re.Match[str]) -> str:
    run = m.group()
    return _decoded(run) if len(run) <= FREE_SIGNS else _decoded.__wrapped__(run)  # long runs aren't kept


@lru_cache(50_000)
def _decoded(run: str) -> str:
    """A non-ASCII run with its units read by the code pages."""
    table = _likeliest()[0]
    return _unit_pattern().sub(lambda m: table.get(m.group(), m.group()), run)


@lru_cache(256)
def _with_free(runs: tuple[str, ...]) -> re.Pattern[str]:
    """The pattern of all units, a source's free runs first."""
    return re.compile("|".join([*map(re.escape, runs), _unit_pattern().pattern])) if runs else _unit_pattern()


def repair_text(text: str | None, table: dict[str, str]) -> str | None:
    """A field read through a source's table; citations and the replacement sign stay as they are."""
    if not text or not suspicious(text):
        return text
    # where runs show that UTF-8 was misread, single signs are right as they stand
    runs = any(len(m.group()) > 1 for m in _unit_pattern().finditer(text))
    single = {} if runs else {ord(u): t for u, t in table.items() if len(u) == 1 and u in units()}
    whole = _likeliest()[1]
    if sum(whole.get(u) == t for u, t in single.items()) >= 2:  # the source's page is known, so signs never met are too
        single = whole | single

    def one(m: re.Match) -> str:
        u = m.group()
        if len(u) > 1 or u not in units():
            return table.get(u) or _likeliest()[0].get(u, u)
        return u.translate(single)

    found = _with_free(tuple(sorted((u for u in table if u not in units()), key=len, reverse=True)))
    out, at = [], 0
    for q in _QUOTED.finditer(text):
        out += [found.sub(one, text[at : q.start()]), q.group()]
        at = q.end()
    return "".join([*out, found.sub(one, text[at:])])


def repaired(pages: DataFrame, lm: Bigrams | None = None) -> DataFrame:
    """``pages`` with ``fixed_title`` and ``fixed_body``; fields that weren't found come out unchanged, all rows stay.

    The tables (at most a few hundred short strings a source) are joined to the pages by source.
    """
    units_, tables, shared = learn(pages, lm)
    found = _judged(units_, tables, shared).groupBy("doc_id").agg(F.collect_set("field").alias("_fields"))
    tables = tables.where("target != unit")
    maps = tables.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("unit", "target"))).alias("_table")).withColumnRenamed("source", "_source")

    @F.pandas_udf("string")
    def fix(text: pd.Series, table: pd.Series) -> pd.Series:
        return pd.Series([repair_text(x, dict(t) if t is not None else {}) for x, t in zip(text, table)])

    joined = pages.join(found, "doc_id", "left").join(maps, F.coalesce(site(F.col("url")), F.lit("")) == F.col("_source"), "left")
    has = lambda f: F.coalesce(F.array_contains("_fields", f), F.lit(False))
    return (
        joined.withColumn("fixed_title", F.when(has("title"), fix("title", "_table")).otherwise(F.col("title")))
        .withColumn("fixed_body", F.when(has("body"), fix("body", "_table")).otherwise(F.col("body")))
        .drop("_fields", "_source", "_table")
    )


def p2_found(spark, sf_dir: str) -> DataFrame:
    return garbled_fields(spark.read.parquet(f"{sf_dir}/raw_pages.parquet")).select("doc_id", "field")


def p2_repaired(spark, sf_dir: str) -> DataFrame:
    return repaired(spark.read.parquet(f"{sf_dir}/raw_pages.parquet")).select("doc_id", "ingested_at", "fixed_title", "fixed_body")


QUERIES = {"p2_found": p2_found, "p2_repaired": p2_repaired}
ORACLE: dict[str, str] = {}
