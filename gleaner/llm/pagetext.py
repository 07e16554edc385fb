"""What problems 3, 4 and 5 share: a page model, and which of a page's lines are its own text.

Each line is taken apart by the standard library's parser (a streaming ``HTMLParser``: left-over tags are events, the text
between them is data). The bodies were flattened before they came, so most of the tags are gone; what can still be known of
them enters the text-to-tag ratio of a line:

* *text*: the words expected to be the page's own, that is the line's words times the probability that they are, by word
  evidence (naive-Bayes log odds of "line that many pages repeat" against "paragraph"); words inside a list of links are none;
* *tags*: 1, those met, the traces that flattened markup leaves (separators of menus, bullets, arrows, "[more]" marks), and
  one for each nat by which the line looks like one that many pages repeat.

The logarithm of the ratio is smoothed over the neighbouring lines by a Gaussian, and the smoothed values of a page are split
by the threshold between two clusters (``regions``), whose centres are fitted on all pages and moved by the page's own lines.
Every line of every page is decided by its cluster, by nothing else.

Which lines pages repeat, the words and n-grams that are weighed by it and the clusters' centres are counted over all pages
(``pagescan``); ``fit`` does the same in memory.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Container, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from gleaner.functions.urls import site
from gleaner.llm.lexicon import ANY_FUNCTION, TOKEN, word_class

#: Pages that ``sample_pages`` gives by default; no model is fitted on them.
SAMPLE_PAGES = 4000
#: Distinct documents in which a line must stand to count as repeated, whatever the table's size (as in problem 1; a line
#: that reaches it on one site reaches it overall), and those from which the share of a line's followers is judged.
REPEATED, OFTEN = 5, 10

#: Keys up to which a plain set holds them (about 60 bytes each), beyond it ``Hashes``.
FEW = 200_000
#: Steps of a smoothed ratio by which the clusters' centres are fitted, and of a line's surprise, so that sums over all
#: pages are of whole numbers and don't depend on their order.
GRID, STEP = 10_000, 1 << 20
#: Short lines whose evidence a worker keeps, and how short.
KNOWN, SHORT = 40_000, 200

WORD = re.compile(r"[^\W\d_]+")
_SENTENCE_END = re.compile(r"(?<![.!?…])[.!?…]++[\"”’“»)]*(?=\s|$)")
_LEAD = re.compile(r"^[\s»>*•·–—\-]+")
_SEPARATED = re.compile(r"[|•·/»>–-]|\s\s")  # what every separator holds
_BRACKET = re.compile(r"\[[^\[\]\s]{1,12}\]")
_SEPARATOR = re.compile(r"\s+[|•·/»>–-]\s+|\s{2,}|\s*[|•·]\s*")
_LABEL = re.compile(r"^([^:\d]{2,24}?)\s*(?::|\s[-–])\s+\S")
_DATE = re.compile(r"\b\d{1,2}[./-]\d{1,2}[./-](?:19|20)\d\d\b|\b\d{1,2}\.?\s+[^\W\d_]{3,10}\s+(?:19|20)\d\d\b|\b(?:19|20)\d\d-\d\d-\d\d\b")


def _word_byte(b: int) -> str:
    c = bytes([b]).decode("cp1252", "replace")
    return c.lower() if WORD.fullmatch(c) else " "


_WORD_BYTES = "".join(map(_word_byte, range(256))).encode("cp1252")


def lower_words(text: str) -> tuple[str, ...]:
    """Runs of letters in lower case. Texts in the signs of one page, nearly all, are cut up by a table of its bytes."""
    try:
        return (*text.encode("cp1252").translate(_WORD_BYTES).decode("cp1252").split(),)
    except UnicodeEncodeError:
        return (*WORD.findall(text.lower()),)


#: 1 for what counts, 0 for what stands between: letters, and pieces that white space separates.
_LETTER_RUNS = bytes(b != 32 for b in _WORD_BYTES)
_PIECE_RUNS = bytes(not bytes([b]).decode("cp1252", "replace").isspace() for b in range(256))


def _runs(text: str, table: bytes) -> int:
    """Runs of 1 in a text whose signs one page has."""
    cut = text.encode("cp1252").translate(table)
    return cut.count(b"\0\1") + cut.startswith(b"\1")


def count_lower_words(text: str) -> int:
    """How many ``lower_words`` there are."""
    try:
        return _runs(text, _LETTER_RUNS)
    except UnicodeEncodeError:
        return len(lower_words(text))


def count_pieces(text: str) -> int:
    """How many pieces white space leaves."""
    try:
        return _runs(text, _PIECE_RUNS)
    except UnicodeEncodeError:
        return len(text.split())


_LINE_BYTES = _WORD_BYTES[:10] + b"\n" + _WORD_BYTES[11:]
#: Letters that cp1252 has where Latin-1 has none.
_BEYOND_LATIN = bytes(b for b in set(_WORD_BYTES) if 0x80 <= b < 0xA0)


def each_lower_words(texts: list[str]) -> list[tuple[str, ...]]:
    """``lower_words`` of texts, cut up together where none of them holds a line end or a sign that the page doesn't have."""
    try:
        cut = "\n".join(texts).encode("cp1252").translate(_LINE_BYTES)
    except UnicodeEncodeError:
        return [*map(lower_words, texts)]
    each = cut.decode("cp1252" if any(map(cut.__contains__, _BEYOND_LATIN)) else "latin-1").split("\n")
    return [(*x.split(),) for x in each] if len(each) == len(texts) else [*map(lower_words, texts)]


class _Events(HTMLParser):
    """Text and number of tags of a line that holds markup."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.tags = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1

    def handle_endtag(self, tag):
        self.tags += 1

    def handle_data(self, data):
        self.text.append(data)


def parse_line(line: str) -> tuple[str, int]:
    """Text of a line and its number of tags; only lines with markup go through the parser."""
    if "<" not in line:
        return line, 0
    p = _Events()
    p.feed(line)
    p.close()
    return "".join(p.text), p.tags


def own_key(words: Sequence[str], host: str) -> str:
    """Key of a line whatever its marks, digits and case; the site's own name is masked."""
    return " ".join(["§" if w == host else w for w in words] if host in words else words)


def hashed(key: str | bytes) -> int:
    """64 bits of a key, the same on every worker."""
    return xxh64_intdigest(key) - (1 << 63)


class Hashes:
    """A set of hashed keys in eight bytes each."""

    def __init__(self, keys: Iterable[int] = ()) -> None:
        self.sorted = array("q", sorted(set(keys)))

    def __contains__(self, key: int) -> bool:
        i = bisect_left(self.sorted, key)
        return i < len(self.sorted) and self.sorted[i] == key


class Weights(dict):
    """Word evidence; words that are too rare have none."""

    def __missing__(self, word: str) -> float:
        return 0.0


class HashedWeights(Weights):
    """Word evidence by the words' hashes, where a page came with that of its own words."""

    def __init__(self, by_hash: Mapping[int, float]) -> None:
        super().__init__()
        self.by_hash = by_hash

    def __missing__(self, word: str) -> float:
        return self.by_hash.get(hashed(word), 0.0)

    def get(self, word: str, default: float | None = None) -> float | None:
        return self.by_hash.get(hashed(word), default)


@dataclass
class LineTables:
    """The lines that pages repeat. Of those of a whole collection, or of those that one page's lines may be looked up in."""

    keys: Container[int] = field(default_factory=Hashes)  # masked keys of repeated lines
    skeletons: dict[int, int] = field(default_factory=dict)  # ASCII letters of the keys that hold others -> key
    openers: Container[int] = field(default_factory=Hashes)  # those that open a list of other pages
    tags: Container[int] = field(default_factory=Hashes)  # labels before lists of tags


@dataclass
class PageModel:
    """Fitted tables. That of n-grams is bounded by the word classes; ``weights`` and ``lines`` are set for each page where the
    collection's words or repeated lines are too many to be sent to every worker."""

    weights: Weights = field(default_factory=Weights)  # log odds of words: repeated line / paragraph
    lines: LineTables = field(default_factory=LineTables)
    ngrams: dict[str, float] = field(default_factory=lambda: Ngrams())  # how surprising a word class is after three others
    prose: tuple[float, float] = (0.0, 1.0)  # mean and deviation of a token's surprise in paragraphs, for a line of 25
    centres: tuple[float, float] = (-2.5, 2.8)  # of the smoothed ratio, in boilerplate and content
    seen: dict[str, Line] = field(default_factory=dict)  # evidence of short lines, kept by each worker

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}


#: n-gram order, and the surprise of a class that no fallback knows.
ORDER, UNSEEN = 4, 9.0


#: Pieces between white space whose classes a worker keeps, and how long.
PIECES, PIECE = 200_000, 40


class _Classes(dict):
    """The classes of a piece's tokens, kept for the worker's life up to a bound."""

    def __missing__(self, piece: str) -> str:
        classes = "".join(map(word_class, TOKEN.findall(piece)))
        if len(self) < PIECES and len(piece) <= PIECE:
            self[piece] = classes
        return classes


_CLASSES = _Classes()


def class_string(text: str) -> str:
    """The classes of a line's tokens, of which none goes beyond white space."""
    return "".join(map(_CLASSES.__getitem__, text.split()))


class Ngrams(dict):
    """-ln P(class | three classes before) by n-gram; unseen ones fall back on the last two classes, and are kept."""

    def __missing__(self, gram: str) -> float:
        x = self.get(gram[-2:], UNSEEN) + 1.5
        if len(self) < 100_000:
            self[gram] = x
        return x


def surprise(m: PageModel, classes: str) -> float:
    """Mean over a line's tokens and its end of -ln P(class | three classes before)."""
    s = "^^^" + classes + "$"
    n = len(classes) + 1
    return sum(map(m.ngrams.__getitem__, [s[i : i + ORDER] for i in range(n)])) / n


def prose_string(text: str) -> str | None:
    """The classes of a text between marks of its start and end, where it holds enough function words."""
    c = class_string(text)
    words = sum(map(c.count, "flCAx"))
    return "^^^" + c + "$" if words >= 8 and c.count("f") >= 0.2 * words else None


def _codes(strings: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The signs of strings of ``ORDER`` signs at least, the number of each of their n-grams by the signs' places, and where each string's begin."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    raw = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    signs = np.flatnonzero(np.bincount(raw))
    at = np.searchsorted(signs, np.arange(signs[-1] + 1))[raw]
    code = at[: len(at) - ORDER + 1]
    for i in range(1, ORDER):
        code = code * len(signs) + at[i : len(at) - ORDER + 1 + i]
    live = np.ones(len(at), bool)
    last = np.cumsum(size)
    for i in range(1, ORDER):
        live[last - i] = False
    return "".join(map(chr, signs)), code[live[: len(code)]], np.r_[0, np.cumsum(size - ORDER + 1)[:-1]]


def _places(signs: str, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams and where among them each one is; as the classes are few, by a table of all that there may be."""
    if len(signs) ** ORDER > 1 << 22:
        return np.unique(code, return_inverse=True)
    here = np.bincount(code) > 0
    return np.flatnonzero(here), (np.cumsum(here) - 1)[code]


def _grams(signs: str, codes: np.ndarray) -> list[str]:
    k = len(signs)
    return ["".join([signs[c // k**i % k] for i in range(ORDER - 1, -1, -1)]) for c in codes.tolist()]


def count_grams(strings: Mapping[str, int]) -> Counter:
    """The n-grams of strings that came so many times."""
    out, times = Counter(), np.fromiter(strings.values(), np.int64, len(strings))
    if strings:
        each = [*strings]
        signs, code, start = _codes(each)
        found, at = _places(signs, code)
        n = np.bincount(at, np.repeat(times, np.diff(np.r_[start, len(code)])), len(found))
        out.update(dict(zip(_grams(signs, found), n.astype(np.int64).tolist())))
    return out


def gram_table(four: Mapping[str, int]) -> Ngrams:
    """The surprise of each n-gram, and of its last two classes for those that are unseen, from the n-grams' counts."""
    three, two, one = Counter(), Counter(), Counter()
    for k, n in four.items():
        three[k[:-1]] += n
        two[k[-2:]] += n
        one[k[-2]] += n
    table = {k: -math.log((n + 0.1) / (three[k[:-1]] + 1.0)) for k, n in four.items()}
    return Ngrams(table | {k: -math.log((n + 0.1) / (one[k[0]] + 1.0)) for k, n in two.items()})


def surprise_sums(table: Ngrams, strings: Iterable[tuple[str, int]]) -> tuple[int, int, int]:
    """Number, sum and sum of squares of the surprise of strings that came so many times, in ``STEP``-ths of a nat."""
    strings = list(strings)
    if not strings:
        return 0, 0, 0
    signs, code, start = _codes([s for s, _ in strings])
    found, at = _places(signs, code)
    each = np.array([table[g] for g in _grams(signs, found)])[at]
    x = np.rint(STEP * np.add.reduceat(each, start) / np.diff(np.r_[start, len(code)])).astype(np.int64).tolist()
    times = [n for _, n in strings]
    return sum(times), sum(n * v for n, v in zip(times, x)), sum(n * v * v for n, v in zip(times, x))


def prose_of(count: int, total: int, squares: int) -> tuple[float, float]:
    """Mean and deviation of ``surprise_sums``, the deviation 0.02 at least."""
    if not count:
        return 1.0, 1.0
    return total / count / STEP, max(math.sqrt(max(0, count * squares - total * total)) / count / STEP, 0.02)


def fit_prose(strings: Mapping[str, int]) -> tuple[Ngrams, tuple[float, float]]:
    """Class n-grams of paragraphs that hold enough function words, and how surprising a paragraph is by itself."""
    table = gram_table(count_grams(strings))
    return table, prose_of(*surprise_sums(table, strings.items()))


_LEADING, _TRAILING = frozenset(" \t»>*•·–—-\xa0"), frozenset(">»→].…")


def _without_end(text: str) -> str:
    """``text`` without the arrow, dots or bracket at its end."""
    last = text[-1:]
    if last in (">", "»"):
        return text.rstrip(last).rstrip()
    if last in ("→", "…"):
        return text[:-1].rstrip()
    if text.endswith("..."):
        return text[:-3].rstrip()
    at = text.rfind("[") if last == "]" else -1
    return text[:at].rstrip() if at >= 0 and _BRACKET.fullmatch(text, at) else text


def core(line: str) -> tuple[str, int]:
    """A line without bullets, arrows and marks of its ends, and how many such traces there were."""
    text, traces = parse_line(line)
    text = text.rstrip()
    if not text:
        return text, traces
    if text[0] in _LEADING:
        cut = _LEAD.sub("", text)
        traces += cut != text.lstrip()
        text = cut
    if text[-1:] in _TRAILING:
        cut = _without_end(text)
        traces += 2 * (cut != text)
        text = cut
    return text, traces


def ends_sentence(text: str) -> bool:
    """Whether a sentence ends in the text."""
    return ("." in text or "!" in text or "?" in text or "…" in text) and _SENTENCE_END.search(text) is not None


def is_paragraph(text: str, words: Sequence[str]) -> bool:
    return len(words) >= 12 and (len(text) > 160 or len(_SENTENCE_END.findall(text)) >= 2)


def skeleton(key: str) -> int | None:
    """What wrong decoding leaves of a key with other than ASCII letters."""
    return None if key.isascii() else ascii_hash(key)


def ascii_hash(key: str) -> int | None:
    left = key.encode("ascii", "ignore").replace(b" ", b"")
    return hashed(left) if left else None


@dataclass(slots=True)
class Shape:
    """What a line is by itself: its text and traces, words, letters and their key, and the label in front of a list."""

    text: str
    traces: int
    words: tuple[str, ...]
    letters: str = ""
    key: int = 0
    label: tuple[str, ...] = ()  # words of the label in front
    front: tuple[int, int | None, bool] | None = None  # key and skeleton of the label, whether tags follow


def shape(raw: str, host: str) -> Shape:
    text, traces = core(raw)
    return _shape(text, traces, lower_words(text), host)


def _shape(text: str, traces: int, words: tuple[str, ...], host: str) -> Shape:
    if not words:
        return Shape(text, traces, words)
    letters = own_key(words, host)
    label, front = (), None
    if (":" in text or "-" in text or "–" in text) and (head := _LABEL.match(text)):
        label = words[: len(WORD.findall(head.group(1)))]
        if label:
            name = own_key(label, host)
            front = hashed(name), skeleton(name), "," in text and not ends_sentence(text)
    return Shape(text, traces, words, letters, hashed(letters), label, front)


class Shapes(dict):
    """Shapes of short lines that don't name their site, kept up to a bound."""

    def of(self, raw: str, host: str) -> Shape:
        x = self.get(raw)
        if x is None or host in x.words:
            x = shape(raw, host)
            if len(raw) <= SHORT and host not in x.words:
                if len(self) >= KNOWN:
                    self.clear()
                self[raw] = x
        return x

    def of_page(self, lines: list[str], host: str) -> list[Shape]:
        """``of`` of a page's lines; those that aren't known are cut up together."""
        out = [*map(self.get, lines)]
        new = [i for i, x in enumerate(out) if x is None or host in x.words]
        cores = [core(lines[i]) for i in new]
        for i, (text, traces), words in zip(new, cores, each_lower_words([text for text, _ in cores])):
            x = out[i] = _shape(text, traces, words, host)
            if len(lines[i]) <= SHORT and host not in words:
                if len(self) >= KNOWN:
                    self.clear()
                self[lines[i]] = x
        return out


def page_facts(shapes: list[Shape], headings: list[str] | None) -> dict[tuple[bool, int], tuple[int | None, bool, bool]]:
    """(front, key) -> (skeleton, a, o) of a page's lines: for each line whether it may open a list and whether one follows,
    and for the label in front of a line (``front``) whether tags follow."""
    own = {h.strip() for h in headings if h} if headings else ()
    out: dict[tuple[bool, int], tuple[int | None, bool, bool]] = {}
    page = [x for x in shapes if x.words]
    for x, after in zip(page, [*page[1:], None]):
        a = after is not None and len(x.words) <= 6 and x.text not in own
        o = a and after.traces >= 2
        if had := out.get((False, x.key)):
            a, o = a or had[1], o or had[2]
        out[False, x.key] = had[0] if had else skeleton(x.letters), a, o
        if x.front:
            had = out.get((True, x.front[0]))
            out[True, x.front[0]] = x.front[1], True, x.front[2] or had is not None and had[2]
    return out


def sample_pages(pages: DataFrame, n: int = SAMPLE_PAGES) -> list:
    """At most ``n`` pages as (host label, headings, body, language), those with the lowest hash of their id.

    The hash is cut at the share that gives about ``1.2 n`` pages, so however many tasks there are, they send no more than
    that to the driver together.
    """
    have = pages.count()
    span = 1 << 40
    cut = span if have <= 1.2 * n else int(span * 1.2 * n / have)
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(span))
    rows = (
        pages.select(h.alias("h"), F.substring_index(site(F.col("url")), ".", 1).alias("host"), "headings", "body", "language")
        .where((F.col("h") < cut) & (F.col("body") != "") & F.col("doc_id").isNotNull()).collect()
    )
    rows.sort(key=lambda r: (r.h, r.body))
    return [(r.host or "", r.headings or [], r.body, r.language) for r in rows[:n]]


def judge_lines(rows: Iterable[tuple[bool, int, int | None, int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(kind, key, value) of the repeated lines, from (front, key, skeleton, documents, a, o) of the lines and labels in
    ``REPEATED`` documents or more: a "line" with 1 where it opens lists, a label before "tags", a "bare" skeleton's key."""
    for front, k, z, docs, a, o in rows:
        if front:
            if docs < OFTEN or o < 0.6 * docs:
                continue
            yield "tags", k, 1
        else:
            yield "line", k, int(a >= OFTEN and o >= 0.15 * a)
        if z is not None:
            yield "bare", z, k


def line_tables(rows: Iterable[tuple[str, int, int]]) -> LineTables:
    """The tables of ``judge_lines``' rows; of several keys with one skeleton the largest stands for it."""
    found: dict[str, list[tuple[int, int]]] = {"line": [], "tags": [], "bare": []}
    for kind, k, v in rows:
        found[kind].append((k, v))
    lines = found["line"]
    pack = frozenset if len(lines) <= FEW else Hashes
    return LineTables(pack(k for k, _ in lines), dict(sorted(found["bare"])), pack(k for k, v in lines if v), pack(k for k, _ in found["tags"]))


def count_sample(sample: list) -> LineTables:
    """The counts of a sample that is all there is."""
    docs, a, o, bare, shapes = Counter(), Counter(), Counter(), {}, Shapes()
    for host, headings, body, _ in sample:
        for key, (z, x, y) in page_facts([shapes.of(line, host) for line in body.split("\n")], headings).items():
            bare[key] = z
            docs[key] += 1
            a[key] += x
            o[key] += y
    return line_tables(judge_lines((*key, bare[key], n, a[key], o[key]) for key, n in docs.items() if n >= REPEATED))


class Evidence:
    """Counts of words in repeated lines and in paragraphs, and the class strings of prose, by which lines are weighed. Every line is
    added as one that no pages repeat, those that they do are then set right, so the counts may be below zero in between."""

    def __init__(self) -> None:
        self.repeated, self.paragraphs, self.prose = Counter(), Counter(), Counter()

    def add(self, text: str, words: Sequence[str]) -> tuple[bool, str | None] | None:
        """A line that pages have; what it counts as, for ``again``."""
        return self._count(text, words, 1, 1) if len(words) >= 8 else None

    def again(self, text: str, what: tuple[bool, str | None] | None, n: int) -> None:
        """A line that was added and that pages have ``n`` times more."""
        if what:
            para, s = what
            if para:
                _add(self.paragraphs, set(lower_words(text)), n)
            if s:
                self.prose[s] += n

    def set_right(self, text: str, words: Sequence[str], host: str, n: int, free: int) -> None:
        """A repeated line that was added ``n`` times, ``free`` of them other than as a heading of its page."""
        if free:
            _add(self.repeated, {"§" if w == host else w for w in words}, free)
        if len(words) >= 8:
            self._count(text, words, -free, -n)

    def _count(self, text: str, words: Sequence[str], n: int, times: int) -> tuple[bool, str | None] | None:
        para = is_paragraph(text, words)
        if not para and not ends_sentence(text):
            return None
        own = set(words) if para else words
        if para:
            _add(self.paragraphs, own, n)
        s = prose_string(text) if not ANY_FUNCTION.isdisjoint(own) else None
        if s:
            self.prose[s] += times
        return para, s


def _add(counts: Counter, words: set[str], n: int) -> None:
    if n == 1:
        counts.update(words)
    else:
        for w in words:
            counts[w] += n


#: Times that a word must have come in repeated lines and paragraphs together to be weighed.
WEIGHED = 3


def word_weight(b: int, p: int, nb: int, np_: int) -> float:
    """Log odds of a word, by its times in repeated lines and paragraphs and those of all words."""
    return max(-4.0, min(4.0, math.log((b + 0.3) / (nb + 1)) - math.log((p + 0.3) / (np_ + 1))))


def fit_centres(counts: Mapping[int, int], centres: tuple[float, float]) -> tuple[float, float]:
    """Centres of the two clusters of smoothed ratios that came so many times, in ``GRID``-ths."""
    low, high = centres
    for _ in range(10):
        cut = (low + high) / 2 * GRID
        over, below = [(q, n) for q, n in counts.items() if q >= cut], [(q, n) for q, n in counts.items() if q < cut]
        new = _mean(below, low), _mean(over, high)
        if new == (low, high):
            break
        low, high = new
    return low, high


def _mean(counts: list[tuple[int, int]], empty: float) -> float:
    n = sum(n for _, n in counts)
    return sum(q * n for q, n in counts) / n / GRID if n else empty


def fit(sample: list, lines: LineTables | None = None) -> PageModel:
    """Fit the word evidence, words of repeated lines against those of paragraphs, the n-grams and the clusters' centres,
    all without labels, on pages that are all there is. ``lines`` holds what they repeat."""
    lines = lines or count_sample(sample)
    found, shapes = Evidence(), Shapes()
    for host, headings, body, _ in sample:
        own = {h.strip() for h in headings if h} if headings else ()
        for x in [shapes.of(line, host) for line in body.split("\n")]:
            if x.words:
                found.add(x.text, x.words)
                if x.key in lines.keys:
                    found.set_right(x.text, x.words, host, 1, int(x.text not in own))
    b, p = found.repeated, found.paragraphs
    nb, np_ = sum(b.values()), sum(p.values())
    weights = Weights({w: word_weight(b[w], p[w], nb, np_) for w in b.keys() | p.keys() if b[w] + p[w] >= WEIGHED})
    m = PageModel(weights, lines, *fit_prose(+found.prose))
    counts = Counter()
    for host, headings, body, _ in sample:
        counts.update(round(v * GRID) for v in smoothed(page_ratios(m, [read_line(m, x, host) for x in body.split("\n")], headings)))
    m.centres = fit_centres(counts, m.centres)
    return m


#: Nats of evidence from which a line is rather one that many pages repeat.
EVEN = 2.0


@dataclass(slots=True)
class Line:
    """A line's evidence; ``ratio`` is that of a line outside lists of links, ``linked`` inside one."""

    text: str
    words: tuple[str, ...]
    strong: bool = False  # looks like a line that many pages repeat
    opens: bool = False  # opens a list of other pages
    para: bool = False
    ratio: float = 0.0
    linked: float = 0.0
    judged: tuple[int, bool] | None = None  # problem 5: its words, whether it's abnormal


def _structure(m: PageModel, x: Shape, s: float, host: str) -> tuple[float, int]:
    """Evidence from labels before lists and from menu separators, for lines that end no sentence, and the separators."""
    if x.front:
        key, bare, _ = x.front
        if key in m.lines.tags or "�" in x.text and bare in m.lines.skeletons or sum(map(m.weights.__getitem__, x.label)) >= 1.0:
            s = max(s, 0.0) + 4.0
    if not _SEPARATED.search(x.text):
        return s, 0
    parts = [p for p in _SEPARATOR.split(x.text) if p]
    if len(parts) >= 3 and max(map(len, parts)) <= 40:
        s += 2.0 * len(parts)
    if len(parts) >= 2:
        front = WORD.findall(parts[0].lower())
        if front and (hashed(own_key(front, host)) in m.lines.keys or sum(map(m.weights.__getitem__, front)) >= 3.0):
            s = max(s, 0.0) + 4.0
    return s, max(0, len(parts) - 1)


def asked(x: Shape, host: str) -> Iterator[tuple[str, int]]:
    """(kind, key) of all that the evidence of a line looks up in the repeated lines and the weighed words."""
    if not x.words:
        return
    yield "line", x.key
    yield "word", hashed("§")
    for w in x.words:
        yield "word", hashed(w)
    if not x.text.isascii():
        if (bare := ascii_hash(x.letters)) is not None:
            yield "bare", bare
    if x.front:
        yield "tags", x.front[0]
        if x.front[1] is not None:
            yield "bare", x.front[1]
    parts = [p for p in _SEPARATOR.split(x.text) if p]
    if len(parts) >= 2 and (front := WORD.findall(parts[0].lower())):
        yield "line", hashed(own_key(front, host))


def weigh(m: PageModel, x: Shape, host: str) -> Line:
    """A line's evidence and text-to-tag ratios, whatever its place."""
    words, text = x.words, x.text
    if not words:
        return Line(text, words)
    weights, count = m.weights, len(words)
    each = [*map(weights.get, words)]
    s = sum(filter(None, each))
    if host in words:
        s += words.count(host) * (weights["§"] - weights[host])
    if count >= 8 and None in each:  # lower-case words that are too rare speak against a line that pages repeat
        s -= 2.0 * len([w for w, x in zip(words, each) if x is None and w in text])
    key = x.key
    repeated = key in m.lines.keys
    if not repeated and not text.isascii():  # wrongly decoded letters: compare what is left of the key
        key = m.lines.skeletons.get(ascii_hash(x.letters), key)
        repeated = key in m.lines.keys
    if repeated:
        s = max(s, 0.0) + 6.0
    if count <= 14 and ("19" in text or "20" in text) and _DATE.search(text):
        s += 6.0
    separators = 0
    if text[-1] not in ".!?…" and not ends_sentence(text):
        s, separators = _structure(m, x, s, host)
    if count >= 9 and not repeated and s < 1.0 * count and text[0].isupper() and text[-1] == "." and not x.traces:
        s = min(s, 0.0)
    strong = s > EVEN
    own = 0.0 if x.traces >= 2 else count / (1.0 + math.exp(min(s - EVEN, 50.0))) + 0.5 * max(0.0, min(-s, 30.0))
    tags = x.traces + separators + max(0.0, s)
    para = not strong and x.traces < 2 and is_paragraph(text, words)
    return Line(text, words, strong, strong and key in m.lines.openers, para, _log_ratio(own, tags), _log_ratio(0.0, tags + LIST_TAGS))


#: Tags around an entry of a list of links; bound of a logarithmic ratio, so that a line's own stands against its neighbours'.
LIST_TAGS, BOUND = 5, 3.5
#: The ratio of the page's headings, which its own markup named.
HEADING = 3.0


def _log_ratio(words: float, tags: float) -> float:
    return max(-BOUND, min(BOUND, math.log1p(words) - math.log1p(tags)))


def read_line(m: PageModel, raw: str, host: str) -> Line:
    """A line's evidence; that of short lines that don't name their site is kept."""
    x = m.seen.get(raw)
    if x is None or host in x.words:
        x = weigh(m, shape(raw, host), host)
        if len(raw) <= SHORT and host not in x.words:
            if len(m.seen) >= KNOWN:
                m.seen.clear()
            m.seen[raw] = x
    return x


def read_page(m: PageModel, lines: list[str], host: str) -> list[Line]:
    """``read_line`` of a page's lines; those that aren't known are cut up together."""
    out = [*map(m.seen.get, lines)]
    new = [i for i, x in enumerate(out) if x is None or host in x.words]
    cores = [core(lines[i]) for i in new]
    for i, (text, traces), words in zip(new, cores, each_lower_words([text for text, _ in cores])):
        x = out[i] = weigh(m, _shape(text, traces, words, host), host)
        if len(lines[i]) <= SHORT and host not in words:
            if len(m.seen) >= KNOWN:
                m.seen.clear()
            m.seen[lines[i]] = x
    return out


def own_headings(headings: list[str] | None) -> set[str]:
    return {core(h)[0] for h in headings if h} if headings else set()


def page_ratios(m: PageModel, lines: list[Line], headings: list[str] | None) -> list[float]:
    """Logarithmic text-to-tag ratios of a page's lines with letters. A line that opens a list of other pages is the start
    event of a list of links, which the next paragraph or heading ends."""
    own, out, inside = own_headings(headings), [], False
    for x in lines:
        if not x.words:
            continue
        if x.text in own:
            inside = False
            out.append(HEADING)
            continue
        if x.opens:
            inside = True
        elif x.para:
            inside = False
        out.append(x.linked if inside else x.ratio)
    return out


#: Gaussian over the neighbouring lines, its deviation in lines.
DEVIATION = 0.5
_KERNEL = tuple(math.exp(-d * d / (2 * DEVIATION**2)) for d in (0, 1, 2))


def smoothed(ratio: list[float]) -> list[float]:
    """The Gaussian mean of each line's surroundings."""
    k0, k1, k2 = _KERNEL
    n = len(ratio)
    whole = k0 + k2 + k1 + k1 + k2
    out = [(k0 * x + k2 * b2 + k1 * b1 + k1 * a1 + k2 * a2) / whole for b2, b1, x, a1, a2 in zip(ratio, ratio[1:], ratio[2:], ratio[3:], ratio[4:])]
    ends = [_smooth_end(ratio, i) for i in (*range(min(2, n)), *range(max(2, n - 2), n))]
    return ends[:2] + out + ends[2:]


def _smooth_end(ratio: list[float], i: int) -> float:
    """``smoothed`` of one line, whose surroundings the page's ends may cut."""
    k0, k1, k2 = _KERNEL
    n = len(ratio)
    total, weight = k0 * ratio[i], k0
    for j, k in ((i - 2, k2), (i - 1, k1), (i + 1, k1), (i + 2, k2)):
        if 0 <= j < n:
            total += k * ratio[j]
            weight += k
    return total / weight


def two_means(values: list[float], centres: tuple[float, float], prior: float) -> tuple[float, float]:
    """Centres of two clusters in one dimension, each starting with the weight of ``prior`` values at the given centre."""
    low, high = centres
    for _ in range(10):
        cut = (low + high) / 2
        over = [v for v in values if v >= cut]
        below, n = sum(values) - sum(over), len(values) - len(over)
        new = (below + prior * centres[0]) / (n + prior) if n + prior else low, (sum(over) + prior * centres[1]) / (len(over) + prior) if over or prior else high
        if new == (low, high):
            break
        low, high = new
    return low, high


#: Lines that the centres of all pages count for beside a page's own.
PRIOR_LINES = 8.0


def regions(ratio: list[float], centres: tuple[float, float] = (-2.5, 2.8), prior: float = PRIOR_LINES) -> list[bool]:
    """Content regions: lines whose smoothed ratio lies in the upper of the page's two clusters."""
    return upper(smoothed(ratio), centres, prior)


def upper(smooth: list[float], centres: tuple[float, float], prior: float = PRIOR_LINES) -> list[bool]:
    """Which smoothed ratios of a page lie in the upper of its two clusters."""
    low, high = two_means(smooth, centres, prior)
    cut = (low + high) / 2
    return [x >= cut for x in smooth]


OWN, PAGE = 0, 1


def label_lines(m: PageModel, lines: list[Line], headings: list[str] | None) -> list[int]:
    """For each line 1 where it is not the page's own text, else 0; lines without letters get 0."""
    content = iter(regions(page_ratios(m, lines, headings), m.centres))
    return [PAGE if x.words and not next(content) else OWN for x in lines]
