"""The page model over a table: columns that the page problems read, lines counted over all pages, the model's fit.

One pass over the pages writes the keys and, each once a task, the texts of their lines, and counts the words and n-grams of
all paragraphs and prose. The keys tell which lines pages repeat; the texts of those are read again to set the counts right.

The lines that pages repeat grow with the number of sites, the words with the text. Up to ``BROADCAST_LINES`` and
``BROADCAST_WORDS`` they go to every worker, the lines as 64-bit hashes; beyond it each page gets those that its own lines ask
for, by shuffled joins (``with_known``). Both ways give the same labels.
"""

from __future__ import annotations

import gc
import struct
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from gleaner.functions.urls import site
from gleaner.llm.p2_mojibake import readable
from gleaner.llm.pagetext import (
    REPEATED, WEIGHED, Evidence, HashedWeights, LineTables, PageModel, Shapes, Weights, asked, count_grams, gram_table, hashed, judge_lines, line_tables, lower_words, page_facts, prose_of, surprise_sums, word_weight,
)
from gleaner.llm.pagetext import sample_pages  # noqa: F401  (part of the module's names; nothing here is fitted on it)
from gleaner.session import discard, materialize

#: Repeated lines up to which their hashes are broadcast (8 bytes each, 16 more for each that isn't ASCII).
BROADCAST_LINES = 2_000_000
#: Weighed words up to which they are broadcast (about 130 bytes each).
BROADCAST_WORDS = 500_000
#: Document ids that come more than once, up to which they are broadcast.
BROADCAST_IDS = 500_000
#: Counts that a task of the first pass holds before it gives them out.
HELD = 200_000

_TABLE = "kind string, h bigint, v bigint"


def page_columns(pages: DataFrame, *more: str) -> DataFrame:
    """What the page problems read: (doc_id, host, headings, body, known, ...) of pages with a body."""
    host = F.coalesce(F.substring_index(site(F.col("url")), ".", 1), F.lit(""))
    none = F.lit(None).cast(f"array<struct<{_TABLE.replace(' ', ':')}>>".replace(",:", ","))
    return pages.where("doc_id is not null and body is not null and body != ''").select("doc_id", host.alias("host"), "headings", "body", none.alias("known"), *more)


def page_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(doc_id, host, headings, lines, known, ...) of each page, wrongly decoded text read back."""
    for d, host, headings, body, *more in zip(*(c.to_pylist() for c in batch.columns)):
        yield d, host, [readable(h) for h in headings if h] if headings else None, page_lines(body), *more


def page_lines(body: str) -> list[str]:
    """The lines of a body, wrongly decoded text read back."""
    body = readable(body)
    return body.split("\n") if "\r" not in body else [x.removesuffix("\r") for x in body.split("\n")]


def in_worker(shared: Broadcast):
    """A broadcast model. The garbage collector leaves it and what a worker has loaded alone from here on, and looks less often at
    the rest, which hardly holds cycles."""
    value = shared.value
    gc.freeze()
    gc.set_threshold(100_000, 20, 50)
    return value


def for_page(m: PageModel, known: list[dict] | None) -> PageModel:
    """The model with the repeated lines that a page came with, where it came with them."""
    if known is None:
        return m
    weights = HashedWeights({x["h"]: _double(x["v"]) for x in known if x["kind"] == "word"})
    return replace(m, weights=weights, lines=line_tables((x["kind"], x["h"], x["v"]) for x in known if x["kind"] != "word"))


def _bits(x: float) -> int:
    return struct.unpack("q", struct.pack("d", x))[0]


def _double(bits: int) -> float:
    return struct.unpack("d", struct.pack("q", bits))[0]


def line_facts(pages: DataFrame, more: tuple = (), beside: Callable[[], tuple[Callable, Callable]] | None = None) -> DataFrame:
    """What a first pass writes of the lines of all pages: where ``front`` is set (doc_id, front, k, z, n, a, o), counts of keys by
    distinct documents; by ``kind``, of a "line", which may have its key's counts too, its text, key, site's name, where it holds that,
    and how often it came (times), and how often not as a heading (free); the others are ``line_evidence`` with the key as text.

    A task adds up its lines before it gives them out, so a hot line is one row a task; documents that come more than once
    (their ids are looked up first) send their keys with their id, so that they count once.

    ``beside`` gives for each task what takes each page with ``more`` columns (as of ``page_rows``) and what ends it; both give two
    texts of bytes, "cut" and "pages", the first where there is something to write.
    """
    ids = pages.where("doc_id is not null and body is not null and body != ''").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    many = materialize(ids.where("n > 1").select(F.col("doc_id").alias("_id")), "repeated")
    own = page_columns(pages, *more)
    if many.count() <= BROADCAST_IDS:
        own = own.join(F.broadcast(many), F.col("doc_id") == F.col("_id"), "left").withColumn("again", F.col("_id").isNotNull()).drop("_id")
    else:
        own = own.withColumn("again", F.lit(True))

    types = {"doc_id": pa.int64(), "front": pa.bool_(), **{c: pa.int64() for c in ("k", "z", "n", "a", "o", "times", "free")}, **{c: pa.string() for c in ("kind", "text", "host")}}
    if beside:
        types |= {"cut": pa.binary(), "pages": pa.binary()}

    def rows(at: dict[tuple, int], cols: tuple[list, ...], texts: dict[tuple, list], found: Evidence) -> Iterator[pa.RecordBatch]:
        for (x, _), (_, n, _, what) in texts.items():
            if n > 1:  # the first time is counted
                found.again(x, what, n - 1)
        lines, place = [], []
        for (text, host), (k, times, free, _) in texts.items():  # the key's counts come with the first text that has it
            lines.append((k, text, host, times, free))
            place.append(at.pop((None, False, k), None))
        if lines:
            k, text, host, times, free = zip(*lines)
            front = [None if i is None else False for i in place]
            yield batch(len(lines), front=front, k=k, kind=["line"] * len(lines), text=text, host=host, times=times, free=free, **{x: [None if i is None else c[i] for i in place] for x, c in zip("znao", cols)})
        if at:
            doc_id, front, k = zip(*at)
            yield batch(len(at), doc_id=doc_id, front=front, k=k, **{x: [c[i] for i in at.values()] for x, c in zip("znao", cols)})
        if more := [*evidence_rows(found)]:
            kind, text, times = zip(*more)
            yield batch(len(more), kind=kind, text=text, times=times)
        at.clear(), texts.clear()
        for c in cols:
            c.clear()

    def batch(n: int, /, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in types.items()], names=[*types])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(100_000, 20, 50)
        shapes, at, cols, texts, found = Shapes(), {}, ([], [], [], []), {}, Evidence()
        z_, n_, a_, o_ = cols
        add, rest = beside() if beside else (None, None)
        for b in batches:
            for *page, again in page_rows(b):
                if add and (done := add(page)):
                    yield batch(1, cut=done[:1], pages=done[1:])
                d, host, headings, lines, *_ = page
                own = d if again else None
                page = shapes.of_page(lines, host)
                for (front, k), (z, a, o) in page_facts(page, headings).items():
                    i = at.setdefault((own, front, k), len(n_))
                    if i < len(n_):
                        n_[i] += 1
                        a_[i] += a
                        o_[i] += o
                    else:
                        z_.append(z), n_.append(1), a_.append(int(a)), o_.append(int(o))
                named = {h.strip() for h in headings} if headings else ()
                for x in page:
                    if x.words:
                        if (had := texts.get(at_ := (x.text, host if "§" in x.letters else ""))) is None:
                            had = texts[at_] = [x.key, 0, 0, found.add(x.text, x.words)]
                        had[1] += 1
                        had[2] += x.text not in named
                if len(at) + len(texts) >= HELD:
                    yield from rows(at, cols, texts, found)
                    found = Evidence()
        yield from rows(at, cols, texts, found)
        if rest:
            done = rest()
            yield batch(1, cut=done[:1], pages=done[1:])

    kinds = "doc_id bigint, front boolean, k bigint, z bigint, n bigint, a bigint, o bigint, times bigint, free bigint, kind string, text string, host string"
    return materialize(own.mapInArrow(run, kinds + ", cut binary, pages binary" * bool(beside)), "line_facts")


def evidence_rows(found: Evidence) -> Iterator[tuple[str, str, int]]:
    """(kind, key, n) of a task's counts."""
    for kind, c in (("repeated", found.repeated), ("paragraphs", found.paragraphs), ("prose", found.prose), ("gram", count_grams(found.prose))):
        for k, n in c.items():
            if n:
                yield kind, k, n


def count_lines(pages: DataFrame) -> DataFrame:
    """(kind, h, v): the lines and labels that stand in ``REPEATED`` distinct documents or more, counted over all pages."""
    return repeated_lines(line_facts(pages))


def repeated_lines(facts: DataFrame) -> DataFrame:
    """``count_lines`` of ``line_facts``."""
    alone = F.col("doc_id").isNull()
    once = facts.where("front is not null").groupBy("front", "k", "doc_id").agg(
        F.max("z").alias("z"), *[F.when(alone, F.sum(c)).otherwise(F.max(F.least(F.col(c), F.lit(1)))).alias(c) for c in ("n", "a", "o")]
    )
    each = once.groupBy("front", "k").agg(F.max("z").alias("z"), *[F.sum(c).alias(c) for c in ("n", "a", "o")]).where(F.col("n") >= REPEATED)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = zip(*found) if (found := list(judge_lines(zip(*(c.to_pylist() for c in b.columns))))) else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64()))], names=["kind", "h", "v"])

    table = each.select("front", "k", "z", "n", "a", "o").mapInArrow(judged, _TABLE)
    return materialize(table.groupBy("kind", "h").agg(F.max("v").alias("v")), "repeated_lines")


def asked_rows(pages: DataFrame) -> DataFrame:
    """(doc_id, kind, h): what the lines of each page may be looked up by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for b in batches:
            found = [(d, *x) for d, host, _, lines, *_ in page_rows(b) for x in {x for line in lines for x in asked(shapes.of(line, host), host)}]
            cols = zip(*found) if found else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64()))], names=["doc_id", "kind", "h"])

    return pages.mapInArrow(run, "doc_id bigint, kind string, h bigint")


def with_known(pages: DataFrame, table: DataFrame) -> DataFrame:
    """``page_columns`` whose ``known`` holds the rows of ``table`` that the page's lines are looked up by; a page has as many as
    it has distinct lines at most. A skeleton's key comes with it, as the key is looked up next."""
    hit = asked_rows(pages).distinct().join(table, ["kind", "h"]).select("doc_id", "kind", "h", "v")
    next_ = hit.where("kind = 'bare'").select("doc_id", F.lit("line").alias("kind"), F.col("v").alias("h")).join(table, ["kind", "h"]).select("doc_id", "kind", "h", "v")
    own = hit.unionByName(next_).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct("kind", "h", "v")).alias("_own"))
    joined = pages.join(own, F.col("doc_id") == F.col("_id"), "left")
    return joined.select(*[F.coalesce("_own", F.array().cast(own.schema["_own"].dataType)).alias("known") if c == "known" else F.col(c) for c in pages.columns])


class Fitted:
    """A page model, the table of repeated lines where it is too large to be part of it, and what the first pass wrote ``beside``."""

    def __init__(self, model: PageModel, table: DataFrame | None = None, beside: DataFrame | None = None) -> None:
        self.model, self.table, self.beside = model, table, beside

    def columns(self, pages: DataFrame, *more: str) -> DataFrame:
        own = page_columns(pages, *more)
        return own if self.table is None else with_known(own, self.table)


def line_evidence(facts: DataFrame, table: DataFrame) -> DataFrame:
    """(kind, key, n): how often words came in "repeated" lines and in "paragraphs", and n-grams ("gram") and class strings in
    "prose", over the lines of all pages. ``table`` is that of ``repeated_lines``; the times of a key are the sum of its rows."""
    keys = table.where("kind = 'line'").select(F.col("h").alias("_h"))
    if table.count() <= BROADCAST_LINES:
        keys = F.broadcast(keys)
    texts = facts.where("kind = 'line'").join(keys, F.col("k") == F.col("_h"), "left_semi").select("text", "host", "times", "free")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(100_000, 20, 50)
        found = Evidence()
        for b in batches:
            for text, host, n, free in zip(*(c.to_pylist() for c in b.columns)):
                found.set_right(text, lower_words(text), host, n, free)
            if len(found.prose) + len(found.repeated) + len(found.paragraphs) >= HELD:
                yield rows(found)
                found = Evidence()
        yield rows(found)

    def rows(found: Evidence) -> pa.RecordBatch:
        cols = zip(*out) if (out := [*evidence_rows(found)]) else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64()))], names=["kind", "key", "n"])

    right = materialize(texts.mapInArrow(run, "kind string, key string, n bigint"), "line_evidence")
    return facts.where("kind != 'line'").select("kind", F.col("text").alias("key"), F.col("times").alias("n")).unionByName(right)


def weighed_words(evidence: DataFrame) -> tuple[DataFrame, int, int]:
    """(key, b, p) of the words that come ``WEIGHED`` times or more, and the times of all words in repeated lines and paragraphs."""
    times = {k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)) for k in ("repeated", "paragraphs")}
    words = evidence.where("kind in ('repeated', 'paragraphs')")
    nb, np_ = words.agg(*[F.coalesce(x, F.lit(0)) for x in times.values()]).first()
    each = words.groupBy("key").agg(times["repeated"].alias("b"), times["paragraphs"].alias("p")).where(F.col("b") + F.col("p") >= WEIGHED)
    return materialize(each, "words"), nb, np_


def fit_ngrams(evidence: DataFrame) -> tuple[dict, tuple[float, float]]:
    """The n-grams' surprise, whose number the word classes bound, and that of prose by itself, from all class strings of prose."""
    four = evidence.where("kind = 'gram'").groupBy("key").agg(F.sum("n").alias("n")).where("n > 0").toArrow()
    table = gram_table(dict(zip(four["key"].to_pylist(), four["n"].to_pylist())))
    shared = evidence.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = in_worker(shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([str(x)], pa.string()) for x in surprise_sums(table, zip(*(c.to_pylist() for c in b.columns)))], names=["c", "s", "q"])

    sums = evidence.where("kind = 'prose'").select("key", "n").mapInArrow(run, "c string, s string, q string")
    found = sums.agg(*[F.sum(F.col(c).cast("decimal(38,0)")) for c in sums.columns]).first()
    return table, prose_of(*(int(x or 0) for x in found))


def fit_pages(pages: DataFrame, more: tuple = (), beside: Callable[[], tuple[Callable, Callable]] | None = None) -> Fitted:
    """The page model of all pages, but for the clusters' centres, which come from the lines that it has read (``pagetext.fit_centres``).
    ``more`` and ``beside`` are those of ``line_facts``."""
    facts = line_facts(pages, more, beside)
    table = repeated_lines(facts)
    evidence = line_evidence(facts, table)
    words, nb, np_ = weighed_words(evidence)
    ngrams, prose = fit_ngrams(evidence)
    if beside:
        kept = facts.where("cut is not null").select("cut", "pages")
    else:
        kept = discard(facts)
    if table.count() <= BROADCAST_LINES and words.count() <= BROADCAST_WORDS:
        found = words.toArrow()
        weights = Weights({w: word_weight(b, p, nb, np_) for w, b, p in zip(*(found[c].to_pylist() for c in ("key", "b", "p")))})
        return Fitted(PageModel(weights, _collected(table), ngrams, prose), beside=kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, v = [], []
            for w, x, y in zip(*(c.to_pylist() for c in b.columns)):
                keys.append(hashed(w)), v.append(_bits(word_weight(x, y, nb, np_)))
            yield pa.RecordBatch.from_arrays([pa.array(["word"] * len(v), pa.string()), pa.array(keys, pa.int64()), pa.array(v, pa.int64())], names=["kind", "h", "v"])

    return Fitted(PageModel(ngrams=ngrams, prose=prose), table.unionByName(words.select("key", "b", "p").mapInArrow(run, _TABLE)), kept)


def _collected(table: DataFrame) -> LineTables:
    found = table.toArrow()
    return line_tables(zip(*(found.column(c).to_pylist() for c in ("kind", "h", "v"))))
