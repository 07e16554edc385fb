"""Problem 5: keyword-stuffed and link-list pages.

Every word becomes a class (function word, lower case, capital, number, mark, ...). A 4-gram model of class sequences with
their ends is trained on the paragraphs of all pages; lines whose perplexity per token is abnormally high or low
under it aren't prose, whatever their length: a heap of words without a full stop has an end that no prose has. A page is
reported when most words of its own text (boilerplate lines set aside) stand in such lines, so sentences beside many links,
list entries or tags don't make a case; the page's outgoing links count beside its words, each a little.

Each page is judged by itself in one pass over the text, after one that counts the lines that
pages repeat and the n-grams.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gleaner.llm.pagescan import Fitted, fit_pages, for_page, in_worker, page_rows
from gleaner.llm.pagetext import Line, PageModel, class_string, count_lower_words, own_headings, read_line, surprise

#: Share of abnormal words from which a page is a case; fewest own words that are judged.
SHARE = 0.5
MIN_WORDS = 8
#: Abnormal words that an outgoing link stands for.
LINK_WORDS = 0.25
#: Deviations from prose beyond which a line is abnormal, for a line of 25 tokens; shorter lines get more room.
DEVIATIONS = 5.0


def abnormal(m: PageModel, c: str) -> bool:
    """Whether a line isn't prose, by the perplexity of its class string (without its bullet)."""
    mean, dev = m.prose
    room = DEVIATIONS * dev * max(1.0, (25 / len(c)) ** 0.5)
    return abs(surprise(m, c) - mean) > room


def judged(m: PageModel, x: Line) -> tuple[int, bool]:
    """A line's words and whether it is abnormal; kept with the line."""
    if x.judged is None:
        c = class_string(x.text)
        n = sum(map(c.count, "flCAx"))
        x.judged = n, n > 0 and abnormal(m, c)
    return x.judged


def is_stuffed(m: PageModel, lines: list[Line], headings: list[str] | None, links: int = 0) -> tuple[bool, int, float]:
    """Whether a page is a case, with its own words and the abnormal share of them and its links.

    Lines are judged from the longest down. The page's own prose settles the matter once it outweighs all the page's other
    words, judged or not, and the links: lines set aside later only take words from the other side. Until a line is judged its
    runs of letters stand for its words, which are never more.
    """
    return _stuffed(m, sorted(lines, key=lambda x: len(x.words), reverse=True), sum(len(x.words) for x in lines), headings, links)


def stuffed_page(m: PageModel, lines: list[str], host: str, headings: list[str] | None, links: int = 0) -> bool:
    """Whether a page is a case, as ``is_stuffed`` of its lines, of which only those are read that it takes to settle the matter. The
    runs of letters of the text as it stands are no fewer than those of the lines' texts; a line with markup, whose entities
    may stand for letters, counts by its signs."""
    total = count_lower_words("\n".join(lines)) + sum(len(x) for x in lines if "<" in x)
    return _stuffed(m, (read_line(m, x, host) for x in sorted(lines, key=len, reverse=True)), total, headings, links)[0]


def _stuffed(m: PageModel, lines: Iterable[Line], total: int, headings: list[str] | None, links: int) -> tuple[bool, int, float]:
    """``is_stuffed`` of a page's lines, the longest first, that hold ``total`` runs of letters at most."""
    own = own_headings(headings)
    weight = LINK_WORDS * max(0, links)
    good, words, odd = 0, 0, 0
    for x in lines:
        if not x.words or x.strong or x.text in own:
            continue
        n, wrong = judged(m, x)
        words += n
        if wrong:
            odd += n
        else:
            good += n
            if good >= (1 - SHARE) * (total + weight):
                return False, total, 0.0
    share = (odd + weight) / (words + weight) if words else 0.0
    return words >= MIN_WORDS and odd > 0 and share > SHARE, words, share


def link_count() -> Column:
    """Outgoing links of a page; none where the list is null."""
    return F.coalesce(F.size("outgoing_links"), F.lit(0)).alias("links")


def stuffed_pages(pages: DataFrame, model: Fitted | None = None) -> DataFrame:
    """(doc_id, words, share): pages whose own text is mainly keywords, link texts or tags.

    Null and empty bodies and pages of fewer than ``MIN_WORDS`` own words are never reported. Rows repeated for a page are
    judged alike; the distinct ids are returned. Columns beside those read don't matter.
    """
    m = model or fit_pages(pages)
    shared = pages.sparkSession.sparkContext.broadcast(m.model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = in_worker(shared)
        for b in batches:
            ids, words, shares = [], [], []
            for d, host, headings, lines, known, links in page_rows(b):
                page = for_page(whole, known)
                found, n, share = is_stuffed(page, [read_line(page, x, host) for x in lines], headings, links)
                if found:
                    ids.append(d), words.append(n), shares.append(share)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(shares, pa.float64())], names=["doc_id", "words", "share"])

    found = m.columns(pages, link_count()).mapInArrow(run, "doc_id bigint, words bigint, share double")
    return found.groupBy("doc_id").agg(F.max("words").alias("words"), F.max("share").alias("share"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    return stuffed_pages(spark.read.parquet(f"{sf_dir}/raw_pages.parquet")).select("doc_id")


QUERIES = {"p5_found": p5_found}
ORACLE: dict[str, str] = {}
