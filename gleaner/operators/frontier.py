"""The crawl as batch rounds over tables: claim, fetch, extract, route, save.

State is three tables: the frontier (level, domain, seq, url, attempts), the clock (domain, next_time) and the visited
URLs. A round claims at most one URL a domain whose time has come, so politeness is a window over the domain and not
a lock; all of a round's pages are fetched at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gleaner.functions.html import extract_pages
from gleaner.functions.lang import NgramLanguages, detect_by_ngrams, detect_language, looks_english
from gleaner.functions.text import is_on_topic
from gleaner.functions.urls import is_blacklisted, is_page_url, normalize_url, registrable_domain, url_key
from gleaner.session import materialize

# HTTP states that are worth another try, and how many more tries a URL gets.
TRANSIENT = (429, 500, 502, 503, 504)
MAX_RETRIES = 3


@dataclass(frozen=True)
class Crawl:
    max_pages: int = 20
    polite_delay: float = 0.6
    blacklist: tuple[str, ...] = ("archive.org",)
    agent: str = "gleaner"


def seed_frontier(seeds: DataFrame) -> DataFrame:
    """(level, domain, seq, url, attempts) of (url): normalised seeds in their order, each once."""
    rows = seeds.where("url != ''").select(normalize_url(F.col("url")).alias("url"), F.monotonically_increasing_id().alias("seq"))
    first = rows.groupBy("url").agg(F.min("seq").alias("seq"))
    return first.select(F.lit("high").alias("level"), registrable_domain(F.col("url")).alias("domain"), "seq", "url", F.lit(0).alias("attempts"))


def insertable(urls: DataFrame, conf: Crawl = Crawl()) -> DataFrame:
    """Rows whose ``url`` may enter the frontier: a page's URL with a host, not below a blacklisted domain."""
    d = registrable_domain(F.col("url"))
    return urls.where((d != "") & is_page_url(F.col("url")) & ~is_blacklisted(d, conf.blacklist))


def claim(frontier: DataFrame, clock: DataFrame, now: float) -> DataFrame:
    """One URL for each domain whose next time has come; the high level goes before the low one, then arrival."""
    ready = frontier.join(clock, "domain", "left").where(F.coalesce("next_time", F.lit(0.0)) <= now).drop("next_time")
    level = F.when(F.col("level") == "high", 0).otherwise(1)
    return ready.withColumn("_r", F.row_number().over(W.partitionBy("domain").orderBy(level, "seq", "url"))).where("_r = 1").drop("_r")


def advance(clock: DataFrame, claimed: DataFrame, now: float, delay: float) -> DataFrame:
    """The clock after a claim: the claimed domains wait until ``now + delay``, the others as before."""
    took = claimed.select("domain").distinct().withColumn("next_time", F.lit(now + delay))
    return clock.join(took, "domain", "left_anti").unionByName(took)


def outcome(status: Column, content_type: Column, allowed: Column, attempts: Column, related: Column, english: Column, known: Column) -> Column:
    """What becomes of a fetched page; the first that holds. A missing status is a transport error."""
    retry = F.when(attempts < MAX_RETRIES, F.lit("retry")).otherwise(F.lit("given_up"))
    return (
        F.when(~allowed, F.lit("robots_blocked"))
        .when(status.isNull() | status.isin(*TRANSIENT), retry)
        .when((status != 200) | ~F.lower(F.coalesce(content_type, F.lit(""))).contains("text/html"), F.lit("not_html"))
        .when(~related, F.lit("not_related"))
        .when(~english, F.lit("not_english"))
        .when(known, F.lit("duplicate"))
        .otherwise(F.lit("saved"))
    )


def route(links: DataFrame, seen: DataFrame, conf: Crawl = Crawl()) -> DataFrame:
    """(level, domain, url): new links (url, promote), each once, high if any page promotes it; URLs already seen (waiting,
    fetched or visited) are left out."""
    fresh = insertable(links, conf).groupBy("url").agg(F.max("promote").alias("promote")).join(seen.select("url").distinct(), "url", "left_anti")
    return fresh.select(F.when(F.col("promote"), "high").otherwise("low").alias("level"), registrable_domain(F.col("url")).alias("domain"), "url")


def number_new(rows: DataFrame, last: int, column: str, order: list[str]) -> DataFrame:
    """``rows`` numbered from ``last + 1`` on in ``order``, by range-sorted partitions and their offsets, not by one task."""
    # written once, so that the counts and the rows come from one and the same split
    spread = materialize(rows.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "numbered")
    counts = spread.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_p", "_first", before.alias("_before"))
    return spread.join(F.broadcast(offsets), "_p").withColumn(column, F.col("_before") + F.col("_i") - F.col("_first") + last + 1).drop("_p", "_i", "_first", "_before")


def again(key: str, good: Column, url: str) -> Column:
    """Whether another good page with the same key comes before a row in the order of URLs; such a page is a duplicate."""
    return F.row_number().over(W.partitionBy(key, good).orderBy(url)) > 1


def process(fetched: DataFrame, saved_keys: DataFrame, conf: Crawl = Crawl(), languages: NgramLanguages | None = None) -> DataFrame:
    """Fetched rows (url, attempts, fetched_url, status, content_type, html, allowed) with the extracted fields, language,
    topic and ``outcome``; of pages with one canonical key in a round the first URL is saved. ``languages`` is a fitted model of
    languages; without it closed-class words decide."""
    pages = extract_pages(fetched)
    by_words = detect_language(F.col("body"), F.col("html_lang"))
    pages = pages.withColumn("language", F.coalesce(detect_by_ngrams(F.col("body"), languages)["lang"], by_words) if languages else by_words)
    pages = pages.withColumn("is_related", is_on_topic(F.col("canonical_url"), F.col("title"), F.col("body"))).withColumn("is_english", looks_english(F.col("canonical_url"), F.col("language")))
    pages = pages.withColumn("key", url_key(F.col("canonical_url")))
    known = saved_keys.select("key").distinct().withColumn("_known", F.lit(True))
    pages = pages.join(known, "key", "left")
    good = F.col("allowed") & (F.col("status") == 200) & F.col("is_related") & F.col("is_english")
    first = again("key", F.coalesce(good, F.lit(False)), "url")
    result = outcome(F.col("status"), F.col("content_type"), F.col("allowed"), F.col("attempts"), F.col("is_related"), F.col("is_english"), F.coalesce("_known", F.lit(False)) | first)
    return pages.withColumn("outcome", result).drop("_known")


def frontier_sizes(frontier: DataFrame, clock: DataFrame, now: float) -> DataFrame:
    """(level, urls, domains, ready_domains)."""
    ready = F.coalesce("next_time", F.lit(0.0)) <= now
    return frontier.join(clock, "domain", "left").groupBy("level").agg(F.count(F.lit(1)).alias("urls"), F.countDistinct("domain").alias("domains"), F.countDistinct(F.when(ready, F.col("domain"))).alias("ready_domains"))
