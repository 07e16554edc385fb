"""Fetching as a table operator: a pluggable fetcher inside Arrow batches, a replay of stored pages, and robots rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from urllib.robotparser import RobotFileParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from gleaner.functions.html import readable_text
from gleaner.functions.urls import host, url_key

#: What a fetcher returns: (final URL, status, content type, text).
Fetched = tuple[str, int, str, str]
FETCHED = "fetched_url string, status int, content_type string, html string"


def fetch(claimed: DataFrame, fetcher: Callable[[str], Fetched], timeout: float = 8.0, threads: int = 8) -> DataFrame:
    """``claimed`` with what ``fetcher(url)`` gave; a failure or a page later than ``timeout + 1`` seconds has no status."""
    names = claimed.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in claimed.dtypes) + ", " + FETCHED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = ThreadPoolExecutor(threads)
        for b in batches:
            urls = b.column(names.index("url")).to_pylist()
            jobs = [pool.submit(fetcher, u) for u in urls]
            rows = []
            for u, j in zip(urls, jobs):
                try:
                    rows.append(j.result(timeout + 1))
                except (Late, Exception):
                    rows.append((u, None, None, None))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*names, *(f.split()[0] for f in FETCHED.split(", "))])
        pool.shutdown(wait=False, cancel_futures=True)

    return claimed.mapInArrow(run, schema)


def call(rows: DataFrame, prompt: str, output: str, answer: Callable[[str], str], timeout: float = 30.0, threads: int = 4) -> DataFrame:
    """``rows`` with what an outside text service answers to the column ``prompt``; null prompts aren't sent, and every failure
    becomes an error text, so that one bad answer doesn't end a job."""
    names = rows.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", `{output}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = ThreadPoolExecutor(threads)
        for b in batches:
            jobs = [None if p is None else pool.submit(answer, p) for p in b.column(names.index(prompt)).to_pylist()]
            texts = []
            for j in jobs:
                try:
                    texts.append(None if j is None else j.result(timeout))
                except Exception as e:
                    texts.append(f"error: {type(e).__name__}: {e}".rstrip(": "))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*names, output])
        pool.shutdown(wait=False, cancel_futures=True)

    return rows.mapInArrow(run, schema)


def live_text(rows: DataFrame, fetcher: Callable[[str], Fetched], stored: Column, output: str = "live", least: int = 600) -> DataFrame:
    """``rows`` with the text of their ``url`` fetched again where the column ``stored`` is shorter than ``least`` characters; else, and
    where that fails, null."""
    wanted = rows.withColumn("_was", F.col("url")).withColumn("url", F.when((F.length(F.coalesce(stored, F.lit(""))) < least) & (F.col("url") != ""), F.col("url")))
    got = fetch(wanted, lambda u: fetcher(u) if u else (u, None, None, None))
    text = F.when(F.col("status") == 200, _readable(F.col("html")))
    return got.withColumn(output, text).withColumn("url", F.col("_was")).drop("_was", "fetched_url", "status", "content_type", "html")


@F.pandas_udf(StringType())
def _readable(html: pd.Series) -> pd.Series:
    return html.map(lambda x: None if x is None else readable_text(x))


def replay(claimed: DataFrame, web: DataFrame) -> DataFrame:
    """``claimed`` met with stored pages (url, status, content_type, html): a crawl without a network. Unknown URLs are 404."""
    pages = web.groupBy(url_key(F.col("url")).alias("_key")).agg(F.min_by(F.struct("url", "status", "content_type", "html"), "url").alias("_p"))
    out = claimed.withColumn("_key", url_key(F.col("url"))).join(pages, "_key", "left")
    return out.select(*claimed.columns, F.coalesce("_p.url", "url").alias("fetched_url"), F.when(F.col("_p").isNull(), 404).otherwise(F.col("_p.status")).cast("int").alias("status"), F.coalesce("_p.content_type", F.lit("text/html")).alias("content_type"), F.col("_p.html").alias("html"))


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """``urls`` with ``allowed`` by the robots table (host, status, body).

    No row or no status: allowed. 401 and 403: nothing is allowed. Other states from 400 on, and rules that can't be read:
    all is.
    """

    @F.pandas_udf("boolean")
    def allowed(url: pd.Series, status: pd.Series, body: pd.Series) -> pd.Series:
        rules: dict[str, RobotFileParser] = {}

        def one(u: str, s, text: str | None) -> bool:
            if s is None or pd.isna(s) or u is None:
                return True
            if s in (401, 403):
                return False
            if s >= 400 or not text:
                return True
            try:
                if text not in rules:
                    rules[text] = RobotFileParser()
                    rules[text].parse(text.splitlines())
                return rules[text].can_fetch(agent, u)
            except Exception:
                return True

        return pd.Series([one(*x) for x in zip(url, status, body)])

    r = robots.groupBy(F.lower("host").alias("_host")).agg(F.first("status").alias("_status"), F.first("body").alias("_robots"))
    joined = urls.withColumn("_host", host(F.col("url"))).join(r, "_host", "left")
    return joined.withColumn("allowed", allowed("url", "_status", "_robots")).drop("_host", "_status", "_robots")
