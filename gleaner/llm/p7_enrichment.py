"""Problem 7: how distinctive a term is for a record, as hypergeometric enrichment.

Of the collection's N token places, K hold the term; a record draws n places without replacement and k of them hold
the term. The score is -ln P(X >= k), the exact upper tail summed from log-gamma terms, and is adjusted for the number
of terms tested in the record (Benjamini-Hochberg). Common terms have a large K and need a large k; a term that stands
once scores no more than ln(N / (n K)).

The collection's counts are fresh sums over the deduplicated pages. ``document_frequencies`` was built before the late
pages came in and counts documents, not places, so it can't serve as K; its sum over the shards is reported beside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from gleaner.operators.index import count_terms
from gleaner.session import materialize

# Stirling's series: B(2j) / (2j (2j - 1)), j = 1..6.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln gamma(x) for x > 0, to about 1e-13 relative: shifted up to 10, then Stirling's series."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(10):
        low = y < 10
        if not low.any():
            break
        shift[low] += np.log(y[low])
        y[low] += 1
    z, tail = 1 / (y * y), np.zeros_like(y)
    for c in reversed(_STIRLING):
        tail = tail * z + c
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + tail / y - shift


def _choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def neg_log_tail(k: np.ndarray, n: np.ndarray, big_k: np.ndarray, big_n: np.ndarray) -> np.ndarray:
    """-ln P(X >= k), X ~ Hypergeometric(N, K, n), elementwise.

    The terms from k upward are added until what is left can't change the sum; where k lies below the mean, the lower
    tail is summed instead and taken from 1. Places outside the support (k > min(n, K)) give infinity.
    """
    k, n, big_k, big_n = (np.asarray(x, dtype=np.float64) for x in (k, n, big_k, big_n))
    out = np.zeros(k.shape)
    live = k > np.maximum(0, n + big_k - big_n)
    lower = live & (k <= n * big_k / np.maximum(big_n, 1))
    impossible = k > np.minimum(n, big_k)
    out[impossible] = np.inf

    def ladder(i, sel, step):
        a, b, m = n[sel], big_k[sel], big_n[sel]
        first = _choose(b, i) + _choose(m - b, a - i) - _choose(m, a)
        term, total, at = np.ones_like(i), np.ones_like(i), i.copy()
        act = np.arange(len(i))
        while len(act):
            x, y, z, t = a[act], b[act], m[act], at[act]
            r = (y - t) * (x - t) / ((t + 1) * (z - y - x + t + 1)) if step > 0 else t * (z - y - x + t) / ((y - t + 1) * (x - t + 1))
            term[act] *= np.maximum(r, 0)
            total[act] += term[act]
            at[act] += step
            act = act[term[act] > total[act] * 1e-17]
        return first + np.log(total)

    up = live & ~lower & ~impossible
    if up.any():
        out[up] = -ladder(k[up], np.flatnonzero(up), 1)
    if lower.any():
        below = np.minimum(ladder(k[lower] - 1, np.flatnonzero(lower), -1), -1e-300)
        out[lower] = -np.log(np.maximum(-np.expm1(below), 1e-300))
    return np.maximum(out, 0)


#: Pages delivered more than once up to which their ids are broadcast (8 bytes each).
BROADCAST_IDS = 500_000
#: Frequent terms that are broadcast with their counts (a few dozen bytes each).
BROADCAST_TERMS = 50_000


def one_per_page(pages: DataFrame) -> DataFrame:
    """(doc_id, body_tokens): one row a page; null and empty token lists are left out.

    Only pages that were delivered more than once are shuffled with their tokens; of rows that differ, the one with most
    tokens is taken, then the greatest list.
    """
    rows = pages.select("doc_id", "body_tokens").where("doc_id is not null and size(body_tokens) > 0")
    many = materialize(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id"), "again")
    if many.count() <= BROADCAST_IDS:
        many = F.broadcast(many)
    again = rows.join(many, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct(F.size("body_tokens").alias("n"), "body_tokens"))["body_tokens"].alias("body_tokens"))
    return rows.join(many, "doc_id", "left_anti").unionByName(again)


def enrichment(pages: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, k, n, collection_k, score): every term of the asked pages, scored.

    ``probes`` (doc_id) names the pages asked about, all of them if None; the counts always cover the whole collection.
    Null tokens don't count. Unknown probes and empty tables give no rows.
    """
    base = one_per_page(pages)
    token = base.select(F.explode("body_tokens").alias("term")).where("term is not null")
    totals = materialize(token.groupBy("term").agg(F.count(F.lit(1)).alias("collection_k")), "terms")
    big_n = totals.agg(F.coalesce(F.sum("collection_k"), F.lit(0))).first()[0]
    asked = base if probes is None else base.join(probes.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
    own = asked.select("doc_id", F.size(F.filter("body_tokens", lambda t: t.isNotNull())).alias("n"), "body_tokens")
    counted = count_terms(own, "body_tokens", "k").withColumn("k", F.col("k").cast("bigint"))

    # Terms with at least N / BROADCAST_TERMS places are at most BROADCAST_TERMS, as all places together are N: the frequent
    # terms, which hold most rows and would crowd a shuffle's partitions, are broadcast; only the rest is shuffled.
    hot = totals.where(F.col("collection_k") >= big_n / BROADCAST_TERMS)
    first = materialize(counted.join(F.broadcast(hot), "term", "left"), "counted")
    rare = first.where("collection_k is null").drop("collection_k").join(totals, "term")

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(score=neg_log_tail(b.k, b.n, b.collection_k, np.full(len(b), big_n)))

    order = ["doc_id", "term", "k", "n", "collection_k"]
    rows = first.where("collection_k is not null").select(*order).unionByName(rare.select(*order))
    return rows.mapInPandas(scored, "doc_id bigint, term string, k bigint, n int, collection_k bigint, score double")


def adjusted(scored: DataFrame) -> DataFrame:
    """``scored`` with ``adjusted``: -ln of the Benjamini-Hochberg value among the terms of the page."""
    w = W.partitionBy("doc_id")
    best = F.col("score") - F.log(F.count(F.lit(1)).over(w)) + F.log(F.rank().over(w.orderBy(F.col("score").desc())))
    running = w.orderBy(F.col("score").asc(), F.col("term").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return scored.withColumn("_b", F.greatest(F.lit(0.0), best)).withColumn("adjusted", F.max("_b").over(running)).drop("_b")


def top_terms(pages: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """(doc_id, term): the most distinctive term of each asked page; ties go to the rarer, then the first term."""
    scored = enrichment(pages, probes)
    best = F.min_by("term", F.struct(-F.col("score"), "collection_k", "term"))
    return scored.groupBy("doc_id").agg(best.alias("term"))


def p7_found(spark, sf_dir: str) -> DataFrame:
    return top_terms(spark.read.parquet(f"{sf_dir}/preprocessed_pages.parquet"), spark.read.parquet(f"{sf_dir}/probe_pages.parquet"))


def p7_enrichment(spark, sf_dir: str) -> DataFrame:
    """Scores of all terms of the probe pages, with the collection's stored document frequency beside."""
    scored = adjusted(enrichment(spark.read.parquet(f"{sf_dir}/preprocessed_pages.parquet"), spark.read.parquet(f"{sf_dir}/probe_pages.parquet")))
    df = spark.read.parquet(f"{sf_dir}/document_frequencies.parquet").groupBy("term").agg(F.sum("df").alias("stored_df"))
    return scored.join(df, "term", "left").select("doc_id", "term", "k", F.col("n").cast("bigint").alias("n"), "collection_k", "stored_df", F.round("score", 6).alias("score"), F.round("adjusted", 6).alias("adjusted"))


QUERIES = {"p7_found": p7_found, "p7_enrichment": p7_enrichment}

_SCORED = """
with one as (
  select doc_id, body_tokens from (select doc_id, body_tokens, row_number() over (partition by doc_id order by len(body_tokens) desc, body_tokens desc) as r
    from preprocessed_pages where doc_id is not null and len(body_tokens) > 0) where r = 1),
tokens as (select doc_id, unnest(body_tokens) as term from one),
clean as (select * from tokens where term is not null),
totals as (select term, count(*) as big_k from clean group by term),
whole as (select count(*) as big_n from clean),
counted as (select doc_id, term, count(*) as k from clean where doc_id in (select doc_id from probe_pages) group by all),
sized as (select doc_id, sum(k)::bigint as n from counted group by doc_id),
given as (select * from counted join sized using (doc_id) join totals using (term), whole),
steps as (select *, unnest(range(k, least(n, big_k) + 1)) as i from given),
tails as (
  select doc_id, term, k, n, big_k, sum(exp(lgamma(big_k + 1) - lgamma(i + 1) - lgamma(big_k - i + 1) + lgamma(big_n - big_k + 1) - lgamma(n - i + 1)
    - lgamma(big_n - big_k - n + i + 1) - lgamma(big_n + 1) + lgamma(n + 1) + lgamma(big_n - n + 1))) as tail
  from steps where big_n - big_k - n + i >= 0 group by all),
scored as (select *, greatest(0.0, -ln(tail)) as score from tails)
"""
ORACLE = {
    "p7_found": _SCORED + "select doc_id, arg_min(term, (-round(score, 6), big_k, term)) as term from scored group by doc_id",
}
