"""Problem 1: lines repeated across one site's documents.

Three passes, none of which holds a site in one place:

1. *Summary.* Every line gets a 128-bit key of its lower-cased letters. A count-min row of ``SLOTS`` cells at most per site
   counts (slot of the key -> lines), with map-side combination; two rows merge by adding them, so partial summaries of any
   split of the input give the same result. A count-min cell never counts too little, so a line that reaches the
   threshold is never lost, whatever the skew; a site so large that its cells fill up only sends more candidates on.
2. *Verification.* Only lines whose cell reached the threshold are counted exactly: distinct documents per
   (site, key), as a two-step aggregation, so that a hot line is pre-aggregated before its final count.
3. *Removal.* The confirmed keys go to the lines as a broadcast set while their number is below a checked bound (bodies
   stay where they are read), beyond it by a shuffled join; both give the same rows.

A page's lines are read from the text once; the narrow ledger of keys is written to the shared folder and passes 1
to 3 read that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.urls import site
from gleaner.session import materialize

#: Distinct documents of one site in which a line must stand; fewest letters of a line that counts.
MIN_DOCS = 5
MIN_LETTERS = 3
#: Cells of a site's count-min row at most (kept sparse, so only cells in use take room).
SLOTS = 1 << 20
#: Confirmed keys up to which they are broadcast (16 bytes of key each, about 32 MB as a hash table).
BROADCAST_KEYS = 200_000


def letters(line: Column) -> Column:
    """The letters of a line that is in lower case."""
    return F.regexp_replace(line, r"[^\p{L}]+", "")


def line_ledger(pages: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(doc_id, line_no, s, k1, k2): site hash and 128-bit letter key of every line that counts.

    Null URLs, URLs without a host, null or empty bodies give no rows. Lines are counted from 1 after splitting at
    ``\\n``, empty lines included. A document delivered twice gives its rows twice; the counts below are distinct.
    """
    return (
        pages.select("doc_id", F.xxhash64(site(F.col("url"))).alias("s"), site(F.col("url")).alias("_site"), F.lower("body").alias("_b"))
        .where("doc_id is not null and _site is not null and _b != ''")
        .select("doc_id", "s", F.posexplode(F.split("_b", "\n", -1)).alias("i", "line"))
        .select("doc_id", "s", (F.col("i") + 1).alias("line_no"), letters(F.col("line")).alias("k"))
        .where(F.length("k") >= min_letters)
        .select("doc_id", "line_no", "s", F.xxhash64("k").alias("k1"), F.xxhash64("k", F.lit(7)).alias("k2"))
    )


def site_summaries(ledger: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(s, slot, n): the sites' count-min rows. Summaries of parts merge by a union and the same sum."""
    return ledger.groupBy("s", F.pmod("k1", F.lit(slots)).cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def merge_summaries(*parts: DataFrame) -> DataFrame:
    """One summary of several parts of the data."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("s", "slot").agg(F.sum("n").alias("n"))


def confirmed_lines(ledger: DataFrame, min_docs: int = MIN_DOCS, slots: int = SLOTS) -> DataFrame:
    """(s, k1, k2, docs): keys found in at least ``min_docs`` distinct documents of a site, counted exactly."""
    slot = F.pmod("k1", F.lit(slots)).cast("int")
    heavy = site_summaries(ledger, slots).where(F.col("n") >= min_docs).select("s", "slot")
    return (
        ledger.withColumn("slot", slot)
        .join(heavy, ["s", "slot"], "left_semi")
        .select("s", "k1", "k2", "doc_id").distinct()
        .groupBy("s", "k1", "k2").agg(F.count(F.lit(1)).alias("docs"))
        .where(F.col("docs") >= min_docs)
    )


def repeated_lines(pages: DataFrame, min_docs: int = MIN_DOCS, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(doc_id, line_no): distinct lines that repeat across their site. Empty input gives no rows."""
    ledger = materialize(line_ledger(pages, min_letters), "lines")
    confirmed = materialize(confirmed_lines(ledger, min_docs).select("s", "k1", "k2"), "confirmed")
    if confirmed.count() <= BROADCAST_KEYS:
        confirmed = F.broadcast(confirmed)
    return ledger.join(confirmed, ["s", "k1", "k2"], "left_semi").select("doc_id", "line_no").distinct()


def _broadcast_hits(pages: DataFrame, confirmed: DataFrame, min_letters: int) -> DataFrame:
    """``pages`` with ``_cut``, whether each line is confirmed, by a sorted broadcast array of the keys (two 64-bit hashes)."""
    keys = confirmed.select(F.xxhash64("s", "k1").alias("h"), "k2").orderBy("h", "k2").toArrow()
    shared = pages.sparkSession.sparkContext.broadcast((keys.column("h").to_numpy(), keys.column("k2").to_numpy()))

    @F.arrow_udf("array<boolean>")
    def found(h: pa.Array, k2: pa.Array) -> pa.Array:
        have, second = shared.value
        own, other = h.values.fill_null(0).to_numpy(zero_copy_only=False), k2.values.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(have, own), max(0, len(have) - 1))
        hit = (have[at] == own) & (second[at] == other) if len(have) else np.zeros(len(own), bool)
        return pa.ListArray.from_arrays(h.offsets, pa.array(hit & h.values.is_valid().to_numpy(zero_copy_only=False)))

    s = F.xxhash64(site(F.col("url")))
    counts = lambda k, x: F.when(F.length(k) >= min_letters, x)
    lines = F.transform(F.split(F.lower("body"), "\n", -1), letters)
    of = lambda x: F.coalesce(F.transform("_lines", x), F.array().cast("array<bigint>"))
    known = F.col("doc_id").isNotNull() & site(F.col("url")).isNotNull()
    return (
        pages.withColumn("_lines", F.when(known, lines))
        .withColumn("_cut", found(of(lambda k: counts(k, F.xxhash64(s, F.xxhash64(k)))), of(lambda k: counts(k, F.xxhash64(k, F.lit(7))))))
        .withColumn("_cut", F.when(F.exists("_cut", lambda x: x), F.col("_cut")))
        .drop("_lines")
    )


def _joined_hits(pages: DataFrame, ledger: DataFrame, confirmed: DataFrame) -> DataFrame:
    """``pages`` with ``_cut`` by shuffled joins; rows without an id, which have no hits, stay out of them."""
    hit = ledger.join(confirmed, ["s", "k1", "k2"], "left_semi").groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "k1")).alias("_hit"))
    cut = F.transform(F.split(F.lower("body"), "\n", -1), lambda x, i: F.array_contains("_hit", F.struct((i + 1).alias("line_no"), F.xxhash64(letters(x)).alias("k1"))))
    known = pages.where("doc_id is not null").join(hit, "doc_id", "left").withColumn("_cut", F.when(F.col("_hit").isNotNull() & site(F.col("url")).isNotNull(), cut)).drop("_hit")
    return known.unionByName(pages.where("doc_id is null").withColumn("_cut", F.lit(None).cast("array<boolean>")))


def remove_repeated_lines(pages: DataFrame, min_docs: int = MIN_DOCS, min_letters: int = MIN_LETTERS) -> DataFrame:
    """``pages`` with ``clean_body`` and ``removed_lines``; every other column and every row stays.

    Null bodies stay null, pages without an id or a site keep their body. Rows of one ``doc_id`` that differ are each cleaned by
    their own lines' keys.
    """
    ledger = materialize(line_ledger(pages, min_letters), "lines")
    confirmed = materialize(confirmed_lines(ledger, min_docs).select("s", "k1", "k2"), "confirmed")
    marked = _broadcast_hits(pages, confirmed, min_letters) if confirmed.count() <= BROADCAST_KEYS else _joined_hits(pages, ledger, confirmed)
    kept = F.filter(F.split("body", "\n", -1), lambda x, i: ~F.element_at("_cut", i + 1))
    return (
        marked.withColumn("clean_body", F.when(F.col("_cut").isNull(), F.col("body")).otherwise(F.array_join(kept, "\n")))
        .withColumn("removed_lines", F.when(F.col("_cut").isNull(), 0).otherwise(F.size(F.filter("_cut", lambda x: x))))
        .drop("_cut")
    )


def p1_found(spark, sf_dir: str) -> DataFrame:
    return repeated_lines(spark.read.parquet(f"{sf_dir}/raw_pages.parquet"))


def p1_clean(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_lines(spark.read.parquet(f"{sf_dir}/raw_pages.parquet"))
    return out.select("doc_id", "url", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ingested_at"), F.col("removed_lines").cast("bigint"), "clean_body")


QUERIES = {"p1_found": p1_found, "p1_clean": p1_clean}

_LINES = r"""
with pages as (
  select distinct doc_id, body,
    array_to_string(string_split(regexp_replace(regexp_extract(lower(trim(url)), '^[^:/?#]+://([^/?#]*)', 1), '^.*@|:[0-9]*$', '', 'g'), '.')[-2:], '.') as site
  from raw_pages where doc_id is not null and url is not null and body <> ''),
lines as (
  select doc_id, site, unnest(string_split(lower(body), chr(10))) as line, unnest(range(1, len(string_split(body, chr(10))) + 1)) as line_no
  from pages where site <> ''),
keyed as (
  select doc_id, site, line_no, regexp_replace(line, '[^\p{L}]+', '', 'g') as k from lines),
counted as (
  select site, k from keyed where length(k) >= 3 group by site, k having count(distinct doc_id) >= 5)
"""

_CLEANED = r""",
own as (select *, row_number() over () as rid,
    array_to_string(string_split(regexp_replace(regexp_extract(lower(trim(url)), '^[^:/?#]+://([^/?#]*)', 1), '^.*@|:[0-9]*$', '', 'g'), '.')[-2:], '.') as site from raw_pages),
split as (select rid, site, unnest(string_split(body, chr(10))) as line, unnest(range(1, len(string_split(body, chr(10))) + 1)) as line_no from own where doc_id is not null and url is not null and site <> '' and body <> ''),
marked as (select rid, line, line_no, c.k is not null as hit from split left join counted c on split.site = c.site and regexp_replace(lower(line), '[^\p{L}]+', '', 'g') = c.k),
cleaned as (select rid, count(*) filter (hit) as removed, coalesce(string_agg(line, chr(10) order by line_no) filter (not hit), '') as body from marked group by rid)
select doc_id, url, strftime(ingested_at at time zone 'UTC', '%Y-%m-%d %H:%M:%S.%f') as ingested_at, coalesce(removed, 0) as removed_lines, case when removed > 0 then c.body else own.body end as clean_body from own left join cleaned c using (rid)"""

ORACLE = {
    "p1_found": _LINES + "select distinct doc_id, cast(line_no as int) as line_no from keyed join counted using (site, k)",
    "p1_clean": _LINES + _CLEANED,
}
