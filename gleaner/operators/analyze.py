"""From raw pages to analysed documents: one narrow map, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions import text as T
from gleaner.functions.porter import stem_tokens
from gleaner.operators.dedup import one_per_key


@dataclass(frozen=True)
class Analyzer:
    """How texts become terms. ``exact_accents`` sends texts with unusual signs through Unicode's decomposition."""

    stopwords: tuple[str, ...] = T.STOPWORDS
    foldings: tuple[tuple[str, str], ...] = T.TOWN_FOLDINGS
    stemming: bool = True
    exact_accents: bool = True

    def __call__(self, text: Column) -> Column:
        plain = T.tokens(text, self.stopwords, self.foldings, self.exact_accents)
        return stem_tokens(plain) if self.stemming else plain

    def list(self, values: Column) -> Column:
        return self(F.array_join(F.coalesce(values, F.array().cast("array<string>")), " "))


#: Terms as SQL can make them too: unstemmed, accents of Latin letters only.
PLAIN = Analyzer(stemming=False, exact_accents=False)
DEFAULT = Analyzer()


def latest_pages(pages: DataFrame, by: str = "ingested_at") -> DataFrame:
    """One row a document: of rows delivered again the latest, of equal times the one with the greatest body, title, URL, ..."""
    time = [F.col(by)] if by in pages.columns else []
    texts = [F.coalesce(F.col(c), F.lit("")) for c in ("body", "title", "url", "canonical_url", "fetched_url", "language") if c in pages.columns]
    lists = [F.col(c) for c in ("headings", "outgoing_links") if c in pages.columns]
    return one_per_key(pages, "doc_id", F.struct(*time, *texts, *lists))


def preprocess(pages: DataFrame, analyzer: Analyzer = DEFAULT, preview: int = 80) -> DataFrame:
    """Documents with terms of title, headings and body; null texts give empty lists, null strings become empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    out = pages.select(
        "doc_id", text("url"), text("fetched_url") if "fetched_url" in pages.columns else F.lit("").alias("fetched_url"), text("canonical_url"), text("title"),
        analyzer(F.col("title")).alias("title_tokens"), analyzer.list(F.col("headings")).alias("heading_tokens"), analyzer(F.col("body")).alias("body_tokens"),
        F.coalesce("outgoing_links", F.array().cast("array<string>")).alias("outgoing_links"), text("crawl_time"), T.snippet(F.col("body")).alias("snippet"),
    )
    out = out.withColumn("body_tokens_preview", F.slice("body_tokens", 1, preview)).withColumn("body_length", F.size("body_tokens"))
    order = "doc_id url fetched_url canonical_url title title_tokens heading_tokens body_tokens body_tokens_preview body_length outgoing_links crawl_time snippet"
    return out.select(*order.split())


def totals(documents: DataFrame) -> DataFrame:
    """(num_pages, total_body_tokens)."""
    return documents.agg(F.count(F.lit(1)).alias("num_pages"), F.coalesce(F.sum("body_length"), F.lit(0)).alias("total_body_tokens"))
