"""Whole query files in one job, and the rows and summary that come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.operators.analyze import DEFAULT, Analyzer
from gleaner.operators.bm25 import Bm25, analyse_queries, retrieve
from gleaner.operators.index import Index
from gleaner.operators.rerank import Rerank, rerank
from gleaner.operators.spelling import correct
from gleaner.session import materialize


def search(queries: DataFrame, index: Index, analyzer: Analyzer = DEFAULT, bm25: Bm25 = Bm25(), ranking: Rerank | None = Rerank(), spelling: bool = True) -> DataFrame:
    """Ranked results of all queries; without ``ranking`` in BM25's order. Queries without a hit have no rows."""
    analysed = analyse_queries(queries, analyzer)
    if spelling:
        analysed = materialize(correct(analysed, index.vocabulary), "corrected")  # read by the retrieval and the re-ranking
    found = retrieve(analysed, index, bm25)
    if ranking is None:
        return found.withColumn("score", F.col("bm25_score")).withColumn("rank", F.col("bm25_rank"))
    return rerank(found, analysed, index.docs, ranking, analyzer)


def best_url() -> Column:
    """The first of a result's URLs that isn't empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("url", "fetched_url", "canonical_url")], F.lit(""))


def result_rows(results: DataFrame, top_k: int = 100) -> DataFrame:
    """(query_id, rank, url, score) as text rows; results without any URL are left out but keep their rank."""
    score = F.coalesce(F.col("score"), F.col("bm25_score"), F.lit(0.0))
    return results.where(F.col("rank") <= top_k).select("query_id", "rank", best_url().alias("url"), F.format_string("%.6f", score).alias("score")).where("url != ''")


def batch_summary(queries: DataFrame, rows: DataFrame, seconds: float, **fields) -> dict:
    """The run's figures: queries, rows, seconds in all and by query."""
    n = queries.select("query_id").where("query_id is not null").distinct().count()
    return {"step": "batch_retrieval", **fields, "query_count": n, "total_results": rows.count(), "elapsed_seconds": round(seconds, 4), "average_runtime_seconds": round(seconds / n, 4) if n else 0.0}
