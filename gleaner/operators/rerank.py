"""Re-ranking of the candidates by title and heading matches beside BM25."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gleaner.operators.analyze import DEFAULT, Analyzer


@dataclass(frozen=True)
class Rerank:
    title_weight: float = 2.0
    heading_weight: float = 1.0
    bm25_importance: float = 0.7
    field_importance: float = 0.3


def field_boost(query: Column, field: Column, weight: float) -> Column:
    """Weight times the field's terms that the query holds, each occurrence counted; 0 where either is empty."""
    return F.coalesce(F.size(F.filter(field, lambda t: F.array_contains(query, t))), F.lit(0)).cast("double") * weight


def min_max(value: Column, low: Column, high: Column) -> Column:
    """(v - low) / (high - low); where all are equal 1 for a value above 0, else 0."""
    return F.when(high == low, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((value - low) / (high - low))


def rerank(candidates: DataFrame, analysed: DataFrame, docs: DataFrame, p: Rerank = Rerank(), analyzer: Analyzer = DEFAULT) -> DataFrame:
    """Candidates with ``score``, ``rank`` and ``score_details``.

    BM25 is scaled within the candidates of a query, the field part by its weights. Documents without title terms are
    analysed by their title. Order: rounded score, then BM25's rank.
    """
    fields = docs.select("doc_id", "title_tokens", "heading_tokens")
    joined = candidates.join(fields, "doc_id", "left").join(analysed.select("query_id", "query_tokens"), "query_id")
    title = F.when(F.coalesce(F.size("title_tokens"), F.lit(0)) > 0, F.col("title_tokens")).otherwise(analyzer(F.col("title")))
    raw = field_boost(F.col("query_tokens"), title, p.title_weight) + field_boost(F.col("query_tokens"), F.col("heading_tokens"), p.heading_weight)
    w = W.partitionBy("query_id")
    most = p.title_weight + p.heading_weight
    scored = joined.withColumn("_field", F.least(F.lit(1.0), raw / most) if most > 0 else F.lit(0.0)).withColumn("_bm25", min_max(F.col("bm25_score"), F.min("bm25_score").over(w), F.max("bm25_score").over(w)))
    scored = scored.withColumn("score", F.round(p.bm25_importance * F.col("_bm25") + p.field_importance * F.col("_field"), 4))
    rounded = [F.round(c, 4).alias(n) for c, n in (("_bm25", "normalized_bm25"), ("_bm25", "bm25_component"), ("_field", "normalized_field_boost"), ("_field", "field_component"))]
    ranked = scored.withColumn("rank", F.row_number().over(w.orderBy(F.col("score").desc(), F.col("bm25_rank")))).withColumn("score_details", F.struct(*rounded))
    return ranked.drop("_field", "_bm25", "title_tokens", "heading_tokens", "query_tokens")
