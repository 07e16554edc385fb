"""Problem 6: one ranking from several differently-scaled scores, by Borda count.

Each score gives a page the number of pages of its query that it beats, plus half the number it ties with (the
competition rank with averaged ties, counted from the bottom), divided by the number of other pages. Weighted points
are summed; the identifier breaks ties. Only the order of values within a query counts, so units, outliers and
monotone rescalings have no effect, and a score that is constant within a query gives everyone the same points.

The named method gives a missing score the middle rank (``missing="middle"``: half of the points, and it doesn't count among
the others); the task's own statement says a null is no better than the query's lowest, so by default nulls share the last
place.

One exchange brings a query's rows together, and windows over its five orders rank them there. Queries of more than
``BIG_QUERY`` rows, which are counted first, take another way that no task ever holds one of them in: equal values are counted,
the values are split into order-preserving buckets, a window over the (bounded) bucket totals gives each bucket its offset, and
a second window ranks values within a bucket. Both ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gleaner.session import materialize

SCORES = {
    "bm25_score": "bm25_score",
    "field_boost": "score_details.field_boost",
    "prf": "score_details.prf",
    "link": "score_details.link",
    "lsa": "score_details.lsa",
}
#: Rows of a query up to which one task ranks it.
BIG_QUERY = 200_000
#: Buckets per doubling of a value; together at most about 2 * 32 * 1100 buckets in a query.
STEPS = 32


def bucket(v: Column) -> Column:
    """An order-preserving coarse key of a double; null stays null."""
    return (F.signum(v) * F.floor(STEPS * F.log2(1.0 + F.abs(v) * float(2**30)))).cast("bigint")


def _offsets(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, b, below, total) of (keys, b, c): rows in lower buckets and in all."""
    per = counts.groupBy(*keys, "b").agg(F.sum("c").alias("c"))
    w = W.partitionBy(*keys)
    before = F.coalesce(F.sum("c").over(w.orderBy(F.col("b").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return per.select(*keys, "b", before.alias("below"), F.sum("c").over(w).alias("total"))


def points(scores: DataFrame, keys: list[str], missing: str = "last") -> DataFrame:
    """(keys, v, p) for each distinct value ``v`` of the columns ``keys`` + ``v``: Borda points in 0..1.

    Nulls and NaN count as lowest and share the last place, or get 0.5 where ``missing`` is "middle". A group of one row gets 0.5.
    """
    if missing == "middle":
        null = scores.where("v is null").groupBy(*keys, "v").agg(F.lit(0.5).alias("p"))
        return points(scores.where("v is not null"), keys).unionByName(null)
    counts = scores.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c")).withColumn("b", bucket(F.col("v")))
    o, c = _offsets(counts, keys).alias("o"), counts.alias("c")
    cond = [F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "b"]]
    inside = F.coalesce(F.sum("c").over(W.partitionBy(*keys, "b").orderBy(F.col("v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    joined = c.join(o, cond).select(*[F.col(f"c.{k}").alias(k) for k in keys], F.col("c.v").alias("v"), F.col("c.b").alias("b"), F.col("c.c").alias("c"), "below", "total")
    beaten = F.col("below") + inside + (F.col("c") - 1) / 2.0
    return joined.select(*keys, "v", F.when(F.col("total") > 1, beaten / (F.col("total") - 1)).otherwise(F.lit(0.5)).alias("p"))


def position(ranked: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """``ranked`` with ``rank`` 1..n per ``group`` by falling ``value``, then rising ``tie``, by the same two steps."""
    df = ranked.withColumn("b", F.floor(-F.col(value) * 4096).cast("bigint"))
    o = _offsets(df.groupBy(group, "b").agg(F.count(F.lit(1)).alias("c")), [group]).withColumnRenamed(group, "_g").withColumnRenamed("b", "_b")
    w = W.partitionBy(group, "b").orderBy(F.col(value).desc(), F.col(tie).asc_nulls_last())
    return df.join(o, F.col(group).eqNullSafe(F.col("_g")) & (F.col("b") == F.col("_b"))).withColumn("rank", (F.col("below") + F.row_number().over(w)).cast("int")).drop("b", "_b", "_g", "below", "total")


def _items(results: DataFrame, scores: dict[str, str], group: str, item: str) -> DataFrame:
    """(g, d, v_...): one row for each page of each query, with its largest value of each score."""
    one = results.select(F.col(group).alias("g"), F.col(item).alias("d"), *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"v_{n}") for n, c in scores.items()])
    return one.where("g is not null and d is not null")


def _largest(rows: DataFrame, scores: dict[str, str]) -> DataFrame:
    return rows.groupBy("g", "d").agg(*[F.max(f"v_{n}").alias(f"v_{n}") for n in scores])


def _in_place(rows: DataFrame, scores: dict[str, str], weights: dict[str, float], missing: str) -> DataFrame:
    """(g, d, borda, rank) of queries that a task may hold: one exchange, then windows over what it brought together."""
    items = _largest(rows.repartition("g"), scores)
    parts = []
    for n in scores:
        v = F.col(f"v_{n}")
        w = W.partitionBy("g").orderBy(v.asc_nulls_first())
        items = items.withColumn(f"lo_{n}", F.rank().over(w) - 1).withColumn(f"up_{n}", F.round(F.cume_dist().over(w) * F.count(F.lit(1)).over(W.partitionBy("g"))).cast("bigint"))
        nulls = F.count(F.when(v.isNull(), 1)).over(W.partitionBy("g")) if missing == "middle" else F.lit(0)
        total = F.count(F.lit(1)).over(W.partitionBy("g")) - nulls
        beaten = F.col(f"lo_{n}") - nulls + (F.col(f"up_{n}") - F.col(f"lo_{n}") - 1) / 2.0
        p = F.when(total > 1, beaten / (total - 1)).otherwise(F.lit(0.5))
        parts.append(F.round(F.when(v.isNull(), 0.5).otherwise(p) if missing == "middle" else p, 9) * float(weights.get(n, 1.0)))
    total = float(sum(weights.get(n, 1.0) for n in scores))
    scored = items.select("g", "d", F.round(sum(parts[1:], parts[0]) / total, 6).alias("borda"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(F.col("borda").desc(), F.col("d").asc())))


def _spread(rows: DataFrame, scores: dict[str, str], weights: dict[str, float], missing: str) -> DataFrame:
    """(g, d, borda, rank) of queries of any size, by counts of buckets."""
    entries = F.array(*[F.struct(F.lit(n).alias("m"), F.col(f"v_{n}").alias("v")) for n in scores])
    long = _largest(rows, scores).select("g", "d", F.inline(entries))
    weight = F.create_map(*[F.lit(x) for n in scores for x in (n, float(weights.get(n, 1.0)))])
    pts = points(long, ["g", "m"], missing).select(F.col("g").alias("pg"), F.col("m").alias("pm"), F.col("v").alias("pv"), (F.round("p", 9) * weight[F.col("m")]).alias("p"))
    total = float(sum(weights.get(n, 1.0) for n in scores))
    scored = long.join(pts, (F.col("g") == F.col("pg")) & (F.col("m") == F.col("pm")) & F.col("v").eqNullSafe(F.col("pv"))).groupBy("g", "d").agg(F.round(F.sum("p") / total, 6).alias("borda"))
    return position(scored, "g", "borda", "d").select("g", "d", "borda", "rank")


def borda_ranking(results: DataFrame, scores: dict[str, str] | None = None, weights: dict[str, float] | None = None, group: str = "query_id", item: str = "doc_id", missing: str = "last") -> DataFrame:
    """(query_id, doc_id, borda, rank): the whole combined order of every query, by weighted points, ties by identifier.

    Rows repeated for one (query, page) count once, with the largest of their values per score; rows without a query or
    page are left out. An empty table gives no rows. ``missing`` says what a null or NaN score gets: the "last" or "middle" rank.
    """
    if missing not in ("last", "middle"):
        raise ValueError(f"missing must be 'last' or 'middle', not {missing!r}")
    scores, weights = scores or SCORES, weights or {}
    rows = _items(results, scores, group, item)
    big = materialize(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BIG_QUERY).select("g"), "big_queries")
    if big.isEmpty():
        out = _in_place(rows, scores, weights, missing)
    else:
        out = _in_place(rows.join(big, "g", "left_anti"), scores, weights, missing).unionByName(_spread(rows.join(big, "g", "left_semi"), scores, weights, missing))
    return out.select(F.col("g").alias(group), F.col("d").alias(item), "borda", "rank")


def p6_found(spark, sf_dir: str) -> DataFrame:
    ranked = borda_ranking(spark.read.parquet(f"{sf_dir}/results.parquet"))
    return ranked.where("rank <= 3").select("query_id", "doc_id")


def p6_borda(spark, sf_dir: str) -> DataFrame:
    return borda_ranking(spark.read.parquet(f"{sf_dir}/results.parquet")).select("query_id", "doc_id", "rank")


QUERIES = {"p6_found": p6_found, "p6_borda": p6_borda}

_RANKED = """
with one as (
  select query_id, doc_id, max(bm25_score) as a, max(score_details.field_boost) as b, max(score_details.prf) as c,
         max(score_details.link) as d, max(score_details.lsa) as e
  from results where query_id is not null and doc_id is not null group by query_id, doc_id),
long as (
  select query_id, doc_id, unnest(['a', 'b', 'c', 'd', 'e']) as m, unnest([a, b, c, d, e]) as v from one),
pts as (
  select query_id, doc_id, m,
    rank() over (partition by query_id, m order by v nulls first) - 1 as beaten,
    count(*) over (partition by query_id, m, v) as c, count(*) over (partition by query_id, m) as n
  from long),
total as (
  select query_id, doc_id,
    round(sum(round(case when n > 1 then (beaten + (c - 1) / 2.0::double) / (n - 1) else 0.5 end, 9)) / 5.0, 6) as borda
  from pts group by query_id, doc_id),
ranked as (
  select query_id, doc_id, cast(row_number() over (partition by query_id order by borda desc, doc_id) as int) as rank from total)
"""
ORACLE = {
    "p6_found": _RANKED + "select query_id, doc_id from ranked where rank <= 3",
    "p6_borda": _RANKED + "select query_id, doc_id, rank from ranked",
}
