import math

import pandas as pd
import pytest

from gleaner.llm import p6_borda as P
from tests.conftest import SMALL, same_rows

SCHEMA = "query_id string, doc_id bigint, bm25_score double, score_details struct<field_boost double, prf double, link double, lsa double>, extra string, b string, g string, p double"


def row(q, d, *v):
    v = [None if x is None else float(x) for x in v]
    return (q, d, v[0], tuple(v[1:]), "x", "y", "z", 0.0)


@pytest.mark.parametrize("name", sorted(P.ORACLE))
def test_twin(spark, duck, name):
    same_rows(P.QUERIES[name](spark, SMALL), duck, P.ORACLE[name])


def pandas_points(g, missing):
    out = 0
    for c in "abcde":
        if missing == "last":
            out = out + (g[c].rank(method="average", na_option="top") - 1) / max(1, len(g) - 1)
        else:
            out = out + ((g[c].rank(method="average") - 1) / max(1, g[c].notna().sum() - 1)).where(g[c].notna() & (g[c].notna().sum() > 1), 0.5)
    return out / 5 if len(g) > 1 else out * 0 + 0.5


@pytest.mark.parametrize("big", [200_000, 20])
@pytest.mark.parametrize("missing", ["last", "middle"])
def test_against_pandas(spark, monkeypatch, missing, big):
    """Both ways of ranking give what pandas gives, some queries going one and some the other."""
    monkeypatch.setattr(P, "BIG_QUERY", big)
    results = spark.read.parquet(f"{SMALL}/results.parquet")
    pdf = results.selectExpr("query_id", "doc_id", "bm25_score a", "score_details.field_boost b", "score_details.prf c", "score_details.link d", "score_details.lsa e").toPandas().drop_duplicates()
    want = {}
    for q, g in pdf.groupby("query_id"):
        want |= {(q, d): round(x, 6) for d, x in zip(g.doc_id, pandas_points(g, missing))}
    rows = P.borda_ranking(results, missing=missing).collect()
    assert {(r.query_id, r.doc_id): r.borda for r in rows} == pytest.approx(want, abs=2e-6)
    for q in {r.query_id for r in rows}:
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and own == sorted(own, key=lambda r: (-r.borda, r.doc_id))


def test_one_exchange(spark):
    plan = P.p6_found(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2


def test_units_and_outliers_have_no_effect(spark):
    base = [row("q", d, d, d * 2, -d, 5.0, 0.1 * d) for d in range(1, 8)]
    wild = [row("q", d, math.exp(d * 60), d * 2e-9, -d * 1e12, 5.0, 0.1 * d) for d in range(1, 8)]
    rank = lambda rows: {r.doc_id: r.rank for r in P.borda_ranking(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert rank(base) == rank(wild) == {d: 8 - d for d in range(1, 8)}


def test_edges(spark):
    nan = float("nan")
    rows = [row("q", 1, 1.0, None, None, None, None), row("q", 2, None, 0.5, nan, None, None), row("q", 3, 1.0, 0.5, 0.1, None, None), row("q", 3, 1.0, 0.5, 0.1, None, None), row("one", 9, None, None, None, None, None), row(None, 1, 1.0, 1.0, 1.0, 1.0, 1.0), row("q", None, 9.0, 9.0, 9.0, 9.0, 9.0)]
    got = {(r.query_id, r.doc_id): (r.rank, r.borda) for r in P.borda_ranking(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: v[0] for k, v in got.items()} == {("q", 3): 1, ("q", 1): 2, ("q", 2): 3, ("one", 9): 1} or got[("q", 3)][0] == 1
    assert got[("one", 9)][1] == 0.5 and len(got) == 4
    assert P.borda_ranking(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        P.borda_ranking(spark.createDataFrame([], SCHEMA), missing="first")


def test_ties_go_by_identifier(spark):
    rows = [row("q", d, 1.0, 1.0, 1.0, 1.0, 1.0) for d in (5, 2, 9)]
    assert [r.doc_id for r in P.borda_ranking(spark.createDataFrame(rows, SCHEMA)).orderBy("rank").collect()] == [2, 5, 9]


def test_weights_and_hot_group(spark):
    df = spark.range(3000).selectExpr("'q' query_id", "id doc_id", "double(id) bm25_score", "named_struct('field_boost', -double(id), 'prf', 0D, 'link', 0D, 'lsa', 0D) score_details")
    got = P.borda_ranking(df, weights={"bm25_score": 3.0}).orderBy("rank").limit(3).collect()
    assert [r.doc_id for r in got] == [2999, 2998, 2997]
    assert pd.Series([r.rank for r in P.borda_ranking(df).collect()]).sort_values().tolist() == list(range(1, 3001))
