import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from gleaner.llm import p7_enrichment as P
from tests.conftest import SMALL, same_rows


def exact(k, n, big_k, big_n):
    total = math.comb(big_n, n)
    p = sum(Fraction(math.comb(big_k, i) * math.comb(big_n - big_k, n - i), total) for i in range(k, min(n, big_k) + 1))
    return math.inf if p == 0 else -math.log(p)


def test_log_gamma():
    x = np.array([0.1, 0.5, 1, 2, 3.7, 9.99, 10, 55.5, 1e4, 1e9])
    assert np.allclose(P.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("n,big_k,big_n", [(10, 4, 50), (30, 60, 200), (5, 5, 5), (1, 1, 1000), (40, 3, 5000)])
def test_tail(n, big_k, big_n):
    ks = np.arange(0, min(n, big_k) + 2)
    got = P.neg_log_tail(ks, np.full(len(ks), n), np.full(len(ks), big_k), np.full(len(ks), big_n))
    assert np.allclose(got, [max(0.0, exact(int(k), n, big_k, big_n)) for k in ks], rtol=1e-8, atol=1e-9)


SCHEMA = "doc_id bigint, body_tokens array<string>, term string, n int, k bigint, score double"


def pages(spark, *rows):
    return spark.createDataFrame([(d, t, "x", 0, 0, 0.0) for d, t in rows], SCHEMA)


def test_edges(spark):
    df = pages(spark, (1, ["a", "a", "b", None]), (1, ["a", "a", "b", None]), (2, ["b", "c", "b"]), (3, None), (4, []), (None, ["a"]), (5, ["b", "d"]))
    got = {(r.doc_id, r.term): (r.k, r.n, r.collection_k) for r in P.enrichment(df).collect()}
    assert got == {(1, "a"): (2, 3, 2), (1, "b"): (1, 3, 4), (2, "b"): (2, 3, 4), (2, "c"): (1, 3, 1), (5, "b"): (1, 2, 4), (5, "d"): (1, 2, 1)}
    probes = spark.createDataFrame([(1,), (1,), (77,), (None,), (4,)], "doc_id bigint")
    assert [tuple(r) for r in P.top_terms(df, probes).collect()] == [(1, "a")]
    assert P.top_terms(pages(spark)).count() == 0


def test_ties_and_order(spark):
    df = pages(spark, (1, ["x", "x", "y", "y", "z"]), (2, ["z"] * 9))
    assert P.top_terms(df.where("doc_id = 1")).count() == 1
    adj = {r.term: (r.score, r.adjusted) for r in P.adjusted(P.enrichment(df)).where("doc_id = 1").collect()}
    assert all(a <= s + 1e-12 for s, a in adj.values())


def test_against_brute_force(spark):
    df = spark.read.parquet(f"{SMALL}/preprocessed_pages.parquet")
    docs = {r.doc_id: r.body_tokens for r in df.select("doc_id", "body_tokens").collect() if r.body_tokens}
    total = Counter(t for ts in docs.values() for t in ts)
    big_n = sum(total.values())
    got = {r.doc_id: r.term for r in P.p7_found(spark, SMALL).collect()}
    asked = {r.doc_id for r in spark.read.parquet(f"{SMALL}/probe_pages.parquet").collect()} & set(docs)
    assert set(got) == asked
    for d in asked:
        own = Counter(docs[d])
        score = {t: round(exact(k, len(docs[d]), total[t], big_n), 6) for t, k in own.items()}
        assert score[got[d]] == max(score.values())


def test_twin(spark, duck):
    same_rows(P.p7_found(spark, SMALL), duck, P.ORACLE["p7_found"])
