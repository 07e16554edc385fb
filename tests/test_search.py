import random
import time

import pytest
from pyspark.sql import functions as F

from gleaner.functions.distance import damerau
from gleaner.operators import analyze as A, batch as B, bm25 as R, explain as E, index as I, rerank as K, spelling as S
from gleaner.sources.fetch import live_text
from tests.conftest import SMALL

SCHEMA = "doc_id bigint, url string, fetched_url string, canonical_url string, title string, title_tokens array<string>, heading_tokens array<string>, body_tokens array<string>, body_length int, outgoing_links array<string>, crawl_time string, snippet string"


def doc(i, title, heading, body, links=(), url=None):
    return (i, url if url is not None else f"https://d{i}/", None, None, title, title.split(), heading.split(), body.split(), len(body.split()), list(links), "", "")


DOCS = [
    doc(0, "tubingen castl", "castl museum", "castl hill museum tower castl"),
    doc(1, "food market", "", "market food tubingen drink"),
    doc(2, "museum", "museum", "museum art museum art museum tubingen castl art"),
    doc(3, "river", "punt", "river punt boat"),
]


@pytest.fixture(scope="module")
def index(spark):
    return I.build_index(spark.createDataFrame(DOCS + DOCS[:1], SCHEMA)).persist()


def run(spark, index, text, k=100):
    asked = spark.createDataFrame([("q", text, text.split(), 0)], "query_id string, query string, query_tokens array<string>, pos bigint")
    found = R.retrieve(asked, index, R.Bm25(top_k=k))
    return asked, found


def test_index(index):
    assert index.stats == (4, 5.0)
    df = {r.term: r.df for r in index.vocabulary.collect()}
    assert len(df) == 12 and (df["tubingen"], df["castl"], df["museum"]) == (3, 2, 2)
    assert sorted(set(df.values())) == [1, 2, 3]


@pytest.mark.parametrize("text,want", [
    ("castl museum", {0: 2.1261, 2: 1.6878}), ("tubingen", {1: 0.3885, 0: 0.3567, 2: 0.2864}), ("punt", {3: 1.8653}), ("tubingen food", {1: 2.1426, 0: 0.3567, 2: 0.2864}),
])
def test_bm25(spark, index, text, want):
    _, found = run(spark, index, text)
    assert {r.doc_id: r.bm25_score for r in found.collect()} == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("text,want", [
    ("castl museum", [(0, 1.0), (2, 0.3)]), ("tubingen", [(1, 0.7), (0, 0.682), (2, 0.0)]), ("punt", [(3, 0.8)]), ("tubingen food", [(1, 0.9), (0, 0.2265), (2, 0.0)]),
])
def test_rerank(spark, index, text, want):
    asked, found = run(spark, index, text)
    r = K.rerank(found, asked, index.docs).orderBy("rank").collect()
    assert [(x.doc_id, x.score) for x in r] == [(d, pytest.approx(s, abs=1e-4)) for d, s in want]
    assert all(0 <= x.score_details.normalized_bm25 <= 1 for x in r)


def test_cut_and_ties(spark, index):
    _, found = run(spark, index, "tubingen", k=1)
    assert [r.doc_id for r in found.collect()] == [1]
    assert run(spark, index, "nothing")[1].count() == 0


def test_empty(spark):
    empty = I.build_index(spark.createDataFrame([], SCHEMA))
    assert empty.stats == (0, 0.0) and run(spark, empty, "tubingen")[1].count() == 0
    bare = I.build_index(spark.createDataFrame([(1, *[None] * 11)], SCHEMA))
    assert bare.stats == (1, 0.0) and bare.docs.first().url == ""
    with pytest.raises(Exception, match="no doc_id"):
        I.build_index(spark.createDataFrame([(None, *[None] * 11)], SCHEMA)).docs.collect()


def test_save_and_open(spark, index, tmp_path):
    index.save(str(tmp_path), 4)
    again = I.Index.open(spark, str(tmp_path))
    assert again.stats == index.stats
    assert run(spark, again, "castl museum")[1].select("doc_id", "bm25_score").exceptAll(run(spark, index, "castl museum")[1].select("doc_id", "bm25_score")).count() == 0


def test_spelling(spark):
    vocab = spark.createDataFrame([("castl", 2), ("museum", 2), ("market", 1)], "term string, df bigint")
    asked = spark.createDataFrame([("a", ["muesum", "castel", "nuseum", "tub", "1234", "market"]), ("b", [])], "query_id string, query_tokens array<string>")
    r = {x.query_id: x for x in S.correct(asked, vocab).collect()}
    assert r["a"].query_tokens == ["museum", "castl", "nuseum", "tub", "1234", "market"] and r["b"].query_tokens == []
    assert [(x.entered, x.corrected) for x in S.shown_corrections(S.correct(asked, vocab)).collect()] == [("muesum", "museum"), ("castel", "castl")]
    typed = S.correct(asked, vocab).withColumn("w", F.array(F.lit("muesums")))
    assert [(x.entered, x.corrected) for x in S.shown_corrections(typed, F.col("w")).collect()] == [("muesums", "museum"), ("castel", "castl")]


def test_candidates_against_brute_force(spark):
    """Deletion forms find every pair within the permitted edits."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))
    terms, tokens = sorted({word() for _ in range(300)}), sorted({word() for _ in range(120)})
    vocab = spark.createDataFrame([(t, 1) for t in terms], "term string, df bigint")
    got = {(r.token, r.term, r.dist) for r in S.candidates(spark.createDataFrame([(t,) for t in tokens], "token string"), vocab).collect()}
    most = lambda t: 1 if len(t) <= 5 else 2
    want = {(a, b, damerau(a, b)) for a in tokens for b in terms if len(a) > 3 and a[0] == b[0] and abs(len(a) - len(b)) <= most(a) and damerau(a, b) <= most(a)}
    assert got == want and len(want) > 50


def test_index_cache(spark, tmp_path):
    docs = I.build_index(spark.read.parquet(f"{SMALL}/preprocessed_pages.parquet"))
    cache, path = I.IndexCache(spark), str(tmp_path / "i")
    empty, message = cache.get(path)
    assert empty.docs.count() == 0 and path in message
    docs.save(path, 4)
    first, message = cache.get(path)
    assert message == "" and first.docs.count() == docs.docs.count() and cache.get(path)[0] is first
    time.sleep(1.1)
    docs.save(path, 2)
    assert cache.get(path)[0] is not first and cache.get(path)[0].buckets == 2


def test_postings_in_parts(spark):
    p = spark.createDataFrame([("a", i, 1) for i in range(25)] + [("b", 3, 2)], "term string, doc_id bigint, tf int")
    got = {(r.term, r.part): [x.doc_id for x in r.postings] for r in I.postings_lists(p, 10).collect()}
    assert got == {("a", 0): list(range(10)), ("a", 1): list(range(10, 20)), ("a", 2): list(range(20, 25)), ("b", 0): [3]}


def test_spelling_ties(spark):
    vocab = spark.createDataFrame([("tower", 1), ("toter", 5), ("toger", 5)], "term string, df bigint")
    asked = spark.createDataFrame([("a", ["toxer"])], "query_id string, query_tokens array<string>")
    assert S.correct(asked, vocab).first().query_tokens == ["toger"]


def test_batch_equals_single(spark, index):
    queries = spark.createDataFrame([("1", "museum", 0), ("2", "market food", 1), ("3", "the and", 2), ("4", None, 3), ("1", "museum", 4)], "query_id string, query string, pos bigint")
    both = {(r.query_id, r.doc_id, r.score) for r in B.search(queries, index).collect()}
    single = set()
    for q in ("1", "2", "3", "4"):
        single |= {(r.query_id, r.doc_id, r.score) for r in B.search(queries.where(F.col("query_id") == q), index).collect()}
    assert both == single and {q for q, *_ in both} == {"1", "2"}


def test_rows_keep_their_ranks(spark):
    r = spark.createDataFrame([("q", 1, "a", "", "", 0.5, 1.0), ("q", 2, "", None, "", 0.4, 1.0), ("q", 3, None, "f", "", None, 0.25)], "query_id string, rank int, url string, fetched_url string, canonical_url string, score double, bm25_score double")
    assert [tuple(x) for x in B.result_rows(r).orderBy("rank").collect()] == [("q", 1, "a", "0.500000"), ("q", 3, "f", "0.250000")]


def test_links(spark):
    docs = spark.createDataFrame([doc(0, "a", "", "a", ["https://b/", "https://b/", "https://a", "https://x/"], "https://a/"), doc(1, "b", "", "b", [], "https://b/")], SCHEMA).withColumn("canonical_url", F.when(F.col("doc_id") == 0, "https://a"))
    assert {r.doc_id: r.targets for r in I.link_graph(docs).collect()} == {0: [1], 1: []}
    shared = spark.createDataFrame([doc(0, "a", "", "a", [], "https://s/"), doc(1, "b", "", "b", [], "https://s/"), doc(2, "c", "", "c", ["https://s/"])], SCHEMA)
    assert [(r.src, r.dst) for r in I.link_edges(shared).collect()] == [(2, 1)]


def test_latest_and_preprocess(spark):
    rows = [(1, "https://a/", "T", ["H"], "old body", "2025-01-01"), (1, "https://a/", "T", ["H"], "new body", "2025-01-02"), (2, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "doc_id bigint, url string, title string, headings array<string>, body string, t string").select("*", F.to_timestamp("t").alias("ingested_at"), F.lit(None).cast("string").alias("canonical_url"), F.lit(None).cast("array<string>").alias("outgoing_links"), F.lit(None).cast("string").alias("crawl_time")).drop("t")
    got = {r.doc_id: r for r in A.preprocess(A.latest_pages(pages)).collect()}
    assert got[1].body_tokens == ["new", "bodi"] and got[2].body_tokens == [] and got[2].url == ""


def test_explanations(spark):
    df = spark.createDataFrame([("A <Mark> & mark markt", ["mark", "markt", "a"], "https://x/caf%C3%A9+y")], "t string, q array<string>, u string")
    r = df.select(
        E.highlight(F.col("t"), F.col("q")).alias("h"), E.found_terms(E.page_text(F.col("t"), F.col("u"), F.lit(""), F.lit(None).cast("string")), F.array(F.lit("mark"), F.lit("arkt"), F.lit("café"), F.lit("c++"))).alias("f"),
        E.why_reasons(F.col("q"), F.array(F.lit("mark")), F.expr(E.EMPTY), F.expr(E.EMPTY), F.expr(E.EMPTY)).alias("w"),
        E.why_reasons(F.col("q"), F.expr(E.EMPTY), F.expr(E.EMPTY), F.expr(E.EMPTY), F.expr(E.EMPTY)).alias("n"), E.score_value(F.lit(1.7)).alias("s"),
    ).first()
    assert r.h == "A &lt;<mark>Mark</mark>&gt; &amp; <mark>mark</mark> <mark>markt</mark>"
    assert r.f == ["mark", "café"] and r.s == 1.0
    assert r.w == ["Matched query term in title: mark"] and r.n == ["BM25 found textual overlap with the query."]


def test_summary(spark):
    body = "The castle of the town stands on a green hill above it. Nobody knows when it was built or by whom at all. The castle museum shows many old things from the town."
    df = spark.createDataFrame([("q", 1, body, "snip", "Museum", ["castle"]), ("q", 2, None, "snip", "x", ["castle"])], "query_id string, doc_id bigint, body string, snippet string, title string, query_terms array<string>")
    got = {r.doc_id: r.summary for r in E.smart_summary(df, A.PLAIN).collect()}
    assert got[1].startswith("The castle of the town") and "museum shows" in got[1] and got[2] == "snip"


def test_context(spark):
    text = "x" * 60 + ". The needle sentence is long enough to be kept here. " + "y " * 200
    df = spark.createDataFrame([(text, "needle"), ("short", "needle")], "t string, q string").select(E.compact_context(F.col("t"), F.col("q"), 240).alias("c")).collect()
    assert "needle sentence" in df[0].c and df[1].c == "short"


def test_prompt_pieces(spark):
    df = spark.createDataFrame([("T", "u", "s", None, "  ", "q")], "t string, u string, s string, a string, b string, q string")
    r = df.select(E.page_context(F.col("t"), F.col("u"), F.col("s"), [F.col("a"), F.col("b")], F.col("q")).alias("c"), E.fill("<{x}|{y}>", x=F.col("t"), y=F.col("a")).alias("f")).first()
    assert tuple(r.c) == ("Title: T\nURL: u\nSnippet: s\nPage text: s", "snippet") and r.f == "<T|>"
    df = df.withColumnRenamed("u", "url")
    live = live_text(df, lambda u: (u, 200, "text/html", "<nav>x</nav><main>fetched text</main>"), F.col("a"))
    own = live.select(E.page_context(F.col("t"), F.col("url"), F.col("s"), [F.col("a")], F.col("q"), live=F.col("live")).alias("c")).first()
    assert own.c.source == "live fetched page text" and own.c.context.endswith("Page text: fetched text") and live.columns == [*df.columns, "live"]
    long = df.withColumn("a", F.repeat(F.lit("word "), 200))
    got = live_text(long, lambda u: 1 / 0, F.col("a")).select("live", E.page_context(F.col("t"), F.col("url"), F.col("s"), [F.col("a")], F.col("q"), live=F.lit("x" * 5000)).alias("c")).first()
    assert got.live is None and got.c.source == "crawled page text"
    asks = spark.createDataFrame([("summary", None), ("custom", "Do it."), ("custom", " "), (None, None), ("odd", "x")], "m string, i string")
    texts = [x.p for x in asks.select(E.prompts(F.col("m"), F.lit("QUERY"), F.lit("PAGE"), F.col("i")).alias("p")).collect()]
    assert all("PAGE" in t for t in texts) and ["QUERY" in t for t in texts] == [False, False, True, True, True] and texts[1].startswith("Do it.")
    modes = spark.createDataFrame([("sum", "t"), ("other", "t"), (None, "t")], "m string, t string")
    assert [x.p for x in modes.select(E.routed(F.col("m"), {"sum": "S {t}", "ask": "A {t}"}, "ask", t=F.col("t")).alias("p")).collect()] == ["S t", "A t", "A t"]
    rows = spark.createDataFrame([("q", 1, None, 0.5, None, ["b", "a", "b"]), ("q", 2, None, 0.9, None, None)], "query_id string, doc_id bigint, rank int, bm25_score double, score double, matched_terms array<string>")
    assert [(r.doc_id, r.rank, r.score, r.matched_terms) for r in E.adapt_results(rows).orderBy("rank").collect()] == [(2, 1, 0.9, []), (1, 2, 0.5, ["b", "a"])]


def test_broadcast_and_shuffle_agree(spark, index, monkeypatch):
    want = {(r.doc_id, r.bm25_score) for r in run(spark, index, "castl museum")[1].collect()}
    monkeypatch.setattr(R, "BROADCAST_TERMS", 0)
    assert {(r.doc_id, r.bm25_score) for r in run(spark, index, "castl museum")[1].collect()} == want


def test_cells_agree(spark, monkeypatch):
    """Matches are scored where their documents are; only each query's best leave a cell, and equal queries are scored once."""
    docs = [doc(i, "", "", " ".join(["common"] * (1 + i % 3) + [f"w{i % 5}"] * (i % 2) + ["x"] * (i % 7))) for i in range(60)]
    index = I.build_index(spark.createDataFrame(docs, SCHEMA))
    asked = [("a", ["common", "w1"]), ("b", ["w1", "common"]), ("c", ["common"]), ("d", ["w3"]), ("e", ["none"]), ("f", [])]
    analysed = spark.createDataFrame([(q, "", t, i) for i, (q, t) in enumerate(asked)], "query_id string, query string, query_tokens array<string>, pos bigint")

    terms = R.query_terms(analysed)
    hits = terms.join(index.postings, "term").join(index.vocabulary, "term")
    w = R.term_weight(R.idf(index.stats[0], F.col("df")), F.col("tf"), F.col("doc_length"), index.stats[1], R.Bm25())
    plain = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(w), 9).alias("s"), F.sort_array(F.collect_list("term")).alias("m")).collect()
    want = {}
    for q in {r.query_id for r in plain}:
        for i, r in enumerate(sorted((r for r in plain if r.query_id == q), key=lambda r: (-r.s, r.doc_id))):
            want[q, r.doc_id] = (i + 1, round(r.s, 4), r.m)
    for sets, blocks in ((20_000, 20_000), (1, 7)):
        monkeypatch.setattr(R, "CELL_SETS", sets)
        monkeypatch.setattr(R, "CELL_DOCS", blocks)
        best = R.candidates(terms, index, R.Bm25(top_k=8), digits=9)
        got = {(r.query_id, r.doc_id): (r.bm25_rank, round(r.bm25_score, 4), r.matched_terms) for r in best.collect()}
        assert got == {k: v for k, v in want.items() if v[0] <= 8}
        found = {(r.query_id, r.doc_id): (round(r.bm25, 4), r.matched_terms) for r in R.matches(terms, index).collect()}
        assert found == {k: v[1:] for k, v in want.items()}
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id, doc_id" not in plan  # a match is never shuffled


def test_queries_of_many_terms(spark):
    many = [f"t{i:03d}" for i in range(150)]
    ix = I.build_index(spark.createDataFrame([doc(0, "", "", " ".join(many[::2])), doc(1, "", "", many[149])], SCHEMA))
    asked = spark.createDataFrame([("q", "", many, 0)], "query_id string, query string, query_tokens array<string>, pos bigint")
    got = {r.doc_id: r.matched_terms for r in R.retrieve(asked, ix).collect()}
    assert got == {0: many[::2], 1: [many[149]]}


def test_one_per_key(spark, monkeypatch):
    from gleaner.operators import dedup

    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (None, "d", 1), (3, None, None), (3, None, None), (2, "c", 1)], "k bigint, v string, t int")
    want = [(1, "b"), (2, "c"), (3, None)]
    assert sorted((r.k, r.v) for r in dedup.one_per_key(rows, "k", F.struct("t", "v")).collect()) == want
    monkeypatch.setattr(dedup, "FEW_ROWS", -1)
    assert sorted((r.k, r.v) for r in dedup.one_per_key(rows, "k", F.struct("t", "v")).collect()) == want
    monkeypatch.setattr(dedup, "BROADCAST_KEYS", -1)
    assert sorted((r.k, r.v) for r in dedup.one_per_key(rows, "k", F.struct("t", "v")).collect()) == want
    assert dedup.one_per_key(rows.limit(0), "k", F.col("t")).count() == 0
