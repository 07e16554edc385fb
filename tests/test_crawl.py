from pyspark.sql import functions as F

from gleaner.operators import crawl as L, frontier as R
from gleaner.sources.fetch import replay

EN = "the town of tuebingen and the river in the valley "


def page(links, text=EN, lang="en", title="T"):
    return f"<html lang={lang}><title>{title}</title><body>{text}{''.join(f'<a href={x}>l</a>' for x in links)}</body></html>"


WEB = [
    ("https://a.de/", 200, "text/html", page(["/1", "/2", "https://b.de/", "https://x.archive.org/"])),
    ("https://a.de/1", 200, "text/html", page(["/"], "about nothing of the sort and the rest of it")),
    ("https://a.de/2", 503, "text/html", ""),
    ("https://b.de/", 200, "text/html", page(["https://c.de/"], "das ist nicht die Stadt und der Fluss, sondern tuebingen mit dem Tal", "de")),
    ("https://c.de/", 200, "application/pdf", ""),
]


def test_crawl(spark, monkeypatch):
    web = spark.createDataFrame(WEB, "url string, status int, content_type string, html string")
    robots = spark.createDataFrame([("c.de", 403, None)], "host string, status int, body string")
    state = L.fresh(spark, spark.createDataFrame([("https://a.de",), ("",)], "url string"))
    fetched = []

    def fetch(claimed):
        fetched.extend(r.url for r in claimed.collect())
        return replay(claimed, web)

    monkeypatch.setattr(L, "MOST_PARTS", 3)
    state = L.crawl(state, fetch, robots, R.Crawl(max_pages=10), max_rounds=20)
    assert fetched.count("https://a.de/2") == 1 + R.MAX_RETRIES == 4
    assert [(r.doc_id, r.url) for r in state.pages.collect()] == [(0, "https://a.de/")]
    seen = {r.url: r.status_code for r in state.visited.collect()}
    assert seen == {"https://a.de/": "200", "https://a.de/1": "200", "https://a.de/2": "503", "https://b.de/": "200", "https://c.de/": "robots_blocked"}
    assert state.frontier.isEmpty()
    s = L.summary(state, {"rounds_total": 5, "runs_completed": 2, "attempted_urls_total": 7, "elapsed_seconds_total": 1.5, "interrupted_runs": 1}, 2.0, True)
    assert s["total_pages"] == 1 and s["rounds_total"] == state.rounds + 5 and s["runs_completed"] == 3 and s["interrupted_runs"] == 2 and s["elapsed_seconds_total"] == 3.5
    # four pages, a blocked one, and three more tries of the one that fails
    assert s["attempted_urls_this_run"] == 8 and s["attempted_urls_total"] == 15


def test_claim_is_polite(spark):
    rows = [("low", "a.de", 0, "u0", 0), ("high", "a.de", 5, "u1", 0), ("high", "a.de", 3, "u2", 0), ("low", "b.de", 1, "u3", 0), ("low", "c.de", 1, "u4", 0)]
    frontier = spark.createDataFrame(rows, "level string, domain string, seq bigint, url string, attempts int")
    clock = spark.createDataFrame([("b.de", 9.0), ("c.de", 1.0)], "domain string, next_time double")
    got = R.claim(frontier, clock, 2.0)
    assert {r.url for r in got.collect()} == {"u2", "u4"}
    after = {r.domain: r.next_time for r in R.advance(clock, got, 2.0, 0.5).collect()}
    assert after == {"a.de": 2.5, "b.de": 9.0, "c.de": 2.5}
    sizes = {r.level: (r.urls, r.ready_domains) for r in R.frontier_sizes(frontier, clock, 2.0).collect()}
    assert sizes == {"high": (2, 1), "low": (3, 2)}


def test_route(spark):
    links = spark.createDataFrame([("https://a.de/x", False), ("https://a.de/x", True), ("https://a.de/y", False), ("https://web.archive.org/z", True), ("https://a.de/f.pdf", True), ("https://a.de/seen", True)], "url string, promote boolean")
    seen = spark.createDataFrame([("https://a.de/seen",)], "url string")
    assert {(r.level, r.url) for r in R.route(links, seen).collect()} == {("high", "https://a.de/x"), ("low", "https://a.de/y")}


def test_numbers(spark):
    rows = spark.range(500).select(F.concat(F.lit("u"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("url")).repartition(7)
    got = [(r.url, r.n) for r in R.number_new(rows, 10, "n", ["url"]).orderBy("url").collect()]
    assert [n for _, n in got] == list(range(11, 511))
    assert R.number_new(rows.limit(0), 10, "n", ["url"]).count() == 0
