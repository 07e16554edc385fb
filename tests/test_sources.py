import gzip
import json
import time

import pytest

from gleaner import schemas
import os

from gleaner import session
from gleaner.sources import files as FS
from gleaner.sources.log import log_to
from gleaner.sources import fetch as H, tables as S


def test_json(spark, tmp_path):
    p = tmp_path / "x.json"
    assert S.read_json(spark, str(p), "a bigint").count() == 0
    p.write_text("{broken")
    assert S.read_json(spark, str(p), "a bigint").count() == 0
    p.write_text(json.dumps({"pages": [{"doc_id": 1, "url": "u", "headings": ["h"]}]}))
    r = S.read_json(spark, str(p), schemas.RAW_PAGES, "pages").first()
    assert (r.doc_id, r.url, r.headings, r.body) == (1, "u", ["h"], None)
    for data in ({"ä": 1}, {"ä": [2]}):
        S.write_json(spark, str(p), data)
        assert json.loads(p.read_text()) == data and list(tmp_path.iterdir()) == [p]
    assert FS.read_text(spark, str(tmp_path / "none")) is None and FS.modified(spark, str(tmp_path / "none")) == 0 < FS.modified(spark, str(p))


def test_json_lines(spark, tmp_path):
    assert S.read_lines(spark, str(tmp_path / "none"), "a bigint, b array<string>").count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": ["x"]}\n{broken\n\n{"a": 2}\n')
    assert sorted((r.a, r.b) for r in S.read_lines(spark, str(tmp_path / "x.jsonl"), "a bigint, b array<string>").collect()) == [(1, ["x"]), (2, None)]


def test_log(tmp_path):
    log = log_to(str(tmp_path / "l" / "crawl.log"), "gleaner.test", console=False)
    log.info("worker=1 t+3ms"), log.info("done")
    log = log_to(str(tmp_path / "l" / "crawl.log"), "gleaner.test", console=False)
    log.info("worker=2")
    assert [x.split(" ", 2)[2] for x in (tmp_path / "l" / "crawl.log").read_text().splitlines()] == ["worker=1 t+3ms", "worker=2"]


def test_scratch(spark, tmp_path):
    with session.scratch():
        t = session.materialize(spark.range(3), "t")
        assert t.count() == 3 and os.path.exists(t.gleaner_path.removeprefix("file://"))
    assert not os.path.exists(t.gleaner_path.removeprefix("file://"))
    session.discard(spark.range(1), t)


@pytest.mark.parametrize("text,error", [("[]", "object"), ("{}", "documents"), ('{"documents": 3}', "list")])
def test_document_checks(spark, tmp_path, text, error):
    p = tmp_path / "d.json"
    p.write_text(text)
    with pytest.raises(ValueError, match=error):
        S.read_documents(spark, str(p))


def test_documents(spark, tmp_path):
    p = tmp_path / "d.json.gz"
    p.write_bytes(gzip.compress(json.dumps({"documents": [{"doc_id": 7, "body_tokens": ["a"]}]}).encode()))
    assert S.read_documents(spark, str(p)).first().body_tokens == ["a"]


def test_seeds(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"seeds": ["http://A.de", ""]}))
    assert [r.url for r in S.read_seeds(spark, str(p)).collect()] == ["https://a.de/"]


def test_queries(spark, tmp_path):
    p = tmp_path / "q.tsv"
    p.write_bytes('﻿1\t"a\tb" \n\n 2 \tc\n'.encode())
    assert [tuple(r) for r in S.read_queries(spark, str(p)).orderBy("pos").collect()] == [("1", "a\tb", 0), ("2", "c", 1)]
    p.write_text("1\ta\n2\n")
    with pytest.raises(ValueError, match="line 2"):
        S.read_queries(spark, str(p))
    assert S.parse_upload(b"\xff")[1] == ["the file isn't UTF-8"]
    assert S.parse_upload(b"  \n")[1] == ["no queries"]
    assert S.parse_upload(b"1\t\n1\t2\t3\n")[1] == ["line 1: empty id or query", "line 2: 3 columns instead of 2"]


def test_results(spark, tmp_path):
    rows = spark.createDataFrame([("2", 1, "u", "0.5"), ("#1", 2, 'a"b', "0.1"), ("#1", 1, "t\tx", "0.2")], schemas.RESULTS)
    queries = spark.createDataFrame([("#1", "x", 0), ("2", "y", 1)], schemas.QUERIES)
    S.write_results(rows, queries, str(tmp_path / "r.tsv"))
    assert (tmp_path / "r.tsv").read_text() == '#1\t1\t"t\tx"\t0.2\n#1\t2\t"a""b"\t0.1\n2\t1\tu\t0.5\n'
    assert S.result_lines([("1", 1, "u", "0.5")]) == "1\t1\tu\t0.5\n"


def test_parts_and_chain(spark, tmp_path):
    whole = gzip.compress(b"hello")
    (tmp_path / "o.gz.part001").write_bytes(whole[:5])
    (tmp_path / "o.gz.part002").write_bytes(whole[5:])
    assert S.read_parts(spark, str(tmp_path / "o.gz")) == b"hello"
    assert S.read_parts(spark, str(tmp_path / "none")) is None
    data, label, warning = S.first_source([("remote", lambda: None), ("bad", lambda: 1 / 0), ("local", lambda: 5)])
    assert (data, label) == (5, "local") and "remote" in warning and "division" in warning
    with pytest.raises(FileNotFoundError):
        S.first_source([("remote", lambda: None)])


def test_checkpoint(spark, tmp_path):
    assert S.load_checkpoint(spark, str(tmp_path)) is None
    for n in (1, 2, 3):
        S.save_checkpoint(spark, str(tmp_path), n, a=spark.range(n + 1))
    version, tables = S.load_checkpoint(spark, str(tmp_path))
    assert version == 3 and tables["a"].count() == 4
    assert {p.name for p in tmp_path.iterdir()} == {"v2", "v3", "latest.json"}


def test_fetch(spark):
    def get(url):
        if "slow" in url:
            time.sleep(3)
        if "bad" in url:
            raise OSError
        return url + "#", 200, "text/html", "<p>x"

    urls = spark.createDataFrame([("https://a/",), ("https://bad/",), ("https://slow/",)], "url string")
    got = {r.url: (r.status, r.html) for r in H.fetch(urls, get, timeout=0.5).collect()}
    assert got == {"https://a/": (200, "<p>x"), "https://bad/": (None, None), "https://slow/": (None, None)}


def test_robots(spark):
    robots = spark.createDataFrame([("a", 200, "User-agent: *\nDisallow: /no"), ("b", 403, None), ("c", 404, None), ("d", None, None)], "host string, status int, body string")
    urls = spark.createDataFrame([(u,) for u in ("https://a/no", "https://a/yes", "https://b/", "https://c/", "https://d/", "https://e/", None)], "url string")
    got = {r.url: r.allowed for r in H.robots_allowed(urls, robots, "x").collect()}
    assert got == {"https://a/no": False, "https://a/yes": True, "https://b/": False, "https://c/": True, "https://d/": True, "https://e/": True, None: True}


def test_settings():
    from gleaner.sources.settings import read_settings

    s = read_settings({"GLEANER_STORAGE_KEY": "k", "GLEANER_STORAGE_URL": "no"}, environ={"GLEANER_STORAGE_URL": "https://s/", "GLEANER_STORAGE_BUCKET": "b"})
    assert s.configured and s.path("x.json") == "https://s/b/x.json" and not read_settings(environ={}).configured


def test_call(spark):
    def answer(text):
        if text == "bad":
            raise ValueError("no")
        return text.upper()

    rows = spark.createDataFrame([("a",), ("bad",), (None,)], "prompt string")
    assert {r.prompt: r.text for r in H.call(rows, "prompt", "text", answer).collect()} == {"a": "A", "bad": "error: ValueError: no", None: None}
