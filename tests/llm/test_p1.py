from collections import defaultdict
from urllib.parse import urlsplit

import pytest

from gleaner.llm import p1_site_lines as P
from tests.conftest import SMALL, same_rows


def brute(rows):
    lines = defaultdict(set)
    at = []
    for d, url, body in rows:
        host = (urlsplit(url or "").hostname or "").lower()
        site = ".".join(host.split(".")[-2:])
        if d is None or not site or not body:
            continue
        for i, line in enumerate(body.split("\n"), 1):
            k = "".join(c for c in line.lower() if c.isalpha())
            if len(k) >= 3:
                lines[site, k].add(d)
                at.append((d, i, (site, k)))
    return {(d, i) for d, i, k in at if len(lines[k]) >= 5}


def test_against_brute_force(spark):
    pages = spark.read.parquet(f"{SMALL}/raw_pages.parquet")
    got = P.repeated_lines(pages).collect()
    assert len(got) == len(set(got)) > 0
    assert {(r.doc_id, r.line_no) for r in got} == brute((r.doc_id, r.url, r.body) for r in pages.collect())


@pytest.mark.parametrize("name", sorted(P.ORACLE))
def test_twin(spark, duck, name):
    same_rows(P.QUERIES[name](spark, SMALL), duck, P.ORACLE[name])


def case(raw_pages):
    rows = [{"doc_id": i, "url": f"HTTPS://{h}A.Example:443/{i}", "body": f"Legal, Note {i}!\r\nown text {'abcdefghij'[i]}\n\nab"} for i, h in enumerate(("", "www.", "m.", "x.", "y."))]
    rows += [rows[0], {"doc_id": 8, "url": None, "body": "legal note"}, {"doc_id": 9, "url": "https://b.example/", "body": "legal note"}, {"doc_id": None, "url": "https://a.example/", "body": "legal note"}]
    rows += [{"doc_id": 10, "url": "https://a.example/", "body": None}, {"doc_id": 11, "url": "nonsense", "body": "legal note"}, {"doc_id": 12, "url": "https://a.example/x", "body": ""}]
    return raw_pages(*rows)


def test_edges(raw_pages):
    assert sorted((r.doc_id, r.line_no) for r in P.repeated_lines(case(raw_pages)).collect()) == [(i, 1) for i in range(5)]
    assert P.repeated_lines(raw_pages()).count() == 0


def test_removal(raw_pages):
    pages = case(raw_pages)
    out = P.remove_repeated_lines(pages)
    assert out.count() == pages.count()
    got = {r.doc_id: (r.clean_body, r.removed_lines) for r in out.collect()}
    assert got[1] == ("own text b\n\nab", 1) and got[9] == ("legal note", 0) and got[10] == (None, 0) and got[12] == ("", 0)
    assert P.remove_repeated_lines(raw_pages()).count() == 0


def test_broadcast_and_shuffle_agree(raw_pages, spark, monkeypatch):
    pages = spark.read.parquet(f"{SMALL}/raw_pages.parquet")
    cleaned = lambda p: sorted((str(r.doc_id), r.removed_lines, str(r.clean_body)) for r in P.remove_repeated_lines(p).collect())
    want = sorted(map(tuple, P.repeated_lines(case(raw_pages)).collect())), cleaned(case(raw_pages)), cleaned(pages)
    assert sum(n for _, n, _ in want[2]) > 0
    monkeypatch.setattr(P, "BROADCAST_KEYS", 0)
    assert (sorted(map(tuple, P.repeated_lines(case(raw_pages)).collect())), cleaned(case(raw_pages)), cleaned(pages)) == want


def test_removal_moves_no_body(spark):
    """The broadcast way reads bodies and writes them, with no exchange between."""
    pages = spark.read.parquet(f"{SMALL}/raw_pages.parquet")
    assert "Exchange" not in P.remove_repeated_lines(pages)._jdf.queryExecution().executedPlan().toString()


def test_summaries_merge(spark):
    pages = spark.read.parquet(f"{SMALL}/raw_pages.parquet")
    ledger = P.line_ledger(pages)
    whole = P.site_summaries(ledger, 64)
    parts = P.merge_summaries(P.site_summaries(ledger.where("doc_id % 2 = 0"), 64), P.site_summaries(ledger.where("doc_id % 2 = 1"), 64))
    assert whole.exceptAll(parts).count() == 0 == parts.exceptAll(whole).count()
    assert P.confirmed_lines(ledger, slots=64).exceptAll(P.confirmed_lines(ledger)).count() == 0
