"""The models of problems 3, 4 and 5 are fitted on all pages, not on a sample of them."""

import random
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import p3_boilerplate as B, p4_language as G, p5_stuffing as K, pagescan as N, pagetext as T
from tests.llm.test_pages import SPEECH, shuffled

RARE = "Where the Quokka sleeps beside the old mill, the path is closed to all visitors. The Quokka is left alone until it wakes in the evening."


@pytest.fixture
def table(raw_pages, plain_pages, monkeypatch):
    """Pages, some delivered twice, of which no sample gives any, as rows and as what a fit in memory reads."""
    monkeypatch.setattr(N, "sample_pages", lambda *_: [])
    pages = [*plain_pages, plain_pages[3], *({"doc_id": 400 + i, "url": "https://www.mill.example/x", "headings": None, "body": f"Mill shop | Contact\n{RARE}\nPart {'abc'[i]}" * (i + 1)} for i in range(3))]
    site = lambda p: p["url"].split("/")[2].split(".")[1]
    return raw_pages(*pages, {"doc_id": 500, "body": None}), [(site(p), p["headings"], p["body"], "en") for p in pages]


def test_words_are_weighed_over_all_pages(table, monkeypatch):
    rows, whole = table
    m, want = N.fit_pages(rows).model, T.fit(whole, N._collected(N.count_lines(rows)))
    assert m.weights == want.weights and m.weights["quokka"] < 0 < m.weights["contact"]
    monkeypatch.setattr(N, "HELD", 3)
    assert N.fit_pages(rows).model.weights == m.weights


def test_centres_are_those_of_all_pages(table):
    rows, whole = table
    want = T.fit(whole, N._collected(N.count_lines(rows)))
    assert B.centred(rows, None, True, False)[1] == want.centres != T.PageModel().centres
    got = {(r.doc_id, r.line_no) for r in B.boilerplate_lines(rows).collect()}
    assert got == {(r.doc_id, r.line_no) for r in B.boilerplate_lines(rows, N.Fitted(want)).collect()} and (3, 1) in got


def test_weighed_words_by_join(table, monkeypatch):
    """Where the weighed words are too many to be broadcast, each page comes with those of its own."""
    rows, _ = table
    lines, text = sorted(map(tuple, B.boilerplate_lines(rows).collect())), sorted(map(tuple, B.main_text(rows).collect()))
    monkeypatch.setattr(N, "BROADCAST_WORDS", 0)
    assert not N.fit_pages(rows).model.weights and sorted(map(tuple, B.boilerplate_lines(rows).collect())) == lines
    assert sorted(map(tuple, B.main_text(rows).collect())) == text


def test_languages_are_fitted_on_all_pages(raw_pages, monkeypatch):
    """A word that only the last of more lines than any language was fitted on has counts, and the fit in tasks is that on the driver."""
    monkeypatch.setattr(G, "sample_pages", lambda *_: [], raising=False)
    rng = random.Random(9)
    texts = [(shuffled(lang, rng), lang) for lang in SPEECH for _ in range(30)]
    pages = [{"doc_id": i, "url": "https://a.example/", "body": "\n".join([x, f"x{'ab'[i % 2]}q"]), "language": lang if i % 9 else "en"} for i, (x, lang) in enumerate(texts)]
    pages += [{"doc_id": 900, "url": "https://a.example/", "body": "\n".join(f"der Turm {' '.join(shuffled('de', rng).split()[:16])} quokkel" for _ in range(2000)), "language": "de"}]
    rows = raw_pages(*pages, {"doc_id": 901, "body": None, "language": "de"}, {"doc_id": 902, "body": "een oude toren", "language": "nl"})
    first = {(r.word, r.k): r.n for r in G.words_table(rows, None).collect()}
    assert first["quokkel", G.LANGS.index("de")] == 2000 and first == G.count_words([(p["body"].split("\n"), p["language"]) for p in pages], None)
    m, want = G.fit_crf_pages(rows), G.fit_crf([("", [], p["body"], p["language"]) for p in pages])
    assert np.allclose(m.weights, want.weights) and np.allclose(m.moves, want.moves) and np.abs(m.weights).sum() > 0
    assert [G.LANGS[k] for k in G.label(m, [G.line_words(x) for x in SPEECH.values()])[0]] == [*SPEECH]
    monkeypatch.setattr(G, "DRIVER_WORDS", 0)
    words = G.words_table(rows, None)
    monkeypatch.setattr(G, "train", lambda gradient, train=G.train: train(gradient, 3))
    assert np.allclose(G.train_table(words).weights, G.train_counts(first).weights)


def test_prose_is_that_of_all_pages(table):
    """Problem 5's n-grams and what is abnormal come from all pages, and its rows with them."""
    rows, whole = table
    m, want = N.fit_pages(rows).model, T.fit(whole, N._collected(N.count_lines(rows)))
    assert len(want.ngrams) > 50 and m.prose == want.prose != T.prose_of(0, 0, 0)
    assert m.ngrams.items() <= want.ngrams.items()  # which keeps unseen ones too
    keywords = {"doc_id": 600, "url": "https://s.example/", "body": "coupon hotel tickets coupon casino shoes hotel loan coupon hotel tickets casino " * 6}
    assert [r.doc_id for r in K.stuffed_pages(rows.unionByName(rows.sparkSession.createDataFrame([keywords], "doc_id bigint, url string, body string"), allowMissingColumns=True)).collect()] == [600]


@pytest.mark.parametrize("odd", ["", "".join(map(chr, range(0x4E00, 0x4E60)))])
def test_grams_are_counted(odd):
    """Counts and sums over codes are those of the n-grams one by one, however many classes there are, and may be taken away."""
    strings = {"^^^lfCl.$": 3, "^^^ff$": 1, f"^^^l{odd}l.$": -1}
    want = Counter()
    for s, n in strings.items():
        for i in range(len(s) - 3):
            want[s[i : i + 4]] += n
    assert T.count_grams(strings) == want and T.count_grams({}) == {}
    m = T.PageModel(ngrams=T.gram_table({g: 5 for g in want}))
    x = [(n, round(T.STEP * T.surprise(m, s[3:-1]))) for s, n in strings.items()]
    assert T.surprise_sums(m.ngrams, strings.items()) == (3, sum(n * v for n, v in x), sum(n * v * v for n, v in x))


def test_lines_cut_in_the_first_pass_are_labelled(raw_pages, plain_pages, monkeypatch):
    """Problem 4 labels what the page model's first pass has cut, without reading the pages again, with the same rows as one that does."""
    rng = random.Random(4)
    texts = [(shuffled(lang, rng), lang) for lang in SPEECH for _ in range(6)]
    bodies = ["\r\n".join([x, "x", " ".join("1234567890123"), shuffled("de", rng)]) for x, _ in texts]
    pages = [{"doc_id": 700 + i, "url": "https://a.example/", "body": b, "language": (lang, None, "nl", "en")[i % 4]} for i, (b, (_, lang)) in enumerate(zip(bodies, texts))]
    rows = raw_pages(*plain_pages, *pages, pages[3], {"doc_id": 800, "body": "Ende", "language": "de"}, {"doc_id": 801, "body": None, "language": "de"})
    models = N.fit_pages(rows), G.fit_crf_pages(rows)
    seen = lambda lines: sorted((r.doc_id, r.line_no, r.lang, r.pieces, r.page_lang, r.stated, round(r.confidence, 6)) for r in lines.collect())
    for how in ({}, {"only_cases": True, "skip_stuffed": False}, {"skip_stuffed": False}):
        found = G.labelled_lines(rows, **how)
        got = seen(found)
        assert found.inputFiles() and all("line_facts" in f for f in found.inputFiles())
        assert got == seen(G.labelled_lines(rows, models, **how)) and (got or not how)
    assert {(d, i, n) for d, i, _, n, *_ in got} >= {(700, 1, len(texts[0][0].split())), (700, 3, 13)}
    monkeypatch.setattr(N, "BROADCAST_WORDS", 0)
    assert seen(G.labelled_lines(rows, skip_stuffed=False)) == got


def test_pages_are_cut_in_parts(monkeypatch):
    pages = [(i, "a", None, [f"der Turm {' '.join('abcdefghijkl')}", f"x {i}"], None, 0, "de" if i % 2 else None) for i in range(5)]
    monkeypatch.setattr(G, "CUT_PAGES", 2)
    cutter = G.Cutter()
    parts = [x for p in pages if (x := cutter.add(p))] + [cutter.rest()]
    assert [[x[0] for x in own] for _, own in parts] == [[0, 1], [2, 3], [4]] and cutter.rest()[1] == []
    cut = G.Cut.load(parts[1][0].dump())
    assert cut.stated.tolist() == [-1, G.LANGS.index("de")] and cut.number.tolist() == [1, 1] and cut.pieces.tolist() == [14]
    assert sum((G.count_cut(c, None) for c, _ in parts), Counter()) == G.count_words([(p[3], p[6]) for p in pages], None)
