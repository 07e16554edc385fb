"""Texts of many lines are cut up together, and only the lines that it takes are read."""

import random

import numpy as np

from gleaner.llm import p4_language as G, p5_stuffing as K, pagetext as T
from tests.llm.conftest import PROSE
from tests.llm.test_pages import SPEECH, shuffled

SIGNS = "aàéeœŒæÆnÑßẞşİΣlLyYoOÿŸšŠƒˆ \t\r\x0b\x85\x81\x9d\xa0’–“-x1<>&;"


def odd_lines(n: int) -> list[str]:
    rng = random.Random(5)
    return ["", "x", "a", *("".join(rng.choices(SIGNS, k=rng.randint(0, 12))) for _ in range(n)), *SPEECH.values()]


def test_words_cut_together_are_those_of_each_line():
    lines = odd_lines(3000)
    words, at, start = G.cut_words(lines)
    assert len(set(words)) == len(words) and [[words[i] for i in at[a:b]] for a, b in zip(start, start[1:])] == [G.line_words(x) for x in lines]
    assert G.cut_words([""])[2].tolist() == [0, 0] and G.cut_words([])[2].tolist() == [0]


def test_words_are_counted_without_a_look_at_each_line(monkeypatch):
    rng = random.Random(3)
    pages = [([shuffled(lang, rng), "x", "Ende der Seite"], lang) for lang in SPEECH for _ in range(20)]
    want = {}
    for lines, lang in pages:
        for w in G.line_words(lines[0]):
            at = w, G.LANGS.index(lang)
            want[at] = want.get(at, 0) + 1
    monkeypatch.setattr(G, "line_words", lambda x: 1 / 0)
    first = G.count_words(pages, None)
    assert first == want
    second = G.count_words(pages, G.train_counts(first))
    assert second["ende", G.LANGS.index("de")] >= 20 and all(n <= second[x] for x, n in first.items())
    assert G.count_words([], None) == G.count_words([(["x"], "de")], None) == G.count_words([(["ein Turm"], "nl")], G.Crf()) == {}


def test_votes_of_closed_class_words():
    lines = ["the tower of the town", "der Turm und die Stadt", "tower", "", "un de la"]
    assert G.lexicon_votes(*G.cut_words(lines)).tolist() == [0, 1, -1, -1, -1]


def test_posteriors_of_long_lines_stay_finite():
    """Values are brought back before a double can't hold them, whatever the moves."""
    rng = np.random.default_rng(1)
    emit, length = rng.normal(size=(6, 900, G.K)) * 9, np.array([900, 3, 900, 1, 400, 3])
    for scale in (0.1, 2.0, 30.0):
        moves = rng.normal(size=(G.K, G.K)) * scale
        assert np.allclose(G.posteriors(emit, moves, length), G.forward_backward(emit, moves, length)[0], atol=1e-8)


def test_stuffed_page_reads_only_the_lines_that_settle_it(plain_pages, monkeypatch):
    prose = [x.format("Oldham") for x in PROSE]
    m = T.fit([("a", p["headings"], p["body"], "en") for p in plain_pages])
    read = []
    monkeypatch.setattr(K, "read_line", lambda m, x, host: read.append(x) or T.read_line(m, x, host))
    menu = ["Home", "Contact", "Opening hours"] * 20
    assert not K.stuffed_page(m, [*menu[:6], *prose, *menu[:6]], "a", None) and 0 < len(read) < len(prose) + 1
    rng = random.Random(8)
    spam = "coupon hotel tickets casino shoes hotel loan".split()
    for _ in range(200):
        lines = [rng.choice([rng.choice(prose), " ".join(rng.choices(spam, k=rng.randint(3, 40))), "<b>&#97;</b> &#98; &#99;", *odd_lines(3)]) for _ in range(rng.randint(1, 8))]
        links = rng.choice([0, 3, 60])
        assert K.stuffed_page(m, lines, "a", None, links) == K.is_stuffed(m, [T.read_line(m, x, "a") for x in lines], None, links)[0]


def test_shapes_of_a_page_are_those_of_its_lines():
    lines, one, all_ = [*odd_lines(500), "<p>a&#10;b</p>", "Oldham mill"], T.Shapes(), T.Shapes()
    for host in ("oldham", ""):
        assert all_.of_page(lines, host) == [one.of(x, host) for x in lines] == all_.of_page(lines, host)


def test_lines_of_a_page_are_read_together(plain_pages, monkeypatch):
    m = T.fit([("a", p["headings"], p["body"], "en") for p in plain_pages])
    lines = [*plain_pages[0]["body"].split("\n"), *odd_lines(500), "<p>a&#10;b</p>", "Oldham mill"]
    want = {host: [T.weigh(m, T.shape(x, host), host) for x in lines] for host in ("oldham", "")}
    for host in ("oldham", "", "oldham"):
        m.seen.clear()
        assert T.read_page(m, lines, host) == want[host]
    cut = []
    monkeypatch.setattr(T, "lower_words", lambda x: cut.append(x) or ())
    m.seen.clear()
    T.read_page(m, plain_pages[0]["body"].split("\n"), "a")
    assert not cut


def test_smoothed_means_are_those_of_each_line():
    rng = random.Random(6)
    for n in range(9):
        ratio = [rng.uniform(-3.5, 3.5) for _ in range(n)]
        want = []
        for i in range(n):
            near = [(T._KERNEL[0], ratio[i]), *((T._KERNEL[abs(d)], ratio[i + d]) for d in (-2, -1, 1, 2) if 0 <= i + d < n)]
            total, weight = 0.0, 0.0
            for k, x in near:
                total, weight = total + k * x, weight + k
            want.append(total / weight)
        assert T.smoothed(ratio) == want
