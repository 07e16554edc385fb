"""Problems 3, 4 and 5, which share the page model."""

import random

import numpy as np
import pytest
from hypothesis import given, strategies as st

from gleaner.llm import p3_boilerplate as B, p4_language as G, p5_stuffing as K, pagescan as N, pagetext as T
from gleaner.llm.lexicon import label_language
from tests.llm.conftest import PROSE


def sample(pages):
    return [(p["url"].split(".")[-2].rpartition("/")[2], p["headings"], p["body"], p["language"]) for p in pages]


@pytest.fixture(scope="module")
def model(plain_pages):
    return T.fit(sample(plain_pages))


@pytest.fixture(scope="module")
def fitted(model):
    return N.Fitted(model)


def read(m, lines, host=""):
    return [T.read_line(m, x, host) for x in lines]


def stuffed(m, lines, links=0):
    return K.is_stuffed(m, read(m, lines), None, links)


def test_lines(fitted, plain_pages, raw_pages):
    pages = plain_pages[:3] + [plain_pages[0], {"doc_id": 90, "body": None}, {"doc_id": 91, "body": ""}, {"doc_id": 92, "body": "* * *\n12\n\n"}, {"doc_id": None, "body": "x"}]
    got = {}
    for r in B.boilerplate_lines(raw_pages(*pages), fitted).collect():
        got.setdefault(r.doc_id, []).append(r.line_no)
    assert {d: sorted(v) for d, v in got.items()} == {i: [1, 7, 8, 9, 10] for i in range(3)}
    assert B.boilerplate_lines(raw_pages(), fitted).count() == 0


def test_null_headings_and_links(fitted, plain_pages, raw_pages):
    page = plain_pages[5] | {"headings": None, "url": None}
    assert sorted(r.line_no for r in B.boilerplate_lines(raw_pages(page), fitted).collect()) == [1, 7, 8, 9, 10]
    out = B.main_text(raw_pages(page, {"doc_id": 3, "body": None}), fitted).collect()
    assert len(out) == 1 and out[0].main_text.startswith("The tower of") and out[0].kept_lines == 5


def test_markup_and_regions(model):
    assert T.parse_line("a <b>c</b> &amp; d") == ("a c & d", 2)
    assert T.core("» Contact >") == ("Contact", 3) and T.core("Read on" + " " * 60 + "[more]" + " " * 60) == ("Read on", 2)
    assert T.core("a ... b [not a mark]") == ("a ... b [not a mark]", 0) and T.core("and so on ...") == ("and so on", 2)
    assert T.regions([-3, -3, 3, 2.8, 0.4, 3.1, -3, 0.4, -3]) == [False, False, True, True, True, True, False, False, False]
    assert T.regions([]) == []


@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x2FF), st.sampled_from("“”„’–—…€™†ŒœŸŽžŠš�ж")), max_size=60))
def test_words_by_bytes(text):
    assert T.lower_words(text) == tuple(T.WORD.findall(text.lower()))
    assert T.class_string(text) == "".join(map(T.word_class, T.TOKEN.findall(text)))


def test_clusters_decide(model, plain_pages):
    """Without smoothing and clusters nothing is labelled; a short line goes with its surroundings."""
    page, host = plain_pages[0], "site0"
    lines = page["body"].split("\n")
    at = lambda i: T.label_lines(model, read(model, [*lines[:i], "old mill Ortaz", *lines[i:]], host), page["headings"])[i]
    assert at(4) == 0 and at(len(lines)) == 1
    bare = [model.lines.keys, T.page_ratios(model, read(model, lines, host), page["headings"])]
    assert bare[1] and T.regions(bare[1], model.centres) == [not x for x in T.label_lines(model, read(model, lines, host), page["headings"])]


def test_known_lines_by_join(raw_pages, plain_pages, monkeypatch):
    """Where the repeated lines are too many to be broadcast, each page comes with its own: same rows."""
    odd = [{"doc_id": 700 + i, "url": f"https://a{i % 3}.example/", "body": "Gläserne Klappe\nGl�serne Klappe\nTopics: mill, tower\nHome > Tower > Mill" if i < 9 else ""} for i in range(10)]
    rows = raw_pages(*plain_pages, *odd, odd[0], {"doc_id": 800, "body": "one lonely line"})
    want = {f: sorted(map(tuple, f(rows).collect())) for f in (B.boilerplate_lines, B.main_text, K.stuffed_pages)}
    assert want[B.boilerplate_lines]
    monkeypatch.setattr(N, "BROADCAST_LINES", 0)
    monkeypatch.setattr(N, "BROADCAST_IDS", 0)
    monkeypatch.setattr(N, "HELD", 3)
    for f, x in want.items():
        assert sorted(map(tuple, f(rows).collect())) == x


KEYWORDS = [
    "coupon hotel tickets coupon casino shoes hotel loan coupon hotel tickets casino casino shoes loan hotel " * 6,
    "\n".join(f">> hotel tickets Ort{c}x" for c in "abcdefghijklmnopq"),
    " ".join(f"#coupon{c}x #hotel #shoes" for c in "abcdefghijklm"),
    "; ".join(f"loan Ort{c}y" for c in "abcdefghijklm"),
]


def test_stuffed(fitted, plain_pages, raw_pages):
    bad = [{"doc_id": 200 + i, "url": "https://s.example/", "body": "Home | Contact | Opening hours | Search\n" + k + "\nAll rights reserved"} for i, k in enumerate(KEYWORDS)]
    lists = plain_pages[0] | {"doc_id": 300, "body": plain_pages[0]["body"] + "\n" + "\n".join(f"* old mill Ort{c}z" for c in "abcdefghij")}
    few = {"doc_id": 301, "url": "https://s.example/", "body": "hotel coupon"}
    got = {r.doc_id: r.share for r in K.stuffed_pages(raw_pages(*plain_pages[:5], *bad, bad[0], lists, few, {"doc_id": 302}), fitted).collect()}
    assert set(got) == {200, 201, 202, 203} and min(got.values()) > 0.5
    assert K.stuffed_pages(raw_pages(), fitted).count() == 0
    assert {r.doc_id for r in B.boilerplate_lines(raw_pages(*bad), fitted).collect()} == set()


def test_stuffed_beside_notices(model, plain_pages):
    """Boilerplate sentences outweigh the page's own keywords and may not speak for them, nor may tags without spaces."""
    notices = [f"The {x} of Nowhere stands beside the notice and it is open to all members in spring." for x in ("form", "list", "map", "plan", "shop", "fund")]
    m = T.fit(sample([p | {"body": "\n".join([*notices, p["body"]])} for p in plain_pages]))
    lines = [*notices, *KEYWORDS[0].strip().rsplit(" ", 30)[:1]]
    assert all(x.strong and not x.opens for x in read(m, notices))
    assert stuffed(m, lines)[0] and stuffed(m, lines[6:])[2] == 1.0
    tags = "".join(f"#hotel#shoes#coupon{c}x" for c in "abcdefghijklmnop")
    prose = "The old tower stands beside the river and it is open to all visitors in spring."
    assert stuffed(model, [prose, tags])[0]


def test_links_weigh_a_little(model):
    """Many links tip a page that is half keywords, but don't make a case of a page of sentences."""
    prose = "The old tower stands beside the river and it is open to all visitors in spring."
    words = "hotel tickets coupon casino shoes loan hotel coupon casino shoes tickets loan hotel shoes"
    assert not stuffed(model, [prose, words])[0] and stuffed(model, [prose, words], 60)[0]
    assert not stuffed(model, [prose] * 3, 70)[0]


def test_short_lines_are_scored(model):
    """A heap of few words is abnormal by its perplexity, a short sentence isn't."""
    assert all(K.abnormal(model, T.class_string(x)) for x in ("hotel tickets Ortaz", "hotel", "#loan #shoes"))
    assert not K.abnormal(model, T.class_string("The old tower is open to all visitors."))


def test_repeats_are_counted_over_all_pages(raw_pages, plain_pages, monkeypatch):
    """A small site's menu line outside the sample is known as repeated; four documents or one delivered again don't do."""
    pages = [p | {"doc_id": 50 + p["doc_id"]} for p in plain_pages[:20]]
    rare = [{"doc_id": i, "url": "https://small.example/x", "body": "Gläserne Klappe\nPrices Ünder Guarantee" if i < 4 else "Gläserne Klappe"} for i in range(5)]
    rows = raw_pages(*pages, *rare, rare[0], rare[0])
    monkeypatch.setattr(N, "sample_pages", lambda _: sample(pages))
    m = N.fit_pages(rows).model
    lines = m.lines
    assert T.hashed("gläserne klappe") in lines.keys and T.hashed("prices ünder guarantee") not in lines.keys
    assert T.hashed("related pages") in lines.openers and T.hashed("the tower of placeaa") not in lines.keys
    assert read(m, ["Gl�serne Klappe"], "small")[0].strong
    tables, alone = N._collected(N.count_lines(raw_pages(*pages))), T.count_sample(sample(pages))
    assert tables == alone and len(tables.keys) and T.hashed("related pages") in T.Hashes(tables.keys) and 5 not in T.Hashes(tables.keys)
    assert N.count_lines(raw_pages()).count() == 0


def test_long_repeated_line(plain_pages):
    """A notice of more than 40 words on one line is known by its key, and isn't taken for a paragraph in the fit."""
    notice = " ".join(PROSE[0].format("Nowhere") for _ in range(2))
    assert len(notice.split()) > 40
    m = T.fit(sample([p | {"body": p["body"] + "\n" + notice} for p in plain_pages]))
    lines = read(m, [*plain_pages[0]["body"].split("\n"), notice], "site0")
    got = T.label_lines(m, lines, plain_pages[0]["headings"])
    assert got[2:6] == [0] * 4 and got[-1] == 1


SPEECH = {
    "en": "the old tower of the town is open to visitors and it stands beside the river with its garden",
    "de": "der alte Turm der Stadt ist für die Gäste offen und er steht neben dem Fluss mit seinem Garten",
    "fr": "la vieille tour de la ville est ouverte aux visiteurs et elle se trouve près du fleuve avec son jardin",
    "es": "la vieja torre de la ciudad está abierta a los visitantes y está cerca del río con su jardín",
    "it": "la vecchia torre della città è aperta ai visitatori e si trova vicino al fiume con il suo giardino",
}


def shuffled(lang, rng):
    words = SPEECH[lang].split()
    return " ".join(rng.choice(words) for _ in range(18))


@pytest.fixture(scope="module")
def crf():
    rng = random.Random(1)
    return G.fit_crf([("", [], "\n".join(shuffled(lang, rng) for _ in range(6)), lang if i % 10 else "en") for i in range(20) for lang in SPEECH])


def test_held_out(crf):
    rng = random.Random(2)
    lines = [(lang, G.line_words(shuffled(lang, rng))) for lang in SPEECH for _ in range(40)]
    langs, sure = G.label(crf, [w for _, w in lines])
    assert np.mean([G.LANGS[k] == lang for k, (lang, _) in zip(langs, lines)]) > 0.97 and sure.min() > 0.3
    langs, sure = G.label(crf, [[], ["xyz"]])
    assert sure[0] == 0.0 and len(langs) == 2


def test_words_beyond_the_bound(crf, monkeypatch):
    """Lines labelled before the word cache is full keep their words' scores."""
    rng = random.Random(6)
    lines = [G.line_words(shuffled(lang, rng)) for lang in SPEECH for _ in range(20)]
    crf.known.clear()
    whole = G.label(crf, lines)
    crf.known.clear()
    monkeypatch.setattr(G, "KNOWN", 30)
    for _ in range(2):
        part = G.label(crf, lines)
        assert (part[0] == whole[0]).all() and np.allclose(part[1], whole[1])
    assert len(crf.known) == len({w for x in lines for w in x})


def test_forward_backward_is_exact():
    rng = np.random.default_rng(5)
    emit, moves, length = rng.normal(size=(3, 4, 5)), rng.normal(size=(5, 5)), np.array([4, 2, 1])
    post, pair = G.forward_backward(emit, moves, length)
    assert np.allclose(post, G.posteriors(emit, moves, length))
    expected = np.zeros((5, 5))
    for i, n in enumerate(length):
        weight = {}
        for path in np.ndindex(*(5,) * n):
            weight[path] = np.exp(sum(emit[i, t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        z = sum(weight.values())
        for t in range(n):
            for k in range(5):
                assert abs(post[i, t, k] - sum(w for p, w in weight.items() if p[t] == k) / z) < 1e-9
        for p, w in weight.items():
            for a, b in zip(p, p[1:]):
                expected[a, b] += w / z
    assert np.allclose(pair, expected)


@pytest.mark.parametrize("tag,want", [(None, ""), ("", ""), ("und", ""), ("n/a", ""), (" Unknown ", ""), ("EN", "en"), ("de_AT", "de"), ("fr-FR", "fr"), ("German", "de"), ("spa", "es"), ("nl", "?"), ("Italiano", "it")])
def test_labels(tag, want):
    assert label_language(tag) == want


def test_wrong_labels(fitted, crf, raw_pages):
    rng = random.Random(4)
    body = "\n".join([shuffled("de", rng), "kurz", "", shuffled("de", rng), shuffled("fr", rng)])
    rows = [{"doc_id": i, "url": "https://a.example/", "body": body, "language": tag} for i, tag in enumerate(("de", "DE-at", None, "en", "nl"))]
    rows += [rows[0], {"doc_id": 9, "body": None}, {"doc_id": 10, "body": "zu kurz", "language": None}, {"doc_id": None, "body": body}]
    lines = G.labelled_lines(raw_pages(*rows), (fitted, crf), skip_stuffed=False)
    got = sorted(tuple(r) for r in G.wrong_labels(lines).collect())
    assert got == sorted([(i, 5, "fr") for i in range(5)] + [(i, 0, "de") for i in (2, 3, 4)])
    assert all(0 < r.confidence <= 1 for r in lines.collect())
    cases = G.labelled_lines(raw_pages(*rows, {"doc_id": 20, "url": "https://a.example/", "body": shuffled("de", rng), "language": "de"}), (fitted, crf), skip_stuffed=False, only_cases=True)
    assert sorted(tuple(r) for r in G.wrong_labels(cases).collect()) == got and cases.where("doc_id = 20").count() == 0
    runs = [(r.doc_id, r.first_line, r.last_line, r.lang) for r in G.segments(raw_pages(rows[0]), (fitted, crf), skip_stuffed=False).orderBy("first_line").collect()]
    assert runs == [(0, 1, 4, "de"), (0, 5, 5, "fr")]
    assert G.labelled_lines(raw_pages(), (fitted, crf)).count() == 0


def test_switches_inside_lines(crf, raw_pages, fitted):
    """A foreign stretch inside one line is found with its words; lines of one language and short slips give none."""
    rng = random.Random(8)
    de, fr = [shuffled("de", rng) for _ in range(2)], SPEECH["fr"].split()[:9]
    rows = [{"doc_id": 1, "url": "https://a.example/", "body": f"{de[0]} {' '.join(fr)} {de[1]}\n\n{de[0]}"}, {"doc_id": 2, "body": de[1]}, {"doc_id": 3, "body": None}, {"doc_id": None, "body": de[0]}]
    got = [tuple(r) for r in G.switches(raw_pages(*rows, rows[0]), (fitted, crf)).collect()]
    words = G.line_words(rows[0]["body"].split("\n")[0])
    assert len(got) == 1 and got[0][:2] == (1, 1) and got[0][4] == "fr" and 0.5 < got[0][5] <= 1
    found = set(words[got[0][2] - 1 : got[0][3]])
    assert len(found & set(G.line_words(" ".join(fr)))) >= 6 and got[0][3] - got[0][2] <= 11
    assert G.switches(raw_pages(), (fitted, crf)).count() == 0


def test_fitting_on_nothing(raw_pages):
    assert T.sample_pages(raw_pages()) == []
    empty = T.fit([])
    assert B.boilerplate_lines(raw_pages({"doc_id": 1, "body": "a line of words"}), N.Fitted(empty)).count() >= 0
    assert G.label(G.fit_crf([]), [["a"]])[0].shape == (1,)


def test_sample_is_bounded(raw_pages, plain_pages):
    got = T.sample_pages(raw_pages(*plain_pages), 7)
    assert len(got) == 7 and got == T.sample_pages(raw_pages(*plain_pages[::-1]), 7)


def test_long_texts(model):
    for text in ("a " * 200_000, "." * 100_000 + "x", " " * 200_000 + "x", "word. " * 100_000, "x" * 500_000):
        T.label_lines(model, read(model, [text]), None)
        stuffed(model, [text])
