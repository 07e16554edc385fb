import random

import pytest

from gleaner.llm import p2_mojibake as P
from tests.conftest import SMALL

TEXTS = {
    "de": "Für die Gäste öffnet die Brücke früh. Die Mühle schützt große Wiesen, und das „Schloss“ überragt die Dächer – für 4 €.",
    "fr": "À la fin de l’été, la bibliothèque célèbre près du château plaît aux élèves. Où êtes-vous né ? Très bientôt, hélas.",
    "es": "El año pasado la panadería también abrió después de la crecida. ¿Dónde está el niño pequeño? Aquí, según María.",
}
SWAPS = [("utf-8", "cp1252"), ("utf-8", "latin_1"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"), ("utf-8", "iso8859_2"), ("cp1252", "mac_roman")]


def garble(text, true, page):
    return "".join(P._read(c.encode(true), page) if not c.isascii() else c for c in text)


@pytest.fixture(scope="module")
def lm():
    rng = random.Random(3)
    return P.Bigrams([" ".join(rng.sample(t.split(), len(t.split()))) for t in TEXTS.values() for _ in range(40)])


@pytest.mark.parametrize("true,page", SWAPS)
@pytest.mark.parametrize("lang", TEXTS)
def test_round_trip(lm, lang, true, page):
    broken = garble(TEXTS[lang], true, page)
    assert P.suspicious(broken) and not P.suspicious(TEXTS[lang])
    table = P.learn_table([(*k, n) for k, n in P.occurrences(broken).items()], lm)
    back = P.repair_text(broken, {u: t for u, (t, _) in table.items() if u != t})
    wrong = sum(a != b for a, b in zip(back, TEXTS[lang])) + abs(len(back) - len(TEXTS[lang]))
    assert wrong <= 2


UNLISTED = ["koi8_r", "cp737", "cp866", "iso8859_5", "mac_cyrillic", "cp855", "iso8859_7"]


@pytest.mark.parametrize("page", UNLISTED)
@pytest.mark.parametrize("lang", TEXTS)
def test_unlisted_pages(lm, lang, page):
    """Swaps that no list names are learned from their contexts alone."""
    words = TEXTS[lang].split()
    text = " ".join(w for k in range(4) for w in random.Random(k).sample(words, len(words)))
    broken = garble(text, "utf-8", page)
    table = P.learn_table([(*k, n) for k, n in P.occurrences(broken).items()], lm)
    back = P.repair_text(broken, {u: t for u, (t, _) in table.items() if u != t})
    letters = lambda x: [w for w in x.split() if any(c.isalpha() and not c.isascii() for c in w)]
    right = sum(w in back.split() for w in letters(text))
    assert right >= 0.7 * len(letters(text)), (right, len(letters(text)), back)


def test_one_byte_pages(lm):
    """Latin-1 read as Cyrillic: one sign a letter."""
    broken = garble(TEXTS["de"].replace("„", "").replace("“", "").replace("–", "").replace("€", ""), "latin_1", "koi8_r")
    table = P.learn_table([(*k, n) for k, n in P.occurrences(broken).items()], lm)
    assert "Brücke" in P.repair_text(broken, {u: t for u, (t, _) in table.items() if u != t})


def test_splitting_runs():
    assert P.lead_signs(P.Counter({"ц╪": 5, "ц╤ц÷": 2, "б╚": 1})) == {"ц", "б"} and P.lead_signs(P.Counter({"я": 3, "яю": 1})) == set()
    assert P.letters_of("ц╤ц÷", {"ц"}) == ["ц╤", "ц÷"] and P.letters_of("яю", set()) == ["я", "ю"] and P.letters_of("цц", {"ц"}) == ["цц"]


def test_units_hold_no_ascii():
    assert all(not c.isascii() for u in P.units() for c in u)


def test_twice(lm):
    broken = garble(garble(TEXTS["de"], "utf-8", "cp1252"), "utf-8", "cp1252")
    assert P.readable(broken) == TEXTS["de"]
    assert P.readable(TEXTS["fr"]) == TEXTS["fr"]


CLEAN = [
    "The sign reads SÃO BENTO DO VALE and ÂMBAR, names from overseas.", "The tree runs ├── plans │ └── photos and is kept.", "A label says музей and сад, from abroad.",
    "Old files list the town as “TÃ¼bingen” for a reason.", "In România the word mâine and the letter Ă puzzled them.", "Ça va, Œuvre, ÉTÉ, Ñandú, Straße", "", None,
    "Dvořák came from Łódź by Škoda, the α-helix and 5 kΩ were noted, Москва and Ἀθῆναι too.", "The iPhone手机 and the PC電腦 and the TVテレビ, the iPhone手机.",
]


def test_found(raw_pages, lm):
    rows = [{"doc_id": i, "url": "https://a.example/", "title": "x", "body": t} for i, t in enumerate(CLEAN)]
    rows += [{"doc_id": 100, "url": None, "title": garble("Brücke", "utf-8", "cp1252"), "body": TEXTS["de"]}, {"doc_id": 101, "url": "https://a.example/", "title": None, "body": TEXTS["de"].replace("ü", "�")}]
    rows += [{"doc_id": 102, "url": "https://b.example/", "title": "Br¸cke", "body": garble(TEXTS["fr"], "cp1252", "mac_roman")}, rows[-1], {"doc_id": None, "title": "TÃ¼bingen"}]
    got = {(r.doc_id, r.field): r.repairable for r in P.garbled_fields(raw_pages(*rows), lm).collect()}
    assert got == {(100, "title"): True, (101, "body"): False, (102, "title"): True, (102, "body"): True}
    out = {r.doc_id: r for r in P.repaired(raw_pages(*rows), lm).collect()}
    assert out[100].fixed_title == "Brücke" and out[100].fixed_body == TEXTS["de"] and out[101].fixed_body == rows[11]["body"]
    assert out[102].fixed_title == "Brücke" and [out[i].fixed_body for i in range(10)] == CLEAN
    assert P.repaired(raw_pages(*rows), lm).count() == len(rows)


@pytest.mark.parametrize("mark", "–“")
def test_marks_in_a_row(raw_pages, lm, mark):
    for n in (3, 4, 40):
        text = f"The end {mark * n} of it."
        broken = garble(text, "utf-8", "cp1252")
        assert P.suspicious(broken) and not P.suspicious(text) and P.readable(broken) == text
        assert P.garbled_fields(raw_pages({"doc_id": 1, "url": "https://a.example/", "body": broken}), lm).count() == 1


def test_bigrams_of_all_fields(raw_pages):
    """Every clean field counts, titles too; garbled ones don't."""
    rows = [{"doc_id": i, "url": "https://a.example/", "title": "ñu" if i == 7 else None, "body": "x" + chr(97 + i % 26) + chr(97 + i // 26)} for i in range(60)]
    got = P.fit_bigrams(raw_pages(*rows, {"doc_id": 99, "body": garble("Brücke", "utf-8", "cp1252")}, {"doc_id": 98}))
    assert got.table == P.Bigrams([t for r in rows for t in (r["title"], r["body"]) if t]).table and ("ñ", "u") in got.table
    assert P.fit_bigrams(raw_pages()).table == {}


def test_empty(raw_pages, lm):
    assert P.garbled_fields(raw_pages(), lm).count() == 0 and P.repaired(raw_pages(), lm).count() == 0


def test_long(lm):
    text = "Die Brücke ist alt. " * 50_000
    assert not P.suspicious(text)
    assert P.readable(garble(text, "utf-8", "cp1252")) == text


def test_table(spark):
    assert P.p2_found(spark, SMALL).columns == ["doc_id", "field"]
