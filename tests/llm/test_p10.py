import re

from hypothesis import given, settings, strategies as st

from gleaner.llm import p10_repetition as P
from tests.conftest import SMALL, same_rows


def share(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    seen, hit = set(), set()
    for i in range(len(words) - 7):
        run = tuple(words[i : i + 8])
        if run in seen:
            hit.update(range(i, i + 8))
        seen.add(run)
    return len(hit) / len(words) if words else 0.0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), max_size=5))
def test_stretches(texts):
    texts = [" ".join(t) for t in texts]
    assert list(P.measure(texts)["stretch_share"]) == [share(t) for t in texts] if texts else True


def test_against_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert {r.doc_id for r in P.p10_found(spark, SMALL).collect()} == {r.doc_id for r in rows if share(r.text) >= 0.3}


def test_edges(spark):
    again = "one two three four five six seven eight. "
    rows = [(1, None), (2, ""), (3, again), (4, again * 2), (4, again * 2), (5, again.upper() + "1, 2 " + again), (None, again * 3), (6, "12 34 ..."), (7, "la " * 9)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id bigint, text string, bits int, words string")
    got = P.ledger(df)
    assert got.count() == len(rows)
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].words == by[2].words == by[6].words == 0 and by[1].bits == 0
    assert by[3].stretch_share == 0 and by[4].stretch_share == by[5].stretch_share == 0.5 and by[7].stretch_share == 8 / 9
    assert {r.doc_id for r in P.apply_policy(got, "stretch-1").collect()} == {4, 5, None, 7}
    assert P.ledger(df.limit(0)).count() == 0


def test_parts():
    m = P.measure(["a line\nanother line\na line", "Same. Same. Other one here."])
    assert round(m["line_share"][0], 3) == round(6 / 24, 3) and m["line_share"][1] == 0
    assert round(m["sentence_share"][1], 3) == round(4 / 23, 3)


def test_ablation(spark):
    book = spark.createDataFrame([(1, 0b0001), (2, 0b0011), (3, 0b0010), (4, 0)], "doc_id bigint, bits int")
    got = {(r.policy, r.rule): (r.rejected, r.only_by_rule) for r in P.ablation(book).collect()}
    assert got["all-1", "stretch8"] == (3, 1) and got["all-1", "line_dup"] == (3, 1) and got["stretch-1", "stretch8"] == (2, 2)


def test_very_long():
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(300_000))
    m = P.measure([text])
    assert m["words"][0] == 300_000 and m["stretch_share"][0] > 0.9


def test_twin(spark, duck):
    same_rows(P.p10_found(spark, SMALL), duck, P.ORACLE["p10_found"])
