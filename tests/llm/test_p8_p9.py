import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from gleaner.llm import p8_packing as P, p9_mixing as M, tokens as T
from tests.conftest import SMALL, same_rows


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, source string, tokens string, shard string")


def check(rows, sizes, sep, lengths):
    """Every text whole and once, unless it is larger than a container; no container too full."""
    boxes, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        boxes[r.container_id].append(r)
        pieces[r.doc_id].append((r.piece, r.start_token, r.end_token))
    for own in boxes.values():
        cap = own[0].capacity_tokens
        assert cap in lengths and sum(r.end_token - r.start_token for r in own) + sep * (len(own) - 1) <= cap
        assert sorted(r.position for r in own) == list(range(len(own)))
    assert set(pieces) == {d for d, n in sizes.items() if n}
    for d, ps in pieces.items():
        ps.sort()
        assert ps[0][1] == 0 and ps[-1][2] == sizes[d] and all(a[2] == b[1] for a, b in zip(ps, ps[1:]))
        assert len(ps) == 1 or sizes[d] > max(lengths)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_best_fit_places_all(histogram):
    placed = Counter()
    for length, pattern, count in P.best_fit(histogram, [8, 16, 30]):
        assert sum(s * n for s, n in pattern) <= length
        for s, n in pattern:
            placed[s] += n * count
    assert placed == Counter(histogram)


def test_fill():
    rng = random.Random(1)
    sizes = Counter(min(2048, int(rng.lognormvariate(5, 1)) + 1) for _ in range(20_000))
    groups = P.best_fit(sizes, [2048])
    used = sum(s * n for s, n in sizes.items())
    assert used / sum(length * n for length, _, n in groups) > 0.995
    joint = P.best_fit(sizes, [512, 2048])
    assert used / sum(length * n for length, _, n in joint) > 0.995


def test_pack(spark):
    rows = [(1, "word " * 40, "s"), (2, "one two three", "s"), (3, None, "s"), (4, "", "s"), (5, "alpha beta gamma delta", None), (None, "no id here", "s"), (7, "x" * 20_000, "s")]
    df = docs(spark, rows)
    sizes = {r.doc_id: r.tokens for r in T.sized(df.select("doc_id", "text")).collect()}
    got = P.pack(df, [("a", [16], 1), ("b", [8, 64], 0)]).collect()
    check([r for r in got if r.spec_id == "a"], sizes, 1, [16])
    check([r for r in got if r.spec_id == "b"], sizes, 0, [8, 64])
    assert P.pack(df.limit(0), [("a", [16], 1)]).count() == 0


def test_table(spark):
    sizes = {r.doc_id: r.tokens for r in T.sized(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    rows = P.p8_pack(spark, SMALL).collect()
    for name, cap, sep in P.read_specs(spark.read.parquet(f"{SMALL}/pack_specs.parquet")):
        check([r for r in rows if r.spec_id == name], sizes, sep, [cap])
    joint = P.p8_joint(spark, SMALL).collect()
    check(joint, sizes, 1, [512, 2048, 8192])
    assert all(0 < r.fill <= 1 for r in P.p8_report(spark, SMALL).collect())


def test_specs(spark):
    bad = spark.createDataFrame([("a", 5, None), ("a", 5, None), ("b", 0, 1), ("c", None, 1)], "spec_id string, capacity_tokens int, separator_tokens int")
    assert P.read_specs(bad) == [("a", 5, 0)]


def test_plan():
    got = {e["source"]: e for e in M.plan([("m", "a", 0.5, 2), ("m", "b", 0.25, 1), ("m", "none", 0.25, 1), ("m", "zero", None, 3)], {"a": 1000, "b": 100})}
    assert got["b"]["give"] == 100 and got["a"]["give"] == pytest.approx(1000) and got["none"]["give"] == 0 == got["zero"]["rate"]
    exact = {e["source"]: e["give"] for e in M.plan([("m", "a", 2.0, 1), ("m", "b", 1.0, 1)], {"a": 900, "b": 900}, 600)}
    assert exact == pytest.approx({"a": 400, "b": 200})
    assert M.plan([], {}) == []
    assert M.exact_size([("m", "a", 3.0, 1), ("m", "b", 1.0, 2), ("m", "none", 1.0, 2)], {"a": 900, "b": 100}) == 800
    assert M.exact_size([], {}) == 0


def test_flight_keeps_totals():
    rng = random.Random(2)
    prob, size = [rng.random() for _ in range(500)], [float(rng.randint(1, 900)) for _ in range(500)]
    want = sum(prob), sum(p * s for p, s in zip(prob, size))
    left = M.fly(prob, size, random.Random(3))
    assert len(left) <= 2 and all(p in (0.0, 1.0) for i, p in enumerate(prob) if i not in left)
    assert (sum(prob), sum(p * s for p, s in zip(prob, size))) == pytest.approx(want, rel=1e-6)
    assert M.fly([], [], random.Random(1)) == []
    same = [0.5] * 10
    assert len(M.fly(same, [4.0] * 10, random.Random(1))) <= 2 and sum(same) == pytest.approx(5)


def test_flight_is_fair():
    hits = Counter()
    for seed in range(600):
        prob = [0.3, 0.5, 0.7, 0.2, 0.3]
        M.fly(prob, [3.0, 5.0, 2.0, 8.0, 4.0], random.Random(seed))
        for i, p in enumerate(prob):
            hits[i] += p
    assert [hits[i] / 600 for i in range(5)] == pytest.approx([0.3, 0.5, 0.7, 0.2, 0.3], abs=0.06)


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, "word " * rng.randint(1, 60), "big") for i in range(300)] + [(1000 + i, "word " * 20, "small") for i in range(5)] + [(2000, None, "big"), (2001, "", "small"), (2002, "word", None)]
    targets = spark.createDataFrame([("m", "big", 0.6, 1), ("m", "small", 0.2, 4), ("m", "gone", 0.2, 4), (None, "big", 1.0, 1), ("n", "small", 1.0, 3)], "mix_id string, source string, target_share double, max_repeats int")
    used, shares = M.mix(docs(spark, rows), targets, shard_docs=40)
    uses = {(r.mix_id, r.doc_id): (r.uses, r.source) for r in used.collect()}
    assert len(uses) == used.count() and all(n <= {"big": 1, "small": 4 if m == "m" else 3}[s] for (m, _), (n, s) in uses.items())
    got = {(r.mix_id, r.source): r for r in shares.collect()}
    assert got["m", "gone"].reached_share == 0 and got["m", "small"].target_share == 0.25
    assert sum(r.reached_share for (m, _), r in got.items() if m == "m") == pytest.approx(1, abs=1e-5)
    used, shares = M.mix(docs(spark, rows), targets.where("mix_id = 'm'"), size=1200, shard_docs=40)
    got = {r.source: r.reached_share for r in shares.collect()}
    assert got["small"] == pytest.approx(0.25, abs=0.02)
    used, shares = M.mix(docs(spark, rows), targets.where("mix_id = 'm'"), size="exact", shard_docs=40)
    got = {r.source: r for r in shares.collect()}
    assert abs(got["small"].reached_share - 0.25) < 0.02 and got["small"].state == got["big"].state == "reached" and got["gone"].state == "absent"
    used, shares = M.mix(docs(spark, []), targets)
    assert used.count() == 0 and all(r.reached_share == 0 for r in shares.collect())


@pytest.mark.parametrize("module", [P, M])
def test_twins(spark, duck, module):
    for name, sql in module.ORACLE.items():
        same_rows(module.QUERIES[name](spark, SMALL), duck, sql)


def test_texts_without_an_id_are_spread(spark):
    """Many texts without an id don't make one shard, and each is placed once."""
    d = docs(spark, [(None, f"word {i}", "a") for i in range(400)] + [(i, "word", "a") for i in range(100)])
    rows = P.pack(d, [("s", [16], 1)], shard_docs=50).collect()
    shards = Counter(r.container_id.split("/")[1] for r in rows if r.doc_id is None)
    assert sum(shards.values()) == 400 and len(shards) == 10 and max(shards.values()) < 120


def test_invariants_see_faults(spark):
    """A container too full, a gap, an early cut and a half-empty container all show."""
    names = [c.split()[0] for c in P.SCHEMA.split(", ")]
    row = lambda box, d, piece, start, end: dict(zip(names, ("s", box, 10, 0, d, piece, start, end)))
    made = lambda *rows: P.invariants(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], P.SCHEMA), {"s": 1}).first()
    assert tuple(made(row("a", 1, 0, 0, 10), row("b", 2, 0, 0, 5), row("b", 3, 0, 0, 4))) == ("s", 3, 0, 0, 0, True)
    assert made(row("a", 1, 0, 0, 8), row("a", 2, 0, 0, 2)).over_full == 1
    assert made(row("a", 1, 0, 0, 8), row("b", 1, 1, 9, 12)).misplaced == 1
    assert made(row("a", 1, 0, 0, 4), row("b", 1, 1, 4, 8)).cut_too_early == 1
    assert made(row("a", 1, 0, 0, 4)).well_filled and made(row("a", 1, 0, 0, 4), row("b", 2, 0, 0, 4)).well_filled is False
