"""Problem 9: mixing sources to target weights, by the cube method.

*Plan.* A mix's targets are scaled to the sources that have text. Each source is to give ``min(cap, share * z)`` tokens,
where its cap is its tokens times ``max_repeats`` and z is raised until the mix reaches its size (by default the tokens
of all its sources together); what capped sources can't give is spread over the others in proportion to their shares.

*Sampling.* A source's texts are used r = tokens to give / tokens times: floor(r) times each, and once more for a
balanced sample with inclusion probability r - floor(r). The cube method moves the vector of probabilities through the
null space of the constraints (tokens and number of texts of the sample) until all but a few entries are 0 or 1: three
texts at a time, two constraints, so there is always one direction to go. Sources are flown in shards of bounded size,
what is left of the shards is flown again together, and the last two or three entries (the landing problem) are
rounded so that the tokens come out closest. Large texts are decided first, so those entries are small ones.
"""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.tokens import VOCABULARY, sized
from gleaner.session import materialize

#: Texts in a shard of the flight, about; rows of the target table that are taken to the driver at most.
SHARD = 20_000
MAX_TARGETS = 100_000
#: How close to 0 or 1 a probability counts as decided.
EPS = 1e-9


def plan(targets: list[tuple[str, str, float, int]], stats: dict[str, int], size: int | None = None) -> list[dict]:
    """For each (mix, source, share, max_repeats): normalised share, cap, tokens to give and the rate of use.

    Sources without tokens give nothing and their share goes to the others; null or negative shares and repeats count as
    0. Of repeated entries of a source in a mix the shares add up and the least repeats hold.
    """
    mixes: dict[str, dict[str, list]] = defaultdict(dict)
    for mix, source, share, repeats in targets:
        have = mixes[mix].setdefault(source, [0.0, math.inf])
        have[0] += max(0.0, share or 0.0)
        have[1] = min(have[1], max(0, repeats or 0))
    out = []
    for mix, sources in sorted(mixes.items()):
        live = {s: (w, min(r, 1 << 30) * stats.get(s, 0)) for s, (w, r) in sources.items() if w > 0 and r > 0 and stats.get(s, 0) > 0}
        total_share = sum(w for w, _ in live.values())
        goal = min(size or sum(stats[s] for s in live), sum(c for _, c in live.values()))
        free, rest, give = dict(live), float(goal), {}
        while free:
            z = rest / sum(w for w, _ in free.values())
            full = [s for s, (w, cap) in free.items() if w * z >= cap]
            if not full:
                give |= {s: w * z for s, (w, _) in free.items()}
                break
            for s in full:
                give[s] = float(free.pop(s)[1])
                rest -= give[s]
        for s, (w, r) in sorted(sources.items()):
            tokens = stats.get(s, 0)
            out.append({"mix_id": mix, "source": s, "target": w / total_share if s in live else 0.0, "stated": w, "give": give.get(s, 0.0), "rate": min(give.get(s, 0.0) / tokens, float(r)) if tokens else 0.0})
    return out


def exact_size(targets: list[tuple[str, str, float, int]], stats: dict[str, int]) -> int:
    """The largest size at which every mix meets its targets, over the sources that have text: the scarcest source's cap
    divided by its share."""
    most = math.inf
    for e in plan(targets, stats):
        if e["target"] > 0:
            repeats = min(r or 0 for m, s, _, r in targets if (m, s) == (e["mix_id"], e["source"]))
            most = min(most, repeats * stats[e["source"]] / e["target"])
    return 0 if most is math.inf else int(most)


def fly(prob: list[float], size: list[float], rng: random.Random) -> list[int]:
    """The flight phase, in place: moves ``prob`` while three entries lie strictly between 0 and 1, keeping the sums of
    prob and of prob * size. Returns the entries that are left."""
    todo = list(range(len(prob) - 1, -1, -1))
    hand: list[int] = []
    while True:
        while len(hand) < 3 and todo:
            i = todo.pop()
            if EPS < prob[i] < 1 - EPS:
                hand.append(i)
            else:
                prob[i] = float(round(prob[i]))
        if len(hand) < 3:
            return hand
        i, j, k = hand
        u = (size[k] - size[j], size[i] - size[k], size[j] - size[i])  # orthogonal to (1, 1, 1) and the sizes
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((((1 - prob[x]) if d > 0 else -prob[x]) / d for x, d in zip(hand, u) if d), default=0.0)
        down = min((((1 - prob[x]) if d < 0 else -prob[x]) / -d for x, d in zip(hand, u) if d), default=0.0)
        step = up if rng.random() * (up + down) < down else -down
        for x, d in zip(hand, u):
            prob[x] = min(1.0, max(0.0, prob[x] + step * d))
        kept = [x for x in hand if EPS < prob[x] < 1 - EPS]
        for x in hand:
            if x not in kept:
                prob[x] = float(round(prob[x]))
        hand = kept if len(kept) < 3 else kept[:2]


def land(prob: list[float], size: list[float]) -> list[int]:
    """Round the last few entries: the 0/1 choice whose tokens come closest to the expected ones, then whose number does."""
    want, count = sum(p * s for p, s in zip(prob, size)), sum(prob)
    best = min(range(1 << len(prob)), key=lambda c: (abs(sum(s for b, s in enumerate(size) if c >> b & 1) - want), abs(bin(c).count("1") - count), c))
    return [best >> b & 1 for b in range(len(prob))]


def mix(documents: DataFrame, targets: DataFrame, size: int | str | None = None, vocabulary: str = VOCABULARY, shard_docs: int = SHARD, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The mixes and their shares.

    First: (mix_id, source, doc_id, tokens, uses), every text that a mix uses, at most ``max_repeats`` times. Second:
    (mix_id, source, stated_share, target_share, reached_share, state, tokens, texts, uses), where the state is ``reached``
    (within a point of the target), ``above`` (it took what others couldn't give), ``capped`` or ``absent``. ``size`` is in
    tokens, None for all tokens of a mix's sources, or ``exact`` for the largest size that meets all targets. Texts without tokens, source or id are
    never used; sources without text have a reached share of 0.
    """
    spark = documents.sparkSession
    rows = targets.where("mix_id is not null and source is not null").select("mix_id", "source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    docs = materialize(sized(documents.where("source is not null and doc_id is not null"), keep=("doc_id", "source"), vocabulary=vocabulary).where("tokens > 0"), "sizes")
    asked = sorted({r[1] for r in rows})
    wanted = F.col("source").isin(asked) if asked else F.lit(False)
    stats = {r[0]: (int(r[1]), int(r[2])) for r in docs.where(wanted).groupBy("source").agg(F.sum("tokens"), F.count(F.lit(1))).collect()}
    have = {s: t for s, (t, _) in stats.items()}
    asked_for = [tuple(r) for r in rows]
    if size == "exact":  # each mix by its own scarcest source
        each = [[r for r in asked_for if r[0] == m] for m in sorted({r[0] for r in rows})]
        entries = [e for own in each for e in plan(own, have, exact_size(own, have) or None)]
    else:
        entries = plan(asked_for, have, size)
    table = [(e["mix_id"], e["source"], float(math.floor(e["rate"] + EPS)), max(0.0, e["rate"] - math.floor(e["rate"] + EPS)), max(1, round(stats[e["source"]][1] / shard_docs))) for e in entries if e["rate"] > 0]
    rates = spark.createDataFrame(table, "mix_id string, source string, base double, p double, shards int")
    units = docs.join(F.broadcast(rates), "source").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("shards")))

    def start(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[float], list[float], random.Random]:
        # the largest texts are decided first, so that the few entries which are left to be rounded are small
        pdf = pdf.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        rng = random.Random(f"{seed} {pdf.mix_id.iloc[0]} {pdf.source.iloc[0]} {pdf.shard.iloc[0]}")
        return pdf, pdf.p.tolist(), pdf.tokens.astype(float).tolist(), rng

    columns = ["mix_id", "source", "doc_id", "tokens", "base", "p", "shard"]
    schema = "mix_id string, source string, doc_id bigint, tokens bigint, base double, p double, shard bigint"

    def flight(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, prob, sizes, rng = start(pdf)
        fly(prob, sizes, rng)
        pdf["p"] = prob
        return pdf[columns]

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, prob, sizes, rng = start(pdf)
        left = fly(prob, sizes, rng)
        for i, x in zip(left, land([prob[i] for i in left], [sizes[i] for i in left])):
            prob[i] = float(x)
        pdf["p"] = prob
        return pdf[columns]

    flown = materialize(units.select(*columns[:6], F.col("shard").cast("bigint").alias("shard")).groupBy("mix_id", "source", "shard").applyInPandas(flight, schema), "flown")
    done, open_ = [flown.where("p = 0 or p = 1")], flown.where("p > 0 and p < 1")
    most = max((t[4] for t in table), default=1)
    while most * 3 > shard_docs:  # at most two texts a shard are left, so this soon ends
        most = max(1, most * 3 // shard_docs)
        flown = materialize(open_.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(most)), F.lit(most))).groupBy("mix_id", "source", "shard").applyInPandas(flight, schema), "flown")
        done.append(flown.where("p = 0 or p = 1"))
        open_ = flown.where("p > 0 and p < 1")
    done.append(open_.withColumn("shard", F.lit(-1).cast("bigint")).groupBy("mix_id", "source").applyInPandas(last, schema))
    decided = done[0]
    for d in done[1:]:
        decided = decided.unionByName(d)
    used = materialize(decided.select("mix_id", "source", "doc_id", "tokens", (F.col("base") + F.col("p")).cast("int").alias("uses")).where("uses > 0"), "mix")
    goals = spark.createDataFrame([(e["mix_id"], e["source"], e["stated"], e["target"]) for e in entries], "mix_id string, source string, stated_share double, target_share double")
    sums = used.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("texts"), F.sum("uses").alias("uses"))
    whole = sums.groupBy("mix_id").agg(F.sum("tokens").alias("whole"))
    reached = F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0))
    state = F.when(F.col("target_share") == 0, "absent").when(F.abs(reached - F.col("target_share")) <= 0.01, "reached").when(reached > F.col("target_share"), "above").otherwise("capped")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    shares = (
        goals.join(sums, ["mix_id", "source"], "left").join(whole, "mix_id", "left")
        .select("mix_id", "source", "stated_share", F.round("target_share", 6).alias("target_share"), F.round(reached, 6).alias("reached_share"), state.alias("state"), zero("tokens"), zero("texts"), zero("uses"))
    )
    return used, shares


def _run(spark, sf_dir: str, size: int | str | None = None) -> tuple[DataFrame, DataFrame]:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/mix_targets.parquet"), size)


def p9_mix(spark, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)[0]


def p9_shares(spark, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)[1]


def p9_exact_shares(spark, sf_dir: str) -> DataFrame:
    """The largest mixes that meet their targets."""
    return _run(spark, sf_dir, "exact")[1]


def p9_invariants(spark, sf_dir: str) -> DataFrame:
    """(mix_id, sources, overused, foreign_texts, twice, shares_add_up): what holds of every mix, checked on its uses."""
    used, shares = _run(spark, sf_dir)
    targets = spark.read.parquet(f"{sf_dir}/mix_targets.parquet").where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(F.max("max_repeats").alias("most"))
    text = used.groupBy("mix_id", "source", "doc_id").agg(F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("rows"))
    checked = text.join(targets, ["mix_id", "source"], "left").groupBy("mix_id").agg(F.count_if(F.col("uses") > F.col("most")).alias("overused"), F.count_if(F.col("most").isNull()).alias("foreign_texts"), F.count_if(F.col("rows") > 1).alias("twice"))
    sums = shares.groupBy("mix_id").agg(F.count(F.lit(1)).alias("sources"), (F.abs(F.sum("reached_share") - 1) < 0.001).alias("shares_add_up"))
    return sums.join(checked, "mix_id", "left").select("mix_id", "sources", "overused", "foreign_texts", "twice", "shares_add_up")


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares, "p9_exact_shares": p9_exact_shares, "p9_invariants": p9_invariants}
ORACLE = {
    "p9_invariants": """select mix_id, count(distinct source) as sources, 0::bigint as overused, 0::bigint as foreign_texts, 0::bigint as twice, true as shares_add_up
      from mix_targets where mix_id is not null and source is not null group by mix_id""",
}
