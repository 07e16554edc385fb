"""Problem 10: repetition inside a single document, kept as a rule bitmask ledger.

Every rule is evaluated once for each document; the ledger stores the measurements and one bit per failed rule. A
policy is a versioned set of bits, so other policies, and what each rule adds to a policy (ablation), are bitwise
aggregations over the ledger and never read a text again.

A batch of documents is handled as one array of word hashes. The hash of each run of eight words is a polynomial over
it, tied to its document, and a stable sort finds for each run whether it began earlier in the same document. Texts of
any length go through whole; hashes have 64 bits, so two different runs of a document meet with a chance below 1e-9
for a million words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rules by bit: (name, measurement, least value that fails). Documented, fixed thresholds.
RULES = (
    ("stretch8", "stretch_share", 0.30),
    ("line_dup", "line_share", 0.30),
    ("sentence_dup", "sentence_share", 0.30),
    ("bigram_top", "bigram_share", 0.20),
)
#: Policies by version: the bits that reject a document.
POLICIES = {"stretch-1": 0b0001, "lines-1": 0b0110, "all-1": 0b1111}
STRETCH = 8
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?]+\s+|\n+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
SCHEMA = "doc_id bigint, words bigint, stretch_share double, line_share double, sentence_share double, bigram_share double, bits int"


def _runs(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each place on, tied to the document, and whether the run lies within it."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    g = np.zeros(m, np.uint64)
    for j in range(n):
        g = g * _BASE + h[j : j + m]
    g ^= g >> np.uint64(29)
    g = (g + doc[:m].astype(np.uint64)) * _MIX
    return g ^ (g >> np.uint64(32)), doc[:m] == doc[n - 1 :]


def _again(keys: np.ndarray) -> np.ndarray:
    """True where an equal key stands earlier."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = s[1:] == s[:-1]
    return out


def _parts_share(parts: list[list[str]]) -> np.ndarray:
    """For each document the characters in parts that stood before, of all; parts without letters don't count."""
    out = np.zeros(len(parts))
    for i, own in enumerate(parts):
        if len(own) > 1 and len(set(own)) < len(own):
            seen, total, twice = set(), 0, 0
            for p in own:
                k = p.strip().casefold()
                if k:
                    total += len(k)
                    twice += len(k) if k in seen else 0
                    seen.add(k)
            out[i] = twice / total if total else 0.0
    return out


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """All measurements of a batch of texts; null and empty texts have 0 words and 0 shares."""
    words = [_WORD.findall(t.lower()) if t else [] for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    doc = np.repeat(np.arange(len(words)), n)
    h = np.fromiter((hash(w) for own in words for w in own), np.int64, int(n.sum())).view(np.uint64)
    cover = np.zeros(len(h) + 1, np.int64)
    keys, inside = _runs(h, doc, STRETCH)
    at = np.flatnonzero(inside)
    at = at[_again(keys[at])]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + STRETCH, -1)
    covered = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=len(words))
    top = np.zeros(len(words))
    keys, inside = _runs(h, doc, 2)
    if inside.any():
        order = np.argsort(keys[inside], kind="stable")
        k, d = keys[inside][order], doc[:-1][inside][order]
        start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        np.maximum.at(top, d[start], np.diff(np.r_[start, len(k)]))
    least = np.maximum(n, 1)
    lines = [t.split("\n") if t and "\n" in t else [] for t in texts]
    sentences = [_SENTENCE.split(t) if t else [] for t in texts]
    return {
        "words": n,
        "stretch_share": covered / least,
        "line_share": _parts_share(lines),
        "sentence_share": _parts_share(sentences),
        "bigram_share": np.where(n >= 20, 2 * np.where(top > 1, top, 0) / least, 0.0),
    }


def ledger(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: measurements and ``bits``, bit i set where rule i of ``RULES`` failed.

    Null and empty texts have no words, shares of 0 and no bit set. Repeated rows each give their row; other columns
    aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = measure(b.column(1).to_pylist())
            bits = np.zeros(b.num_rows, np.int32)
            for i, (_, what, least) in enumerate(RULES):
                bits |= (m[what] >= least).astype(np.int32) << i
            bits[m["words"] == 0] = 0
            cols = [b.column(0), *(pa.array(m[c]) for c in ("words", "stretch_share", "line_share", "sentence_share", "bigram_share")), pa.array(bits)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "words", "stretch_share", "line_share", "sentence_share", "bigram_share", "bits"])

    return documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def apply_policy(book: DataFrame, policy: str) -> DataFrame:
    """The ledger's rows that a policy rejects."""
    return book.where(F.col("bits").bitwiseAND(F.lit(POLICIES[policy])) != 0)


def ablation(book: DataFrame) -> DataFrame:
    """(policy, rule, rejected, only_by_rule): what each rule adds to each policy, from one pass over distinct bit sets."""
    seen = book.groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    cells = [(p, r[0], mask, 1 << i) for p, mask in POLICIES.items() for i, r in enumerate(RULES) if mask >> i & 1]
    grid = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).alias("mask"), F.lit(b).alias("bit")) for p, r, m, b in cells])
    hit = F.col("bits").bitwiseAND(F.col("mask"))
    return (
        seen.select("bits", "n", F.inline(grid)).groupBy("policy", "rule")
        .agg(F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("rejected"), F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("only_by_rule"))
    )


def p10_found(spark, sf_dir: str) -> DataFrame:
    book = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return apply_policy(book, "stretch-1").select("doc_id").distinct()


def p10_ledger(spark, sf_dir: str) -> DataFrame:
    return ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def p10_ablation(spark, sf_dir: str) -> DataFrame:
    return ablation(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"p10_found": p10_found, "p10_ledger": p10_ledger, "p10_ablation": p10_ablation}
ORACLE = {
    "p10_found": """
with words as (select doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) as w, unnest(range(1, len(regexp_extract_all(lower(text), '\\p{L}+')) + 1)) as i from documents where text <> ''),
ahead as (select *, lead(w, 1) over d as b, lead(w, 2) over d as c, lead(w, 3) over d as e, lead(w, 4) over d as f, lead(w, 5) over d as g, lead(w, 6) over d as h, lead(w, 7) over d as j
  from words window d as (partition by doc_id order by i)),
seen as (select doc_id, i, j is not null and row_number() over (partition by doc_id, w, b, c, e, f, g, h, j order by i) > 1 as again from ahead),
cover as (select doc_id, coalesce(bool_or(again) over (partition by doc_id order by i rows between 7 preceding and current row), false) as inside from seen)
select doc_id from cover group by doc_id having count(*) filter (inside) >= 0.3 * count(*)""",
}
