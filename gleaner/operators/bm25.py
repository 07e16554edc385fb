"""BM25 for all queries at once.

The query side is small: its distinct terms get their document frequency and idf first and are counted; below a bound
they are broadcast to the postings (whose folders they prune), beyond it both sides are shuffled. The postings that are left
meet the queries in cells, some queries by some documents, and of a cell only each query's best k go on. Document lengths are
in the postings, so nothing else is joined before the top k of each query are known.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gleaner.operators.analyze import DEFAULT, Analyzer
from gleaner.operators.index import Index, term_bucket
from gleaner.session import materialize


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75
    top_k: int = 100


def idf(n_docs: int, df: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5)), always above 0."""
    return F.log1p((F.lit(float(n_docs)) - df + 0.5) / (df + 0.5))


def term_weight(weight: Column, tf: Column, length: Column, avgdl: float, p: Bm25) -> Column:
    """A term's share of a document's score; in a collection of empty bodies length plays no part."""
    relative = length / F.lit(avgdl) if avgdl > 0 else F.lit(0.0)
    return weight * (tf * (p.k1 + 1.0)) / (tf + p.k1 * (1.0 - p.b + p.b * relative))


def analyse_queries(queries: DataFrame, analyzer: Analyzer = DEFAULT) -> DataFrame:
    """(query_id, query, pos, query_tokens): one row a query, the first of its rows; null queries have no terms."""
    first = queries.where("query_id is not null").groupBy("query_id").agg(F.min_by("query", "pos").alias("query"), F.min("pos").alias("pos"))
    return first.withColumn("query_tokens", analyzer(F.col("query")))


def query_terms(analysed: DataFrame) -> DataFrame:
    return analysed.select("query_id", F.explode(F.array_distinct("query_tokens")).alias("term"))


#: Query terms up to which they are broadcast to the postings (a few dozen bytes each).
BROADCAST_TERMS = 500_000


#: Distinct terms up to which they are pushed into the scan of the postings, which are sorted by term.
PUSHED_TERMS = 2_000

#: Term sets, documents and postings of a cell, about. Rows that a task holds before it gives them out.
CELL_SETS, CELL_DOCS, CELL_POSTINGS, GIVEN = 20_000, 50_000, 3_000_000, 200_000


def weighed_terms(terms: DataFrame, index: Index) -> DataFrame:
    """(query_id, term, w, df, word, bit) of the queries' terms that the collection holds, with the bucket where the postings have
    one. A query's terms are numbered as bits of 60 to a word. Written once, as its size decides how it meets the postings."""
    w = terms.join(index.vocabulary, "term").select("query_id", "term", idf(index.stats[0], F.col("df")).alias("w"), "df")
    n = F.row_number().over(W.partitionBy("query_id").orderBy("term")) - 1
    w = w.withColumn("_n", n).withColumn("word", F.floor(F.col("_n") / 60).cast("int")).withColumn("bit", F.expr("shiftleft(1L, cast(_n % 60 as int))")).drop("_n")
    return materialize(w.withColumn("bucket", term_bucket(F.col("term"), index.buckets)) if index.buckets else w, "terms")


def _cells(weighed: DataFrame, index: Index, p: Bm25) -> tuple[DataFrame, DataFrame, int]:
    """(cell, asked, terms, term, docs, parts): what each cell of term sets and documents scores, by cell. A row is a set of terms, under the
    first of the queries that ask for it, or a term's documents (as bytes) and its shares of their scores. Beside it (query_id, asked) and the
    number of masks."""
    own = weighed.groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    sets = materialize(own.join(own.groupBy("terms").agg(F.min("query_id").alias("asked")), "terms").select("query_id", "asked", "terms"), "sets")
    distinct = sets.where("query_id = asked")
    n, longest = distinct.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("terms")), F.lit(1))).first()
    group = F.pmod(F.xxhash64("asked"), F.lit(max(1, math.ceil(n / CELL_SETS))))
    known = ["w", "df", *["bucket"] * bool(index.buckets)]
    each = weighed.groupBy("term").agg(*[F.first(c).alias(c) for c in known])
    wanted = materialize(distinct.select(group.alias("_g"), F.explode("terms").alias("term")).distinct().join(each, "term"), "wanted")
    by_group = wanted.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.sum("df").alias("df"))
    size, most = by_group.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("df"), F.lit(0))).first()
    blocks = max(1, math.ceil(index.stats[0] / CELL_DOCS), math.ceil(most / CELL_POSTINGS))

    postings = index.postings
    if size <= BROADCAST_TERMS:
        if index.buckets:
            postings = postings.where(F.col("bucket").isin([r.bucket for r in wanted.select("bucket").distinct().collect()]))
        pushed = wanted.select("term").distinct().limit(PUSHED_TERMS + 1).collect()
        if 0 < len(pushed) <= PUSHED_TERMS:
            postings = postings.where(F.col("term").isin([r.term for r in pushed]))
        wanted = F.broadcast(wanted)
    hits = postings.join(wanted, ["bucket", "term"] if index.buckets else "term")
    share = term_weight(F.col("w"), F.col("tf"), F.col("doc_length"), index.stats[1], p)
    cell = lambda g, b: (g * blocks + b).cast("bigint").alias("cell")
    of_docs = hits.select(cell(F.col("_g"), F.pmod(F.xxhash64("doc_id"), F.lit(blocks))), "term", F.col("doc_id").cast("bigint").alias("doc_id"), share.alias("part"))
    of_docs = of_docs.mapInArrow(_pack, "cell bigint, term string, docs binary, parts binary")
    of_sets = distinct.select(group.alias("_g"), "asked", "terms", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b")).select(cell(F.col("_g"), F.col("_b")), "asked", "terms")
    rows = of_sets.unionByName(of_docs, allowMissingColumns=True).select("cell", "asked", "terms", "term", "docs", "parts")
    return rows.repartition("cell").sortWithinPartitions("cell"), sets.select("query_id", "asked"), (longest + 59) // 60


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents, each as its distance from the last, and shares of each cell and term as bytes: one row where a task had one a posting."""
    names = ["cell", "term", "docs", "parts"]

    def packed(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        cell, doc, part = (t[c].to_numpy() for c in ("cell", "doc_id", "part"))
        coded = t["term"].combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.lexsort((doc, code, cell))
        cell, code, doc, part = cell[order], code[order], doc[order].astype(np.int64), part[order]
        at = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(code) != 0)) + 1), len(cell)]
        steps = np.diff(doc, prepend=0)
        steps[at[:-1]] = doc[at[:-1]]
        each = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(cell[at[:-1]]), coded.dictionary.take(pa.array(code[at[:-1]])), each(steps), each(part)], names=names)

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= GIVEN * 5:
            yield packed(held)
            held, n = [], 0
    if held:
        yield packed(held)


def _best(own: np.ndarray, docs: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` best sums, ties by document."""
    if len(own) <= top:
        return np.arange(len(own))
    least = np.partition(own, len(own) - top)[len(own) - top]
    above, ties = np.flatnonzero(own > least), np.flatnonzero(own == least)
    return np.concatenate([above, ties[np.argsort(docs[ties], kind="stable")][: top - len(above)]])


def _score(cell: pa.Table, words: int, top: int | None, digits: int | None) -> Iterator[tuple]:
    """(asked, documents, sums, masks): of each set of a cell the documents that hold one of its terms, or the ``top`` best of them."""
    sets, hits = cell.filter(pc.is_valid(cell["asked"])), cell.filter(pc.is_null(cell["asked"]))
    ids, terms = [np.cumsum(np.frombuffer(x, np.int64)) for x in hits["docs"].to_pylist()], hits["term"].to_pylist()
    parts = [np.frombuffer(x) for x in hits["parts"].to_pylist()]
    docs, place = np.unique(np.concatenate([np.zeros(0, np.int64), *ids]), return_inverse=True)
    held: dict[str, list] = {}
    for t, x, at in zip(terms, parts, np.split(place, np.cumsum([len(x) for x in ids])[:-1]) if ids else []):
        held.setdefault(t, []).append((at, x))
    for asked, terms in zip(sets["asked"].to_pylist(), sets["terms"].to_pylist()):
        sums, masks = np.zeros(len(docs)), np.zeros((words, len(docs)), np.int64)
        for i, t in enumerate(terms):
            for at, x in held.get(t, ()):
                sums[at] += x
                masks[i // 60][at] |= 1 << i % 60
        if digits is not None:
            sums = np.round(sums, digits)
        at = np.flatnonzero(masks.any(axis=0) if words > 1 else masks[0])
        if top is not None:
            at = at[np.sort(_best(sums[at], docs[at], top))]
        if len(at):
            yield asked, docs[at], sums[at], masks[:, at]


def _merged(batches: Iterator[pa.RecordBatch], words: int, top: int) -> Iterator[tuple]:
    """``_score`` of all cells: the best of each set from those of its cells."""
    for b in batches:
        for asked, cells in zip(b.column("asked"), b.column("cells")):
            all_ = cells.as_py()
            docs = np.concatenate([np.cumsum(np.frombuffer(x["docs"], np.int64)) for x in all_])
            sums, masks = (np.concatenate([np.frombuffer(x[c], k) for x in all_]) for c, k in (("sums", np.float64), ("masks", np.int64)))
            at = _best(sums, docs, top)
            yield asked.as_py(), docs[at], sums[at], masks.reshape(-1, words)[at].T


def _rows(found: Iterator[tuple], kind: pa.DataType, words: int) -> Iterator[pa.RecordBatch]:
    """(asked, doc_id, bm25, mask0, ...) of what ``_score`` and ``_merged`` give."""
    names = ["asked", "doc_id", "bm25", *(f"mask{i}" for i in range(words))]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        asked, docs, sums, masks = zip(*out)
        which = pa.array(np.repeat(np.arange(len(out)), [len(x) for x in docs]))
        return pa.RecordBatch.from_arrays([pa.array(asked, kind).take(which), *map(pa.array, (np.concatenate(docs), np.concatenate(sums), *np.concatenate(masks, axis=1)))], names=names)

    out, n = [], 0
    for x in found:
        out.append(x)
        n += len(x[1])
        if n >= GIVEN:
            yield batch(out)
            out, n = [], 0
    if out:
        yield batch(out)


def _bytes(found: Iterator[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(asked, docs, sums, masks) of what ``_score`` gives, one row a set; a document is its distance from the last."""
    while out := [*islice(found, 2_000)]:
        packed = [(np.diff(docs, prepend=0), sums, masks.T) for _, docs, sums, masks in out]
        cols = [pa.array([x[0] for x in out], kind), *(pa.array([x.tobytes() for x in col], pa.binary()) for col in zip(*packed))]
        yield pa.RecordBatch.from_arrays(cols, names=["asked", "docs", "sums", "masks"])


def _matches(weighed: DataFrame, index: Index, p: Bm25, top: int | None = None, digits: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(asked, doc_id, bm25, mask0, ...) of every document that holds a term of a set, or with ``top`` of all that can be among the best,
    (query_id, asked), and the number of masks.

    Nearly every document may match, so no match is shuffled: postings of the sets' terms, a small part of all, are brought together
    by cell, and each task scores its documents for its sets. Queries that ask for the same terms are scored once.
    """
    cells, queries, words = _cells(weighed, index, p)
    field = queries.schema["asked"]
    kind = to_arrow_type(field.dataType)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, parts = None, []
        for b in batches:
            cell = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1), len(cell)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    if parts and cell[i] != now:
                        yield from _score(pa.Table.from_batches(parts), words, top, digits)
                        parts = []
                    now = cell[i]
                    parts.append(b.slice(i, j - i))
        if parts:
            yield from _score(pa.Table.from_batches(parts), words, top, digits)

    asked = f"asked {field.dataType.simpleString()}"
    rows = ", ".join([asked, "doc_id bigint, bm25 double", *(f"mask{i} bigint" for i in range(words))])
    if top is None:
        return cells.mapInArrow(lambda x: _rows(scored(x), kind, words), rows), queries, words
    best = cells.mapInArrow(lambda x: _bytes(scored(x), kind), f"{asked}, docs binary, sums binary, masks binary")
    by_set = best.groupBy("asked").agg(F.collect_list(F.struct("docs", "sums", "masks")).alias("cells"))
    return by_set.mapInArrow(lambda x: _rows(_merged(x, words, top), kind, words), rows), queries, words


def _small(queries: DataFrame) -> DataFrame:
    """A table of the queries' side, broadcast where it is small, so that the matches aren't shuffled to meet it."""
    return F.broadcast(queries) if queries.count() <= BROADCAST_TERMS else queries


def _named(scored: DataFrame, weighed: DataFrame, words: int, whole: bool = False) -> DataFrame:
    """``scored`` with the rising list ``matched_terms`` in place of the masks."""
    own = weighed.groupBy("query_id").agg(F.collect_list(F.struct("term", "word", "bit")).alias("_terms"))

    def held(x):
        out = F.lit(False)
        for i in range(words):
            out = out | ((x["word"] == i) & (F.col(f"mask{i}").bitwiseAND(x["bit"]) != 0))
        return out

    names = F.array_sort(F.transform(F.filter("_terms", held), lambda x: x["term"]))
    return scored.join(_small(own) if whole else own, "query_id").withColumn("matched_terms", names).drop("_terms", *[f"mask{i}" for i in range(words)])


def matches(terms: DataFrame, index: Index, p: Bm25 = Bm25()) -> DataFrame:
    """(query_id, doc_id, bm25, matched_terms) of every document that holds a term of the query."""
    weighed = weighed_terms(terms, index)
    found, queries, words = _matches(weighed, index, p)
    return _named(found.join(_small(queries), "asked").drop("asked"), weighed, words, whole=True)


def top_k(scored: DataFrame, p: Bm25 = Bm25(), by: str = "query_id") -> DataFrame:
    """The best k of each query by unrounded score, ties by document; ``bm25_score`` is rounded after that."""
    w = W.partitionBy(by).orderBy(F.col("bm25").desc(), F.col("doc_id"))
    best = scored.withColumn("bm25_rank", F.row_number().over(w)).where(F.col("bm25_rank") <= p.top_k)
    return best.withColumn("bm25_score", F.round("bm25", 4)).drop("bm25")


def candidates(terms: DataFrame, index: Index, p: Bm25 = Bm25(), digits: int | None = None) -> DataFrame:
    """The best k of each query; their matched terms are named after the cut. ``digits`` rounds scores before they are ranked,
    for results that don't depend on the order in which a score was summed."""
    weighed = weighed_terms(terms, index)
    found, queries, words = _matches(weighed, index, p, p.top_k, digits)
    return _named(top_k(found, p, "asked").join(queries, "asked").drop("asked"), weighed, words)


def retrieve(analysed: DataFrame, index: Index, p: Bm25 = Bm25()) -> DataFrame:
    """Candidates with their documents' url, title and snippet, joined after the cut to k."""
    docs = index.docs.select("doc_id", "url", "fetched_url", "canonical_url", "title", "snippet")
    return candidates(query_terms(analysed), index, p).join(docs, "doc_id", "left")
