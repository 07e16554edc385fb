"""The inverted index as tables: documents, postings, vocabulary and statistics.

Only documents that came more than once are brought together by their id; terms are counted within each document, so
postings need no exchange, and the vocabulary one of pre-aggregated counts. Stored postings are partitioned by a hash bucket of the term and sorted by it: a query reads its terms' buckets only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner import schemas
from gleaner.operators.dedup import one_per_key
from gleaner.session import materialize, remove
from gleaner.sources.files import modified

BUCKETS = 64


def term_bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def one_per_id(documents: DataFrame) -> DataFrame:
    """One row a document, of rows that differ the longest, then the one with fewest empty fields. Raises where a document lacks its id, as such a document can't be
    found again."""
    if not documents.where("doc_id is null").isEmpty():
        raise ValueError("a document has no doc_id")
    text = lambda c: F.coalesce(c, F.lit(""))
    return one_per_key(documents, "doc_id", F.struct(doc_length(), text("url"), text("canonical_url"), text("title"), F.greatest(F.size("outgoing_links"), F.lit(0)), _list("body_tokens")))


def doc_length() -> Column:
    return F.coalesce(F.col("body_length"), F.greatest(F.size("body_tokens"), F.lit(0))).cast("int")


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def metadata(documents: DataFrame) -> DataFrame:
    """Document records without body terms; missing strings are empty, missing lists are empty lists."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return documents.select(
        "doc_id", *[text(c) for c in ("url", "fetched_url", "canonical_url", "title", "snippet")],
        *[_list(c).alias(c) for c in ("title_tokens", "heading_tokens")], doc_length().alias("doc_length"), _list("outgoing_links").alias("outgoing_links"), text("crawl_time"),
    )


def count_terms(rows: DataFrame, terms: str, count: str = "tf") -> DataFrame:
    """The other columns of ``rows`` with each distinct term of the list column ``terms`` and how often it stands there.

    Counted within the row, batch by batch on dictionary codes, so nothing is shuffled; null terms and lists don't count.
    """
    keep = [c for c in rows.columns if c != terms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(keep))
            row = np.repeat(np.arange(b.num_rows), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
            coded = lists.flatten().dictionary_encode()
            code = np.asarray(pc.fill_null(coded.indices, -1)).astype(np.int64)
            row, code = row[code >= 0], code[code >= 0]
            width = max(1, len(coded.dictionary))
            pair, n = np.unique(row * width + code, return_counts=True)
            at = pa.array(pair // width)
            cols = [*(b.column(i).take(at) for i in range(len(keep))), coded.dictionary.take(pa.array(pair % width)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "term", count])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "term string", f"{count} int"])
    return rows.select(*keep, terms).mapInArrow(run, schema)


def term_frequencies(documents: DataFrame) -> DataFrame:
    """(term, doc_id, tf, doc_length): terms of title, headings and body together, the length of the body only."""
    terms = F.concat(_list("title_tokens"), _list("heading_tokens"), _list("body_tokens"))
    return count_terms(documents.select("doc_id", doc_length().alias("doc_length"), terms.alias("terms")), "terms").select("term", "doc_id", "tf", "doc_length")


def vocabulary(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def postings_lists(postings: DataFrame, span: int | None = None) -> DataFrame:
    """(term, postings): the nested form for export, by rising document. With ``span`` (term, part, postings): a list holds the
    documents of one range of ``span`` ids, so that a term of all documents is no single row."""
    keys = [F.col("term")] if span is None else [F.col("term"), F.floor(F.col("doc_id") / span).alias("part")]
    return postings.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))


def statistics(docs: DataFrame) -> DataFrame:
    """(n_docs, avgdl): one row; an empty collection has a mean length of 0."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg(F.col("doc_length").cast("double")), F.lit(0.0)).alias("avgdl"))


def field_lengths(documents: DataFrame) -> DataFrame:
    """(field, doc_id, length) of body, title and headings."""
    size = lambda c: F.greatest(F.size(_list(c)), F.lit(0))
    entries = F.array(*[F.struct(F.lit(n).alias("field"), x.alias("length")) for n, x in (("body", doc_length()), ("title", size("title_tokens")), ("heading", size("heading_tokens")))])
    return documents.select("doc_id", F.inline(entries)).select("field", "doc_id", F.col("length").cast("int").alias("length"))


def url_owners(documents: DataFrame) -> DataFrame:
    """(link, dst): the document that owns each URL; of several the last document, and within it the last kind of URL."""
    kinds = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("link")) for i, c in enumerate(("url", "fetched_url", "canonical_url"))])
    return documents.select("doc_id", F.inline(kinds)).where("link != ''").groupBy("link").agg(F.max_by("doc_id", F.struct("doc_id", "i")).alias("dst"))


def link_edges(documents: DataFrame) -> DataFrame:
    """(src, dst): distinct links between documents of the collection, no loops."""
    out = documents.select(F.col("doc_id").alias("src"), F.explode(F.array_distinct(_list("outgoing_links"))).alias("link"))
    return out.join(url_owners(documents), "link").where("src != dst").select("src", "dst").distinct()


def link_graph(documents: DataFrame) -> DataFrame:
    """(doc_id, targets): every document with its rising list of linked documents, also an empty one."""
    lists = link_edges(documents).groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("targets"))
    return documents.select("doc_id").join(lists, F.col("doc_id") == F.col("src"), "left").select("doc_id", F.coalesce("targets", F.array().cast("array<bigint>")).alias("targets"))


def summary(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(num_docs, vocabulary_size, average_document_length, documents_with_outgoing_links) in one row."""
    have = docs.agg(
        F.count(F.lit(1)).alias("num_docs"), F.round(F.coalesce(F.avg(F.col("doc_length").cast("double")), F.lit(0.0)), 4).alias("average_document_length"),
        F.count_if(F.size("outgoing_links") > 0).alias("documents_with_outgoing_links"),
    )
    return have.crossJoin(F.broadcast(vocab.agg(F.count(F.lit(1)).alias("vocabulary_size"))))


@dataclass
class Index:
    """The tables that queries need. ``stats`` has one row and is read once; ``buckets`` is set where the postings are stored
    by bucket of the term, so that a query's terms prune the folders that are read."""

    docs: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    buckets: int | None = None

    @cached_property
    def stats(self) -> tuple[int, float]:
        n, avgdl = statistics(self.docs).first()
        return int(n), float(avgdl)

    def persist(self) -> Index:
        for t in (self.docs, self.postings, self.vocabulary):
            t.persist()
        return self

    def unpersist(self) -> None:
        for t in (self.docs, self.postings, self.vocabulary):
            t.unpersist()

    def save(self, path: str, buckets: int = BUCKETS) -> None:
        """Write the index below ``path``; what was there is replaced."""
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        by_term = self.postings.withColumn("bucket", term_bucket(F.col("term"), buckets)).repartition(buckets, "bucket")
        by_term.sortWithinPartitions("bucket", "term", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        meta = statistics(self.docs.sparkSession.read.parquet(f"{path}/docs")).withColumn("buckets", F.lit(buckets))
        meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        read = lambda t: spark.read.parquet(f"{path}/{t}")
        meta = read("meta").first()
        index = Index(read("docs"), read("postings"), read("vocabulary"), meta.buckets)
        index.stats = (int(meta.n_docs), float(meta.avgdl))
        return index

    @staticmethod
    def drop(spark: SparkSession, path: str) -> None:
        remove(spark, path)


def build_index(documents: DataFrame) -> Index:
    """The index of preprocessed documents; repeated rows of a document count once. Documents and postings are written to the
    shared folder, since several of an index's users read them."""
    docs = materialize(one_per_id(documents), "docs")
    postings = materialize(term_frequencies(docs), "postings")
    return Index(metadata(docs), postings, vocabulary(postings))


class IndexCache:
    """Opened indexes by path, opened again where the stored one has changed. An index that can't be read is an empty one with a
    message, and tried again the next time."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.held: dict[str, tuple[int, Index]] = {}

    def get(self, path: str) -> tuple[Index, str]:
        """(index, message); the message is empty where all is well."""
        at = modified(self.spark, f"{path}/meta")
        if path in self.held and self.held[path][0] == at:
            return self.held[path][1], ""
        if old := self.held.pop(path, None):
            old[1].unpersist()
        try:
            index = Index.open(self.spark, path).persist()
        except Exception as e:
            empty = [self.spark.createDataFrame([], s) for s in (schemas.DOCS, schemas.POSTINGS, schemas.VOCABULARY)]
            return Index(*empty), f"{path}: {type(e).__name__}: {str(e).splitlines()[0]}"
        self.held[path] = at, index
        return index, ""
