"""Incremental indexing: micro-batches of new pages are analysed and appended to the postings.

Each batch writes its own version folder, so a batch that runs again after a failure replaces its folder and nothing is
counted twice; readers union the folders and keep, of a document delivered again, the last batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from gleaner.operators.analyze import DEFAULT, Analyzer, latest_pages, preprocess
from gleaner.operators.index import Index, metadata, term_frequencies, vocabulary


def write_batch(batch: DataFrame, number: int, path: str, analyzer: Analyzer = DEFAULT) -> None:
    docs = preprocess(latest_pages(batch), analyzer)
    metadata(docs).write.mode("overwrite").parquet(f"{path}/docs/batch={number}")
    term_frequencies(docs).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")


def start(pages_stream: DataFrame, path: str, checkpoint: str, analyzer: Analyzer = DEFAULT, once: bool = True):
    """Start the ingest query; with ``once`` it takes what is there and ends."""
    writer = pages_stream.writeStream.foreachBatch(lambda df, n: write_batch(df, n, path, analyzer)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def open_index(spark: SparkSession, path: str) -> Index:
    """The index over all batches so far."""
    docs = spark.read.parquet(f"{path}/docs")
    owner = docs.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    last = docs.join(owner, ["doc_id", "batch"], "left_semi").drop("batch")
    postings = spark.read.parquet(f"{path}/postings").join(owner, ["doc_id", "batch"], "left_semi").drop("batch").select("term", "doc_id", "tf", "doc_length")
    return Index(last, postings, vocabulary(postings))


def visits_by_window(visits: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, status_code, visits): windowed counts of (visited_at timestamp, status_code) with a watermark for late rows;
    works on streams and on tables."""
    return visits.withWatermark("visited_at", late).groupBy(F.window("visited_at", width).alias("w"), "status_code").agg(F.count(F.lit(1)).alias("visits")).select(F.col("w.start").alias("start"), "status_code", "visits")


def first_by_key(pages: DataFrame, key: str = "key", late: str = "7 days", at: str = "ingested_at") -> DataFrame:
    """The first page of each key within the watermark, for streams."""
    return pages.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def running_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The batch twin of ``first_by_key``: the first row of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")
