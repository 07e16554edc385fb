import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleaner.operators import analyze as A, index as I
from gleaner.streaming import ingest, polite
from tests.conftest import SMALL


def test_stream_equals_batch(spark, tmp_path):
    pages = A.latest_pages(spark.read.parquet(f"{SMALL}/raw_pages.parquet"))
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ingest.start(stream, str(tmp_path / "idx"), str(tmp_path / "chk"), A.PLAIN)
    q.awaitTermination(120)
    got = ingest.open_index(spark, str(tmp_path / "idx"))
    want = I.build_index(A.preprocess(pages, A.PLAIN))
    assert got.stats == pytest.approx(want.stats)
    assert got.postings.exceptAll(want.postings).count() == 0 and want.postings.exceptAll(got.postings).count() == 0


def test_windows_and_first(spark, tmp_path):
    rows = spark.createDataFrame([("2025-01-01 01:00:00", "200", "a"), ("2025-01-01 02:00:00", "200", "a"), ("2025-01-02 02:00:00", "404", "b")], "t string, status_code string, key string").withColumn("visited_at", F.to_timestamp("t"))
    assert sorted(r.visits for r in ingest.visits_by_window(rows.select("visited_at", "status_code")).collect()) == [1, 2]
    assert ingest.running_order(rows, "key", "visited_at").count() == 2
    rows.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ingest.first_by_key(s, at="visited_at").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("firsts").count() == 2


def test_guards(spark):
    rows = spark.createDataFrame([("HTTP://A.de/x#y", "high"), ("https://web.archive.org/z", "low"), ("https://a.de/f.pdf", "low"), ("/nothing", "low")], "url string, level string")
    assert [tuple(r) for r in polite.guarded(rows).collect()] == [("a.de", "https://a.de/x", "high")]


def test_polite_stream(spark, tmp_path):
    pd.DataFrame({"domain": ["a", "a", "a", "b", "b"], "url": ["1", "2", "1", "3", "3"], "level": ["low", "high", "low", "low", "done"]}).to_parquet(tmp_path / "x.parquet")
    s = spark.readStream.schema("domain string, url string, level string").parquet(str(tmp_path))
    q = polite.polite_stream(s, 100).writeStream.format("memory").queryName("polite").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0.3 seconds").start()
    try:
        for _ in range(60):
            q.awaitTermination(1)
            if spark.table("polite").count() >= 3:
                break
        got = [(r.domain, r.url) for r in spark.table("polite").orderBy("released_ms").collect()]
    finally:
        q.stop()
    at = [r.released_ms for r in spark.table("polite").where("domain = 'a'").orderBy("released_ms").collect()]
    assert at[1] - at[0] >= 100
    assert sorted(got) == [("a", "1"), ("a", "2"), ("b", "3")] and [u for d, u in got if d == "a"] == ["2", "1"]
