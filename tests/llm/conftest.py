import datetime

import pytest

RAW = (
    "doc_id bigint, url string, fetched_url string, canonical_url string, title string, headings array<string>, body string, "
    "outgoing_links array<string>, language string, is_tuebingen_related boolean, crawl_time string, ingested_at timestamp"
)


@pytest.fixture(scope="session")
def raw_pages(spark):
    """Raw pages of dicts; every field that is left out is null. Columns that clash with inner names are added."""
    from pyspark.sql import functions as F

    names = [c.split()[0] for c in RAW.split(", ")]

    def make(*rows, clash=True):
        data = [tuple(r.get(n, datetime.datetime(2025, 1, 1) if n == "ingested_at" else None) for n in names) for r in rows]
        df = spark.createDataFrame(data, RAW)
        if clash:
            for c in ("line_no", "k1", "s", "site", "host", "lang", "h", "n", "slot", "unit", "source", "tokens", "share"):
                df = df.withColumn(c, F.lit("clash"))
        return df

    return make


PROSE = [
    "The old tower of {0} stands beside the river and it is open to all visitors in spring. Nobody knows who built it, but many come to see it every year.",
    "Visitors who like a quiet garden also enjoy the library behind the station of {0}. It was restored by the guild and is now used for small concerts.",
    "In the summer the market of {0} moves to the bridge, because the square is too small for it. People from the villages walk there before noon.",
    "A narrow path leads from the mill of {0} to the castle, and from there you can see the whole valley. The path is closed when the river is high.",
]


@pytest.fixture(scope="session")
def plain_pages():
    """Forty pages of prose between a menu and legal lines, as dicts."""
    out = []
    for i in range(40):
        place = f"Place{chr(97 + i % 26)}{chr(97 + i // 26)}"
        body = ["Home | Contact | Opening hours | Search", f"The tower of {place}", *[p.format(place) for p in PROSE], "Related pages", f"{place} and the mill >", "All rights reserved", "Prices and times without guarantee"]
        out.append({"doc_id": i, "url": f"https://www.site{i % 4}.example/p{i}", "title": place, "headings": [f"The tower of {place}"], "body": "\n".join(body), "language": "en"})
    return out
