"""The polite frontier as a stateful stream: one queue and one next time for each domain.

State lives in the state store, keyed by domain and, within it, by URL and place in the queue, so a batch reads and writes only
the entries it touches, however long a domain's queue and however many URLs it has seen. A processing-time timer releases one
URL of a domain at a time, the high level first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleaner.functions.urls import normalize_url, registrable_domain
from gleaner.operators.frontier import Crawl, insertable

OUTPUT = "domain string, url string, level string, released_ms bigint"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Levels of a row: two queues, and the word that a page of the domain has been fetched.
HIGH, LOW, DONE = "high", "low", "done"


def guarded(urls: DataFrame, conf: Crawl = Crawl()) -> DataFrame:
    """Stream (url, level) -> (domain, url, level): normal URLs of pages with a host, none below a blacklisted domain."""
    own = urls.select(normalize_url(F.col("url")).alias("url"), "level")
    return insertable(own, conf).select(registrable_domain(F.col("url")).alias("domain"), "url", "level")


class Politeness(StatefulProcessor):
    """Queues of a domain: URLs seen are dropped, waiting ones released in order, no two within ``delay_ms``."""

    def __init__(self, delay_ms: int, remember_ms: int | None = None) -> None:
        self.delay, self.remember = delay_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "url string", "level string", self.remember)
        self.queue = handle.getMapState("queue", "level string, place bigint", "url string")
        self.ends = handle.getValueState("ends", "high_first bigint, high_next bigint, low_first bigint, low_next bigint, next_ms bigint, timer_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self._load()
        now = timerValues.getCurrentProcessingTimeInMs()
        for pdf in rows:
            for url, level in zip(pdf.url, pdf.level):
                if level == DONE:
                    s["next"] = max(s["next"], now + self.delay)
                elif not self.seen.containsKey((url,)):
                    self.seen.updateValue((url,), (level,))
                    name = HIGH if level == HIGH else LOW
                    self.queue.updateValue((name, s[name][1]), (url,))
                    s[name][1] += 1
        yield from self._step(key, s, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        s["timer"] = 0
        yield from self._step(key, s, timerValues.getCurrentProcessingTimeInMs())

    def _load(self) -> dict:
        a, b, c, d, n, t = self.ends.get() if self.ends.exists() else (0,) * 6
        return {HIGH: [a, b], LOW: [c, d], "next": n, "timer": t}

    def _step(self, key, s: dict, now: int) -> Iterator[pd.DataFrame]:
        """Release what may go, set the timer for what waits, and save the ends."""
        waiting = [x for x in (HIGH, LOW) if s[x][0] < s[x][1]]
        if waiting and now >= s["next"]:
            level = waiting[0]
            at = (level, s[level][0])
            (url,) = self.queue.getValue(at)
            self.queue.removeKey(at)
            s[level][0] += 1
            s["next"] = now + self.delay
            yield pd.DataFrame([(key[0], url, level, now)], columns=["domain", "url", "level", "released_ms"])
        if not s["timer"] and any(s[x][0] < s[x][1] for x in (HIGH, LOW)):
            s["timer"] = max(now + 1, s["next"])
            self.handle.registerTimer(s["timer"])
        self.ends.update((*s[HIGH], *s[LOW], s["next"], s["timer"]))

    def close(self) -> None:
        pass


def polite_stream(urls: DataFrame, delay_ms: int = 600, remember_ms: int | None = None) -> DataFrame:
    """Stream (domain, url, level) -> stream ``OUTPUT``: each URL once, and no two of a domain within ``delay_ms``. Rows of the level
    "done" put the domain off by the delay from then on. With ``remember_ms`` a URL may come again after that time. The session's
    state store has to know keyed state; the one that does is set where another one is."""
    spark = urls.sparkSession
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return urls.groupBy("domain").transformWithStateInPandas(Politeness(delay_ms, remember_ms), OUTPUT, "Update", "ProcessingTime")
