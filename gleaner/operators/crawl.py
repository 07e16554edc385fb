"""The crawl loop over the round operators: each round is a job, its state a checkpointed version.

Pages and visits only grow: a round writes its own and the state reads all parts, which are brought together now and then. The
frontier and the clock are written anew and the superseded ones deleted.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner import schemas
from gleaner.functions.urls import normalize_url
from gleaner.operators import frontier as R
from gleaner.session import discard, materialize
from gleaner.sources.fetch import robots_allowed

log = logging.getLogger("gleaner.crawl")
PAGES = schemas.RAW_PAGES
#: Parts of a growing table that are read one by one before they are written as one.
MOST_PARTS = 32


@dataclass
class State:
    """Everything a crawl resumes from; ``now`` is the virtual clock in seconds."""

    pages: DataFrame
    frontier: DataFrame
    clock: DataFrame
    visited: DataFrame
    now: float = 0.0
    rounds: int = 0
    attempted: int = 0
    parts: dict[str, list[DataFrame]] = field(default_factory=dict)

    def grown(self, name: str, new: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """The table ``name`` with new rows, and its parts."""
        parts = [*self.parts.get(name, [getattr(self, name)]), materialize(new, name)]
        if len(parts) > MOST_PARTS:
            whole = materialize(_union(parts), name)
            discard(*parts)
            parts = [whole]
        return _union(parts), parts


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fresh(spark: SparkSession, seeds: DataFrame) -> State:
    empty = lambda s: spark.createDataFrame([], s)
    return State(empty(PAGES), materialize(R.seed_frontier(seeds), "frontier"), empty(schemas.CLOCK), empty(schemas.VISITED))


def crawl_round(state: State, fetcher: Callable[[DataFrame], DataFrame], robots: DataFrame, conf: R.Crawl = R.Crawl()) -> tuple[State, DataFrame]:
    """One round: the next state, and the processed pages with their outcomes."""
    claimed = materialize(R.claim(state.frontier, state.clock, state.now), "claimed")
    fetched = robots_allowed(fetcher(claimed.select("level", "seq", "url", "attempts")), robots, conf.agent)
    done = materialize(R.process(fetched, state.pages.select(R.url_key(F.col("canonical_url")).alias("key")), conf), "round")
    last = state.pages.agg(F.coalesce(F.max("doc_id"), F.lit(-1))).first()[0]
    stamp = F.date_format(F.timestamp_seconds(F.lit(state.now)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    saved = R.number_new(done.where("outcome = 'saved'"), last, "doc_id", ["url"])
    saved = saved.select("doc_id", "url", "fetched_url", "canonical_url", "title", "headings", "body", "outgoing_links", "language", "is_related", stamp.alias("crawl_time"))
    pages, page_parts = state.grown("pages", saved)
    again = done.where("outcome = 'retry'").select("level", R.registrable_domain(F.col("url")).alias("domain"), "seq", "url", (F.col("attempts") + 1).alias("attempts"))
    status = F.when(F.col("outcome") == "robots_blocked", F.lit("robots_blocked")).otherwise(F.coalesce(F.col("status").cast("string"), F.lit("request_error")))
    visited, visit_parts = state.grown("visited", done.where("outcome != 'retry'").select("url", stamp.alias("visited_at"), status.alias("status_code")))
    links = done.where(F.col("outcome").isin("not_related", "not_english", "duplicate", "saved")).select(F.explode("outgoing_links").alias("url"), (F.col("is_related") & F.col("is_english")).alias("promote"))
    waiting = state.frontier.join(claimed.select("url"), "url", "left_anti").unionByName(again)
    seen = waiting.select("url").unionByName(visited.select("url")).unionByName(claimed.select("url"))
    top = state.frontier.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    new = R.number_new(R.route(links.select(normalize_url(F.col("url")).alias("url"), "promote"), seen, conf), top, "seq", ["url"])
    frontier = materialize(waiting.unionByName(new.withColumn("attempts", F.lit(0)).select(*waiting.columns)), "frontier")
    clock = materialize(R.advance(state.clock, claimed, state.now, conf.polite_delay), "clock")
    return State(pages, frontier, clock, visited, state.now + conf.polite_delay, state.rounds + 1, state.attempted + claimed.count(), {"pages": page_parts, "visited": visit_parts}), done


def crawl(state: State, fetcher: Callable[[DataFrame], DataFrame], robots: DataFrame, conf: R.Crawl = R.Crawl(), max_rounds: int = 1000, on_round: Callable[[State], None] | None = None) -> State:
    """Rounds until the frontier is empty or the pages reach ``max_pages`` (pages of the last round are kept above it)."""
    while state.rounds < max_rounds and state.pages.count() < conf.max_pages and not state.frontier.isEmpty():
        before = state
        state, done = crawl_round(state, fetcher, robots, conf)
        if on_round:
            on_round(state)
        discard(before.frontier, before.clock, done)
        log.info("worker=round %d now=%.1f pages=%d frontier=%d", state.rounds, state.now, state.pages.count(), state.frontier.count())
    return state


def summary(state: State, before: dict | None = None, seconds: float = 0.0, interrupted: bool = False, fresh: bool = False) -> dict:
    """Figures of a run, and those of all runs where ``before`` is the summary of the former ones."""
    had = lambda k, zero=0: (before or {}).get(k, zero)
    sizes = {r.level: r.urls for r in R.frontier_sizes(state.frontier, state.clock, state.now).collect()}
    return {
        "step": "crawling", "runs_completed": had("runs_completed") + 1, "total_pages": state.pages.count(), "visited_size": state.visited.count(),
        "rounds_this_run": state.rounds, "rounds_total": had("rounds_total") + state.rounds,
        "attempted_urls_this_run": state.attempted, "attempted_urls_total": had("attempted_urls_total") + state.attempted,
        "frontier_high_size": sizes.get("high", 0), "frontier_low_size": sizes.get("low", 0),
        "last_run_interrupted": interrupted, "interrupted_runs": had("interrupted_runs") + int(interrupted), "started_fresh_last_run": fresh,
        "elapsed_seconds_this_run": round(seconds, 2), "elapsed_seconds_total": round(had("elapsed_seconds_total", 0.0) + seconds, 2),
    }
