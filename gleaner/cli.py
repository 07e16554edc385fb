"""Command line: ``python -m gleaner.cli preprocess|index|batch|crawl ...``; every step reads and writes tables or files."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.operators import analyze as A, batch as B, bm25 as R, crawl as L, frontier as C, index as I
from gleaner.operators.rerank import Rerank
from gleaner.session import local_session, materialize, scratch
from gleaner.sources import fetch as H, tables as S
from gleaner.sources.files import read_text
from gleaner.sources.log import log_to


def _pages(spark, path: str):
    return S.read_json(spark, path, schemas.RAW_PAGES, "pages") if path.endswith((".json", ".json.gz")) else spark.read.parquet(path)


def preprocess(spark, a) -> dict:
    started = time.perf_counter()
    A.preprocess(A.latest_pages(_pages(spark, a.input))).write.mode("overwrite").parquet(a.output)
    return A.totals(spark.read.parquet(a.output)).first().asDict() | {"elapsed_seconds": round(time.perf_counter() - started, 4)}


def build(spark, a) -> dict:
    started = time.perf_counter()
    docs = S.read_documents(spark, a.input) if a.input.endswith((".json", ".json.gz")) else spark.read.parquet(a.input)
    I.build_index(docs).save(a.output, a.buckets)
    index = I.Index.open(spark, a.output)
    return {"step": "indexing"} | I.summary(index.docs, index.vocabulary).first().asDict() | {"elapsed_seconds": round(time.perf_counter() - started, 4)}


def batch(spark, a) -> dict:
    started = time.perf_counter()
    queries = S.read_queries(spark, a.input)
    results = B.search(queries, I.Index.open(spark, a.index), bm25=R.Bm25(top_k=a.top_k), ranking=None if a.no_reranking else Rerank())
    rows = B.result_rows(results, a.top_k).persist()
    S.write_results(rows, queries, a.output)
    return B.batch_summary(queries, rows, time.perf_counter() - started, input_path=a.input, index_path=a.index, output_path=a.output, top_k=a.top_k, use_reranking=not a.no_reranking)


def crawl(spark, a) -> dict:
    """Crawl over a stored web (url, status, content_type, html); another fetcher can be given to ``operators.crawl``."""
    web = spark.read.parquet(a.web)
    robots = spark.read.parquet(a.robots) if a.robots else spark.createDataFrame([], "host string, status int, body string")
    last = None if a.fresh else S.load_checkpoint(spark, a.output)
    if last:
        own = {name: materialize(t, name) for name, t in last[1].items()}  # later versions delete the files of this one
        state = L.State(**own, now=own["clock"].agg(F.coalesce(F.max("next_time"), F.lit(0.0))).first()[0])
    else:
        state = L.fresh(spark, S.read_seeds(spark, a.seeds))
    version = last[0] if last else 0

    def save(s) -> None:
        nonlocal version
        if s.rounds % a.checkpoint_every == 0:
            version += 1
            S.save_checkpoint(spark, a.output, version, pages=s.pages, frontier=s.frontier, clock=s.clock, visited=s.visited)

    if a.log:
        log_to(a.log)
    former, started, interrupted = json.loads(read_text(spark, f"{a.output}/summary.json") or "{}"), time.perf_counter(), False
    try:
        state = L.crawl(state, lambda claimed: H.replay(claimed, web), robots, C.Crawl(max_pages=a.max_pages, polite_delay=a.polite_delay), on_round=save)
    except KeyboardInterrupt:  # the last saved version is what counts
        interrupted, last = True, S.load_checkpoint(spark, a.output)
        if last is None:
            raise
        state = L.State(**last[1])
    else:
        S.save_checkpoint(spark, a.output, version + 1, pages=state.pages, frontier=state.frontier, clock=state.clock, visited=state.visited)
    out = L.summary(state, former, time.perf_counter() - started, interrupted, a.fresh)
    S.write_json(spark, f"{a.output}/summary.json", out)
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="gleaner", description=__doc__)
    p.add_argument("--cpus", default="*")
    p.add_argument("--summary-output")
    steps = p.add_subparsers(dest="step", required=True)
    for name, run, options in (
        ("preprocess", preprocess, (("input", {}), ("output", {}))),
        ("index", build, (("input", {}), ("output", {}), ("buckets", {"type": int, "default": I.BUCKETS}))),
        ("batch", batch, (("input", {}), ("index", {}), ("output", {}), ("top-k", {"type": int, "default": 100}), ("no-reranking", {"action": "store_true"}))),
        ("crawl", crawl, (("seeds", {}), ("web", {}), ("output", {}), ("robots", {"default": None}), ("log", {"default": None}), ("max-pages", {"type": int, "default": 10_000}), ("polite-delay", {"type": float, "default": 1.0}), ("checkpoint-every", {"type": int, "default": 250}), ("fresh", {"action": "store_true"}))),
    ):
        s = steps.add_parser(name, help=run.__doc__)
        s.set_defaults(run=run)
        for option, kw in options:
            s.add_argument(f"--{option}", **({"required": True} | kw if not kw else kw))
    a = p.parse_args(argv)
    spark = local_session(a.cpus)
    with scratch():
        summary = a.run(spark, a)
    if a.summary_output:
        S.write_json(spark, a.summary_output, summary)
    print(json.dumps(summary, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
