"""Problem 8: filling fixed-capacity containers with texts, by variable-capacity best fit.

The documents are dealt by a hash of their id into shards of about ``SHARD`` texts, which are packed by themselves; only
the last open containers of a shard can stay emptier than they had to, so a shard's size bounds the loss. Within a
shard the work is done on the histogram of sizes, largest first, with equal containers handled as one group:

* an item goes into the open container with least room left that still takes it (best fit);
* where none takes it, the permitted length is opened whose container, filled greedily from the sizes still to come,
  wastes the smallest share of its cost;
* at the end each container is cut down to the smallest permitted length that holds its contents.

A text larger than the largest length is cut into full containers and a rest that is packed like any other text; no
other text is cut. Texts without tokens take no room and get no row.
"""

from __future__ import annotations

import bisect
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.tokens import VOCABULARY, sized
from gleaner.session import materialize

#: Texts in a shard, about; rows of the table of container sizes that are taken to the driver at most.
SHARD = 50_000
MAX_SPECS = 1000
SCHEMA = "spec_id string, container_id string, capacity_tokens int, position int, doc_id bigint, piece int, start_token bigint, end_token bigint"


def greedy_fill(room: int, sizes: list[int], left: Counter) -> int:
    """Room that greedy filling from the rising ``sizes`` still to be packed would leave of ``room``."""
    at = bisect.bisect_right(sizes, room)
    while room and at:
        s = sizes[at - 1]
        n = min(left[s], room // s)
        room -= n * s
        at = min(at - 1, bisect.bisect_right(sizes, room))
    return room


def best_fit(histogram: dict[int, int], lengths: list[int]) -> list[tuple[int, tuple[tuple[int, int], ...], int]]:
    """Pack ``histogram`` (size -> items) into containers of the permitted ``lengths``.

    Returns groups of equal containers (length, ((size, items), ...), containers). Sizes must lie within 1..max(lengths).
    """
    lengths = sorted(set(lengths))
    left = Counter({s: n for s, n in histogram.items() if n > 0})
    sizes = sorted(left)
    open_: dict[int, list[list]] = {}  # room left -> [pattern, containers]
    rooms: list[int] = []

    def put(room: int, pattern: tuple, n: int) -> None:
        if n:
            if room not in open_:
                bisect.insort(rooms, room)
                open_[room] = []
            open_[room].append([pattern, n])

    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):
                sizes_left = sizes[: bisect.bisect_right(sizes, s)]
                left[s] = n - 1
                waste = lambda length: greedy_fill(length - s, sizes_left, left) / length  # noqa: B023, E731
                length = min((x for x in lengths if x >= s), key=lambda x: (waste(x), -x))
                each = max(1, length // s)
                whole = n // each
                if whole:
                    put(length - each * s, ((s, each),), whole)
                    n -= whole * each
                else:
                    put(length - n * s, ((s, n),), 1)
                    n = 0
                continue
            room = rooms[at]
            pattern, count = open_[room][-1]
            each = min(room // s, n)
            used = min(count, n // each)
            open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            put(room, pattern, count - used)
            put(room - each * s, (*pattern, (s, each)), used)
            n -= used * each
        left[s] = 0
    out = []
    for room, groups in open_.items():
        for pattern, n in groups:
            load = sum(s * c for s, c in pattern)
            out.append((next(x for x in lengths if x >= load), pattern, n))
    return out


def pack_shard(doc_ids: list[str | None], tokens: list[int], spec: str, lengths: list[int], separator: int, shard: int) -> list[tuple]:
    """Rows of ``SCHEMA`` for one shard and one table entry. A separator stands between two items of a container, so
    sizes and lengths are compared with one separator added to each."""
    top = max(lengths)
    rows, by_size = [], {}
    box = 0
    for d, n in sorted(zip(doc_ids, tokens), key=lambda x: (x[0] is None, x[0] or "", x[1])):
        start = piece = 0
        while n - start > top:
            rows.append((spec, f"{spec}/{shard}/{box}", top, 0, d, piece, start, start + top))
            start, piece, box = start + top, piece + 1, box + 1
        if n > start:
            by_size.setdefault(n - start + separator, []).append((d, piece, start, n))
    groups = best_fit({s: len(v) for s, v in by_size.items()}, [x + separator for x in lengths])
    for length, pattern, count in groups:
        for _ in range(count):
            place = 0
            for s, n in pattern:
                for _ in range(n):
                    d, piece, start, end = by_size[s].pop()
                    rows.append((spec, f"{spec}/{shard}/{box}", length - separator, place, d, piece, start, end))
                    place += 1
            box += 1
    return rows


def pack(documents: DataFrame, specs: list[tuple[str, list[int], int]], vocabulary: str = VOCABULARY, shard_docs: int = SHARD) -> DataFrame:
    """Rows of ``SCHEMA``: every text of ``documents`` (doc_id, text) in containers of each of ``specs`` (name, permitted
    lengths, separator tokens). Texts with a null id are placed like any other; null and empty texts get no row."""
    # ids travel as text, since a null would make pandas read whole numbers as floating ones
    sizes = materialize(sized(documents, vocabulary=vocabulary).where("tokens > 0"), "sizes").withColumn("doc_id", F.col("doc_id").cast("string"))
    # texts without an id are spread by their place in the written table, which is the same whenever a task reads it again
    spread = F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id().cast("string")))
    shards = max(1, round(documents.select("doc_id").count() / shard_docs))
    schema = SCHEMA.replace("doc_id bigint", "doc_id string")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = [None if pd.isna(d) else d for d in pdf.doc_id]
        rows = [r for name, lengths, sep in specs for r in pack_shard(ids, pdf.tokens.tolist(), name, lengths, sep, int(pdf.shard.iloc[0]))]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    packed = sizes.withColumn("shard", F.pmod(spread, F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(run, schema)
    return packed.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def read_specs(table: DataFrame) -> list[tuple[str, int, int]]:
    """(name, capacity, separator) of each distinct valid row; entries without a positive capacity are left out."""
    rows = table.where("capacity_tokens > 0").select("spec_id", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0))).distinct().limit(MAX_SPECS + 1).collect()
    if len(rows) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} container sizes")
    return sorted((str(r[0]), int(r[1]), int(r[2])) for r in rows)


def report(packed: DataFrame, separators: dict[str, int]) -> DataFrame:
    """(spec_id, containers, capacity, tokens, separators, fill, cut_texts): how full the containers are."""
    box = packed.groupBy("spec_id", "container_id").agg(F.max("capacity_tokens").alias("capacity"), F.sum(F.col("end_token") - F.col("start_token")).alias("tokens"), F.count(F.lit(1)).alias("items"), F.sum((F.col("piece") > 0).cast("int")).alias("cut"))
    sep = F.create_map(*[F.lit(x) for k, v in separators.items() for x in (k, v)])
    return box.groupBy("spec_id").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"),
        F.sum((F.col("items") - 1) * sep[F.col("spec_id")]).alias("separators"),
        F.round((F.sum("tokens") + F.sum((F.col("items") - 1) * sep[F.col("spec_id")])) / F.sum("capacity"), 6).alias("fill"), F.sum("cut").alias("later_pieces"),
    )


def _tables(spark, sf_dir: str) -> tuple[DataFrame, list[tuple[str, int, int]]]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), read_specs(spark.read.parquet(f"{sf_dir}/pack_specs.parquet"))


def p8_pack(spark, sf_dir: str) -> DataFrame:
    """Each table entry by itself: all containers have its capacity."""
    docs, specs = _tables(spark, sf_dir)
    return pack(docs, [(name, [cap], sep) for name, cap, sep in specs])


def p8_joint(spark, sf_dir: str) -> DataFrame:
    """All capacities permitted at once, so each container takes the length that suits its contents."""
    docs, specs = _tables(spark, sf_dir)
    return pack(docs, [("joint", [cap for _, cap, _ in specs], max(sep for *_, sep in specs))])


def p8_report(spark, sf_dir: str) -> DataFrame:
    docs, specs = _tables(spark, sf_dir)
    sep = max(s for *_, s in specs)
    jobs = [(name, [cap], s) for name, cap, s in specs] + [("joint", [cap for _, cap, _ in specs], sep)]
    return report(pack(docs, jobs), {name: s for name, _, s in jobs})


def invariants(packed: DataFrame, separators: dict[str, int]) -> DataFrame:
    """(spec_id, texts, over_full, misplaced, cut_too_early, well_filled): texts placed; containers above their capacity with
    their separators; texts whose pieces overlap or leave gaps; small texts that were cut; whether 98 % of the room is used, one container aside, which takes what is left."""
    sep = F.create_map(*[F.lit(x) for k, v in separators.items() for x in (k, v)])
    box = packed.groupBy("spec_id", "container_id").agg(F.max("capacity_tokens").alias("cap"), (F.sum(F.col("end_token") - F.col("start_token")) + (F.count(F.lit(1)) - 1) * F.max(sep[F.col("spec_id")])).alias("held"))
    boxes = box.groupBy("spec_id").agg(F.count_if(F.col("held") > F.col("cap")).alias("over_full"), (F.sum("held") >= 0.98 * (F.sum("cap") - F.max("cap"))).alias("well_filled"), F.max("cap").alias("top"))
    text = packed.where("doc_id is not null").groupBy("spec_id", "doc_id").agg(F.max("end_token").alias("n"), F.sum(F.col("end_token") - F.col("start_token")).alias("placed"), F.count(F.lit(1)).alias("pieces"), F.countDistinct("start_token").alias("starts"), F.min("start_token").alias("first"))
    texts = text.join(boxes.select("spec_id", "top"), "spec_id").groupBy("spec_id").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if((F.col("n") != F.col("placed")) | (F.col("pieces") != F.col("starts")) | (F.col("first") != 0)).alias("misplaced"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= F.col("top"))).alias("cut_too_early"),
    )
    return texts.join(boxes, "spec_id").select("spec_id", "texts", "over_full", "misplaced", "cut_too_early", "well_filled")


def p8_invariants(spark, sf_dir: str) -> DataFrame:
    """What holds of every packing, each capacity by itself."""
    _, specs = _tables(spark, sf_dir)
    return invariants(p8_pack(spark, sf_dir), {name: sep for name, _, sep in specs})


QUERIES = {"p8_pack": p8_pack, "p8_joint": p8_joint, "p8_report": p8_report, "p8_invariants": p8_invariants}
ORACLE = {
    "p8_invariants": """select distinct spec_id, (select count(*) from documents where text <> '') as texts, 0::bigint as over_full, 0::bigint as misplaced,
      0::bigint as cut_too_early, true as well_filled from pack_specs where capacity_tokens > 0""",
}
