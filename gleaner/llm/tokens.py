"""Sizes of texts in tokens of a public tokenizer. The vocabulary file is a parameter; it is read on each executor."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rank file of a byte-level BPE and the pattern that splits text before its merges (fixed by that vocabulary).
VOCABULARY = os.environ.get("GLEANER_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(documents: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of tokens of the whole text; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary).encode_ordinary
        for b in batches:
            n = pa.array([len(enc(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keep, "tokens"])

    own = documents.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in own.dtypes[:-1])
    return own.mapInArrow(run, f"{schema}, tokens bigint")
