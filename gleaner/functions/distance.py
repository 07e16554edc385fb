"""Edit distance with transpositions (unrestricted Damerau-Levenshtein), exact, behind a native prefilter."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import IntegerType


def damerau(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and transpositions, where letters may stand between the swapped ones."""
    far = len(a) + len(b)
    last: dict[str, int] = {}
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            same = a[i - 1] == b[j - 1]
            if same:
                match = j
            d[i + 1][j + 1] = min(d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + i - k - 1 + 1 + j - m - 1)
        last[a[i - 1]] = i
    return d[-1][-1]


@F.pandas_udf(IntegerType())
def damerau_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else damerau(x, y) for x, y in zip(a, b)], dtype="Int32")


def within(a: Column, b: Column, most: Column) -> Column:
    """Native test that never rejects a pair within ``most`` (at most two) edits with transpositions (a swap costs two without).
    The distance is given up beyond four."""
    d = F.levenshtein(a, b, 4)
    return (d >= 0) & (d <= 2 * most)
