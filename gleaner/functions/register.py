"""The engine's own functions for SQL texts."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gleaner.functions import text
from gleaner.functions.distance import damerau_column
from gleaner.functions.porter import stem_column, stem_tokens


def register(spark: SparkSession) -> list[str]:
    """Make ``stem``, ``stem_all``, ``damerau`` and ``nfkd_plain`` callable from ``spark.sql``."""
    functions = {"stem": stem_column, "stem_all": stem_tokens, "damerau": damerau_column, "nfkd_plain": text._nfkd}
    for name, f in functions.items():
        spark.udf.register(name, f)
    return sorted(functions)
