"""One row a key, without shuffling wide rows whose key stands once where there are many of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.session import materialize

#: Keys that stand more than once up to which they are broadcast (8 bytes each).
BROADCAST_KEYS = 500_000
#: Rows up to which all are simply brought together by key: so few cost little to shuffle, and gain by being spread over the
#: tasks when they come from few files. Both ways give the same rows.
FEW_ROWS = 50_000


def one_per_key(rows: DataFrame, key: str, best: Column) -> DataFrame:
    """Of each key's rows the one with the greatest ``best``; rows with a null key are left out.

    Beyond ``FEW_ROWS`` the keys alone are counted first. Rows whose key stands once go straight through; only the others,
    usually few, are brought together. So wide rows (texts, token lists) are read again instead of shuffled.
    """
    rest = [c for c in rows.columns if c != key]
    pick = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), best).alias("_r")
    if rows.count() <= FEW_ROWS:
        return rows.where(F.col(key).isNotNull()).groupBy(key).agg(pick).select(key, "_r.*").select(*rows.columns)
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    many = materialize(counted.where("_n > 1").select(key), "repeated")
    if many.count() <= BROADCAST_KEYS:
        many = F.broadcast(many)
    again = rows.join(many, key, "left_semi").groupBy(key).agg(pick)
    once = rows.where(F.col(key).isNotNull()).join(many, key, "left_anti")
    return once.select(*rows.columns).unionByName(again.select(key, "_r.*").select(*rows.columns))
