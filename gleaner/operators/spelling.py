"""Spelling correction of query terms against the vocabulary, as joins on equal keys.

Unknown terms meet the vocabulary by deletion neighbourhoods: two terms within n edits (a swap is one) have a form in common
that is made by deleting at most n letters of each, so the keys are hashes of such forms, beside the first letter, which has to
agree. No key holds more than the terms around one form, however large the vocabulary. A native distance prefilter that never
rejects a right pair goes next, and the exact distance with transpositions decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.distance import damerau_column, within
from gleaner.functions.text import TOWN


def allowed(term: Column, most: int = 2) -> Column:
    """Edits a term may be away: one up to five letters, else ``most``."""
    return F.when(F.length(term) <= 5, 1).otherwise(most)


def correctable(term: Column) -> Column:
    return (F.length(term) > 3) & ~term.rlike(r"^\p{Nd}+$") & (term != TOWN)


def deletions(term: Column, n: int) -> Column:
    """All forms of a term with at most ``n`` letters deleted."""
    shorter = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1)))
    out = last = F.array(term)
    for _ in range(n):
        last = F.array_distinct(F.flatten(F.transform(F.filter(last, lambda t: F.length(t) > 0), shorter)))
        out = F.array_union(out, last)
    return out


def candidates(unknown: DataFrame, vocab: DataFrame, most: int = 2) -> DataFrame:
    """(token, term, df, dist) for the distinct tokens of ``unknown``: vocabulary terms within the permitted edits."""
    t = unknown.select("token").distinct().where(correctable(F.col("token"))).withColumn("d", allowed(F.col("token"), most))
    form = lambda c, few: F.explode(F.transform(F.when(few, deletions(F.col(c), 1)).otherwise(deletions(F.col(c), most)), lambda x: F.xxhash64(F.substring(c, 1, 1), x)))
    t = t.withColumn("form", form("token", F.col("d") == 1))
    # tokens that may be two edits away have six letters at least, so shorter terms than four are never two away
    v = vocab.where("term != ''").select("term", "df", form("term", F.length("term") < 4).alias("form"))
    near = v.join(t, "form").where(F.substring("term", 1, 1) == F.substring("token", 1, 1))
    near = near.where((F.abs(F.length("term") - F.length("token")) <= F.col("d")) & within(F.col("token"), F.col("term"), F.col("d"))).select("token", "term", "df", "d").distinct()
    return near.withColumn("dist", damerau_column("token", "term")).where("dist <= d").select("token", "term", "df", "dist")


def corrections(analysed: DataFrame, vocab: DataFrame, most: int = 2) -> DataFrame:
    """(token, corrected): the nearest, then most frequent, then shortest, then first term for each unknown token."""
    tokens = analysed.select(F.explode("query_tokens").alias("token")).distinct()
    unknown = tokens.join(vocab, F.col("token") == F.col("term"), "left_anti")
    rank = F.struct(F.col("dist"), -F.col("df"), F.length("term"), F.col("term"))
    return candidates(unknown, vocab, most).groupBy("token").agg(F.min_by("term", rank).alias("corrected"))


def correct(analysed: DataFrame, vocab: DataFrame, most: int = 2) -> DataFrame:
    """``analysed`` with corrected ``query_tokens`` and the former ones as ``entered_tokens``, in their order."""
    place = analysed.select("query_id", F.posexplode("query_tokens").alias("i", "token"))
    fixed = place.join(corrections(analysed, vocab, most), "token", "left").withColumn("t", F.coalesce("corrected", "token"))
    lists = fixed.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]).alias("fixed"))
    empty = F.array().cast("array<string>")
    return analysed.withColumnRenamed("query_tokens", "entered_tokens").join(lists, "query_id", "left").withColumn("query_tokens", F.coalesce("fixed", empty)).drop("fixed")


def shown_corrections(corrected: DataFrame, words: Column | None = None) -> DataFrame:
    """(query_id, entered, corrected) for each place where a token was changed. ``words`` are the query's words before stemming, in
    the tokens' places: what was typed is shown, not its stem."""
    typed = F.col("entered_tokens") if words is None else words
    shown = lambda x, i: F.struct(F.coalesce(F.get(typed, i), x["was"]).alias("entered"), x["now"].alias("corrected"), (x["was"] != x["now"]).alias("changed"))
    pairs = F.transform(F.arrays_zip(F.col("entered_tokens").alias("was"), F.col("query_tokens").alias("now")), shown)
    return corrected.select("query_id", F.inline(F.filter(pairs, lambda p: p["changed"]))).drop("changed")
