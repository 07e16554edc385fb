"""Columns that explain a result: terms found and missing, marks, summaries, reasons, contexts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gleaner.functions.text import clean_spaces, sentences

# The sentences that explain a result, by what they rest on.
REASONS = {
    "title": "Matched query term in title: ",
    "heading": "Matched query term in headings: ",
    "url": "Matched query term in URL",
    "terms": "Matched indexed terms: ",
    "field": "Title or heading Field Boost contributed",
    "prf": "Boosted by PRF terms: ",
    "link": "Internal LinkScore contributed",
    "lsa": "Semantic LSA similarity contributed",
    "none": "BM25 found textual overlap with the query.",
}
EMPTY = "cast(array() as array<string>)"


def unquoted(url: Column) -> Column:
    """Percent signs read back, plus signs kept; URLs that can't be read stay as they are."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def page_text(title: Column, url: Column, snippet: Column, body: Column) -> Column:
    """All text of a result in lower case with the town's spellings made one."""
    low = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (title, unquoted(url), snippet, body)]))
    return F.replace(F.replace(low, F.lit("tübingen"), F.lit("tubingen")), F.lit("tuebingen"), F.lit("tubingen"))


def _quoted(term: Column) -> Column:
    return F.regexp_replace(term, r"([^\p{L}\p{N}])", r"\\$1")


def holds_term(text: Column, term: Column) -> Column:
    """Whether a term stands in the text with no ASCII letter or digit beside it."""
    return F.regexp_like(text, F.concat(F.lit("(?<![a-z0-9])"), _quoted(F.lower(term)), F.lit("(?![a-z0-9])")))


def found_terms(text: Column, terms: Column) -> Column:
    return F.filter(F.array_distinct(terms), lambda t: holds_term(text, t))


def missing_terms(text: Column, terms: Column) -> Column:
    return F.filter(F.array_distinct(terms), lambda t: ~holds_term(text, t))


def escape_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def highlight(text: Column, terms: Column) -> Column:
    """Escaped text with every term of more than two letters marked, longest first, whatever its case, in one pass (so a
    term can't match inside another's mark)."""
    long = F.array_sort(F.array_distinct(F.filter(terms, lambda t: F.length(t) > 2)), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    pattern = F.concat(F.lit("(?iu)("), F.array_join(F.transform(long, _quoted), "|"), F.lit(")"))
    safe = escape_html(text)
    return F.when(F.size(long) > 0, F.regexp_replace(safe, pattern, F.lit("<mark>$1</mark>"))).otherwise(safe)


def smart_summary(rows: DataFrame, analyze, body: str = "body", snippet: str = "snippet", title: str = "title", query_terms: str = "query_terms", prf_terms: str | None = None, key: tuple[str, ...] = ("query_id", "doc_id"), reach: int = 12_000, most: int = 80) -> DataFrame:
    """``key`` and ``summary``: the two sentences that share most terms with the query (3 each), feedback terms (1.5) and
    title (1), in their order; the snippet where none shares any. The reach into the body is the feature's own limit."""
    own = sentences(F.substring(F.coalesce(F.col(body), F.lit("")), 1, reach))
    picked = F.slice(F.when(F.size(own) > 0, own).otherwise(sentences(F.col(snippet))), 1, most)
    base = rows.select(*key, F.col(snippet).alias("_snippet"), F.array_distinct(query_terms).alias("_q"), (F.array_distinct(prf_terms) if prf_terms else F.expr(EMPTY)).alias("_p"), F.array_distinct(analyze(F.col(title))).alias("_t"), picked.alias("_s"))
    one = base.select(*key, "_snippet", "_q", "_p", "_t", F.posexplode_outer("_s").alias("pos", "sentence")).withColumn("_w", F.array_distinct(analyze(F.col("sentence"))))
    shared = lambda c: F.size(F.array_intersect("_w", c))
    scored = one.withColumn("score", 3.0 * shared("_q") + 1.5 * shared("_p") + shared("_t"))
    good = F.when((F.col("score") > 0) & F.col("sentence").isNotNull(), F.struct((-F.col("score")).alias("s"), F.col("pos"), F.col("sentence")))
    top = scored.groupBy(*key).agg(F.max("_snippet").alias("_snippet"), F.slice(F.sort_array(F.collect_list(good)), 1, 2).alias("b"))
    text = F.array_join(F.transform(F.array_sort(F.transform("b", lambda x: F.struct(x["pos"].alias("pos"), x["sentence"].alias("sentence")))), lambda x: x["sentence"]), " ")
    return top.select(*key, F.coalesce(F.nullif(text, F.lit("")), "_snippet", F.lit("")).alias("summary"))


def why_reasons(query: Column, title: Column, heading: Column, body: Column, matched: Column, details: dict[str, Column] | None = None, url: Column | None = None, prf: Column | None = None) -> Column:
    """Sentences that say why a result is there. ``details`` holds the normalised parts of its score that exist, by "field", "prf",
    "link" and "lsa"; ``url`` the terms of its URL, ``prf`` the feedback terms, best first."""
    details = details or {}
    hits = lambda c: F.array_sort(F.array_intersect(F.array_distinct(query), F.coalesce(c, F.expr(EMPTY))))
    body_hits = F.when(F.size(hits(body)) > 0, hits(body)).otherwise(F.array_sort(F.array_distinct(F.coalesce(matched, F.expr(EMPTY)))))
    says = lambda c, s: F.when(F.size(c) > 0, F.concat(F.lit(s), F.array_join(c, ", ")))
    gave = lambda name, s: F.when(details[name] > 0, s) if name in details else F.lit(None).cast("string")
    out = [
        says(hits(title), REASONS["title"]), says(hits(heading), REASONS["heading"]),
        F.when(F.size(hits(url)) > 0, F.lit(REASONS["url"])) if url is not None else F.lit(None).cast("string"),
        says(F.slice(body_hits, 1, 6), REASONS["terms"]), gave("field", F.lit(REASONS["field"])),
        gave("prf", says(F.slice(F.coalesce(prf, F.expr(EMPTY)), 1, 5), REASONS["prf"])) if prf is not None else F.lit(None).cast("string"),
        gave("link", F.lit(REASONS["link"])), gave("lsa", F.lit(REASONS["lsa"])),
    ]
    found = F.array_compact(F.array(*out))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(REASONS["none"])))


def score_value(value: Column) -> Column:
    """A score for display: within 0..1, missing as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.cast("double"), F.lit(0.0))))


def compact_context(text: Column, query: Column, most: int = 24_000) -> Column:
    """A text cut for a prompt: short ones whole, else the first half of the room and, from the rest, sentences with a
    word of the query, or the end where there is none."""
    t = clean_spaces(text)
    half = most // 2
    room = most - half - 80
    words = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(query, F.lit("[A-Za-zÄÖÜäöüß]+"), F.lit(0)), F.lower), lambda w: F.length(w) > 2))
    rest = sentences(F.substring(t, half + 1, 1 << 30), 31, 1 << 30)
    kept = F.array_join(F.filter(rest, lambda s: F.exists(words, lambda w: F.contains(F.lower(s), w))), " ")
    tail = F.when(kept != "", kept).otherwise(F.substring(t, -room, room))
    return F.when(F.length(t) <= most, t).otherwise(clean_spaces(F.concat(F.substring(t, 1, half), F.lit(" ... "), F.substring(tail, 1, room))))


#: Characters below which a page's text is too short to be told about alone, so that a fetched one is preferred.
SHORT_TEXT = 600


def page_context(title: Column, url: Column, snippet: Column, texts: list[Column], query: Column, most: int = 24_000, live: Column | None = None) -> Column:
    """(context, source): what a prompt tells about a page, title, URL, snippet and the first of ``texts`` that isn't blank,
    compacted, and where the text is from. ``live`` is the page's text fetched again (``sources.fetch.live_text``); it is taken
    where the other is shorter than ``SHORT_TEXT`` and than it."""
    body = F.coalesce(*[F.nullif(clean_spaces(t), F.lit("")) for t in [*texts, snippet]], F.lit(""))
    stored = F.when((body != "") & (body != clean_spaces(snippet)), F.lit("crawled page text")).otherwise(F.lit("snippet"))
    fresh = clean_spaces(live) if live is not None else F.lit("")
    better = (F.length(body) < SHORT_TEXT) & (F.coalesce(url, F.lit("")) != "") & (F.length(fresh) > F.length(body))
    shown = F.when(better, fresh).otherwise(body)
    parts = [F.concat(F.lit(name), F.coalesce(c, F.lit(""))) for name, c in (("Title: ", title), ("URL: ", url), ("Snippet: ", snippet), ("Page text: ", compact_context(shown, query, most)))]
    return F.struct(F.concat_ws("\n", *parts).alias("context"), F.when(better, F.lit("live fetched page text")).otherwise(stored).alias("source"))


#: Templates by mode; "custom" carries the user's own instruction. Callers may give others.
PROMPTS = {
    "relevance": "In two or three plain English sentences, tell a person who searched for \"{query}\" what the page below offers them. Rely on the page alone; say so where it has little to do with the search.\n\n{context}",
    "summary": "Sum up the page below in two or three plain English sentences. Rely on the page alone and leave the search that led to it aside.\n\n{context}",
    "custom": "{instruction}\n\nRely on the page below alone; say so where it doesn't hold the answer.\n\n{context}",
}


def prompts(mode: Column, query: Column, context: Column, instruction: Column, templates: dict[str, str] | None = None) -> Column:
    """The prompt of each row by its mode; a "custom" one without an instruction, and unknown modes, ask about relevance."""
    blank = F.trim(F.coalesce(instruction, F.lit(""))) == ""
    asked = F.when((mode == "custom") & blank, F.lit("relevance")).otherwise(F.coalesce(mode, F.lit("relevance")))
    return routed(asked, templates or PROMPTS, "relevance", query=query, context=context, instruction=instruction)


def fill(template: str, **values: Column) -> Column:
    """A text template whose ``{name}`` places are columns, for prompts and messages; nulls fill as empty."""
    out, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        out += [F.lit(template[at : m.start()]), F.coalesce(values[m.group(1)].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))


def routed(mode: Column, templates: dict[str, str], default: str, **values: Column) -> Column:
    """The template of a row's mode filled with its columns; other modes take the one named ``default``."""
    out = None
    for name, template in templates.items():
        if name != default:
            out = F.when(mode == name, fill(template, **values)) if out is None else out.when(mode == name, fill(template, **values))
    last = fill(templates[default], **values)
    return last if out is None else out.otherwise(last)


def adapt_results(rows: DataFrame) -> DataFrame:
    """Results for display: missing scores and ranks filled, matched terms once each in their order."""
    score = F.coalesce(F.col("score"), F.col("bm25_score"), F.lit(0.0))
    w = W.partitionBy("query_id").orderBy(score.desc(), "doc_id")
    return rows.withColumn("rank", F.coalesce("rank", F.row_number().over(w))).withColumn("score", score).withColumn("matched_terms", F.array_distinct(F.coalesce("matched_terms", F.expr(EMPTY))))
