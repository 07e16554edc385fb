"""Pieces of DuckDB SQL that the queries' twins share."""

from __future__ import annotations

from gleaner.functions import text as T
from gleaner.functions.urls import ASSET_SUFFIXES, TWO_LABEL_SUFFIXES


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP = "[" + ", ".join(map(quote, T.STOPWORDS)) + "]"


def tokens(x: str) -> str:
    t = f"coalesce({x}, '')"
    for pattern in ("tübingen", r"\btuebingen\b", r"\btubingen\b", r"\bt(?:ü|Ã¼|ã¼|ãœ|ăź)bingen\b"):
        t = f"regexp_replace({t}, {quote(pattern)}, 'tubingen', 'gi')"
    t = f"lower(translate({t}, {quote(T._FROM)}, {quote(T._TO)}))"
    return f"list_filter(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1 and not list_contains({STOP}, w))"


#: Latest delivery of each page, preprocessed pages without repeats, and their index tables.
PAGES = "pages as (select * from (select *, row_number() over (partition by doc_id order by ingested_at desc, coalesce(body, '') desc, coalesce(title, '') desc, coalesce(url, '') desc, coalesce(canonical_url, '') desc, coalesce(fetched_url, '') desc, coalesce(language, '') desc) as _r from raw_pages where doc_id is not null) where _r = 1)"
DOCS = """docs as (select doc_id, coalesce(url, '') as url, coalesce(fetched_url, '') as fetched_url, coalesce(canonical_url, '') as canonical_url,
  coalesce(title, '') as title, coalesce(snippet, '') as snippet, coalesce(title_tokens, []) as title_tokens, coalesce(heading_tokens, []) as heading_tokens,
  coalesce(body_tokens, []) as body_tokens, coalesce(body_length, len(coalesce(body_tokens, []))) as doc_length, coalesce(outgoing_links, []) as outgoing_links
  from (select *, row_number() over (partition by doc_id order by coalesce(body_length, len(coalesce(body_tokens, []))) desc, coalesce(url, '') desc,
    coalesce(canonical_url, '') desc, coalesce(title, '') desc, len(coalesce(outgoing_links, [])) desc) as _r from preprocessed_pages) where _r = 1)"""
POSTINGS = """places as (select doc_id, doc_length, unnest(list_concat(list_concat(title_tokens, heading_tokens), body_tokens)) as term from docs),
postings as (select term, doc_id, doc_length, count(*) as tf from places where term is not null group by all),
vocab as (select term, count(*) as df from postings group by term),
stats as (select count(*) as n, avg(doc_length::double) as avgdl from docs)"""
ANALYSED = f"""asked as (select query_id, arg_min(query, pos) as query, min(pos) as pos from queries where query_id is not null group by query_id),
analysed as (select query_id, query, pos, {tokens('query')} as toks from asked)"""
SPELLED = """place as (select query_id, unnest(toks) as token, unnest(range(len(toks))) as i from analysed),
unknown as (select distinct token, case when length(token) <= 5 then 1 else 2 end as d from place
  where token not in (select term from vocab) and length(token) > 3 and not regexp_full_match(token, '\\p{Nd}+') and token <> 'tubingen'),
near as (select token, term, df, damerau_levenshtein(token, term) as dist, d from unknown join vocab
  on left(token, 1) = left(term, 1) and abs(length(token) - length(term)) <= d),
fixes as (select token, corrected from (select token, term as corrected, row_number() over (partition by token order by dist, df desc, length(term), term) as r from near where dist <= d) where r = 1),
corrected as (select a.query_id, a.query, a.pos, a.toks as entered, coalesce(f.fixed, []) as toks from analysed a left join
  (select query_id, list(coalesce(corrected, token) order by i) as fixed from place left join fixes using (token) group by query_id) f using (query_id))"""
BM25 = """terms as (select query_id, unnest(list_distinct(toks)) as term from corrected),
hits as (select query_id, doc_id, term, ln(1.0::double + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.2::double) /
  (tf + 1.2::double * (0.25::double + 0.75::double * doc_length / avgdl)) as w from terms join vocab using (term) join postings using (term), stats),
scored as (select query_id, doc_id, sum(w) as bm25, list(distinct term order by term) as matched from hits group by query_id, doc_id),
best as (select *, round(bm25, 4) as bm25_score, row_number() over (partition by query_id order by round(bm25, 9) desc, doc_id) as bm25_rank from scored qualify bm25_rank <= 100)"""
RERANK = f"""joined as (select b.*, d.url, d.fetched_url, d.canonical_url, d.title, c.toks,
   2.0::double * len(list_filter(case when len(d.title_tokens) > 0 then d.title_tokens else {tokens('d.title')} end, lambda t: list_contains(c.toks, t)))
   + len(list_filter(d.heading_tokens, lambda t: list_contains(c.toks, t))) as raw
   from best b join docs d using (doc_id) join corrected c using (query_id)),
normed as (select *, least(1.0::double, raw / 3.0::double) as field, min(bm25_score) over (partition by query_id) as lo, max(bm25_score) over (partition by query_id) as hi from joined),
final as (select *, round(0.7::double * nb + 0.3::double * field, 4) as score from
   (select *, case when hi = lo then case when hi > 0 then 1.0::double else 0.0::double end else (bm25_score - lo) / (hi - lo) end as nb from normed)),
ranked as (select *, row_number() over (partition by query_id order by score desc, bm25_rank) as rank from final)"""
INDEX = f"{DOCS},\n{POSTINGS}"
SEARCH = f"with {INDEX},\n{ANALYSED},\n{SPELLED},\n{BM25}"

_AUTHORITY = "regexp_extract({u}, '^(?:[^:/?#]+:)?//([^/?#]*)', 1)"


def authority(u: str) -> str:
    return _AUTHORITY.format(u=u)


def host(u: str) -> str:
    return f"regexp_replace(lower({authority(f'trim({u})')}), '^.*@|:[0-9]*$', '', 'g')"


def domain(u: str) -> str:
    h = host(u)
    two = f"array_to_string(string_split({h}, '.')[-2:], '.')"
    return f"case when {u} is null then null when len(string_split({h}, '.')) <= 2 then {h} when {two} in ({', '.join(map(quote, TWO_LABEL_SUFFIXES))}) then array_to_string(string_split({h}, '.')[-3:], '.') else {two} end"


def path(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)"


def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '^([^:/?#]+):', 1))"


def normal(u: str) -> str:
    return (
        f"case when {scheme(u)} in ('http', 'https', '') then 'https' else {scheme(u)} end || '://' || regexp_replace(lower({authority(u)}), '^.*@', '') || "
        f"case when {path(u)} = '' then '/' else {path(u)} end || regexp_extract({u}, '^[^?#]*(\\?[^#]+)', 1)"
    )


def key(u: str) -> str:
    return f"regexp_replace({normal(u)}, '/+$', '')"


def is_page(u: str) -> str:
    endings = "|".join(s.replace(".", "\\.") for s in ASSET_SUFFIXES)
    return f"({scheme(u)} in ('http', 'https') and not regexp_matches(lower({path(u)}), '(?:{endings})$'))"
