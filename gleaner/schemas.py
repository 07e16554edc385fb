"""Schemas of the engine's relations."""

from __future__ import annotations

RAW_PAGES = (
    "doc_id bigint, url string, fetched_url string, canonical_url string, title string, headings array<string>, body string, "
    "outgoing_links array<string>, language string, is_related boolean, crawl_time string"
)
PREPROCESSED = (
    "doc_id bigint, url string, fetched_url string, canonical_url string, title string, title_tokens array<string>, "
    "heading_tokens array<string>, body_tokens array<string>, body_tokens_preview array<string>, body_length int, "
    "outgoing_links array<string>, crawl_time string, snippet string"
)
DOCS = (
    "doc_id bigint, url string, fetched_url string, canonical_url string, title string, snippet string, title_tokens array<string>, "
    "heading_tokens array<string>, doc_length int, outgoing_links array<string>, crawl_time string"
)
POSTINGS = "term string, doc_id bigint, tf int, doc_length int"
VOCABULARY = "term string, df bigint"
QUERIES = "query_id string, query string, pos bigint"
FRONTIER = "level string, domain string, seq bigint, url string, attempts int"
CLOCK = "domain string, next_time double"
VISITED = "url string, visited_at string, status_code string"
RESULTS = "query_id string, rank int, url string, score string"
