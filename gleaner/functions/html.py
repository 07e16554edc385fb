"""What a page's HTML holds, taken in one pass of the standard library's lenient parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.functions.urls import ASSET_SUFFIXES

_SKIPPED = frozenset({"script", "style", "noscript", "svg"})
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Link schemes that name no page, and what an e-mail address looks like.
_NO_LINK = ("mailto:", "tel:", "javascript:", "sms:", "fax:")
_EMAIL = re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}")
SCHEMA = "title string, headings array<string>, canonical_url string, html_lang string, outgoing_links array<string>, body string"


def normalize(url: str, base: str | None = None) -> str:
    """A URL, relative to ``base`` or absolute, in one spelling. Raises ValueError where it can't be read."""
    p = urlsplit(urljoin(base, url) if base else url)
    scheme = "https" if p.scheme.lower() in ("http", "https", "") else p.scheme.lower()
    return urlunsplit((scheme, p.netloc.lower().rpartition("@")[2], p.path or "/", p.query, ""))


def is_page(url: str) -> bool:
    p = urlsplit(url)
    return p.scheme in ("http", "https") and not p.path.lower().endswith(ASSET_SUFFIXES)


class PageParser(HTMLParser):
    """Collects title, headings, canonical link, language, links and text.

    Text inside script, style, noscript and svg isn't text of the page, nor are links there; the page's text is that of
    ``main`` where there is one, else of ``body``, else all.
    """

    def __init__(self, skipped: frozenset[str] = _SKIPPED) -> None:
        super().__init__(convert_charrefs=True)
        self.skipped = skipped
        self.title: list[str] | None = None
        self.headings: list[list[str]] = []
        self.canonical = self.lang = None
        self.links: list[str] = []
        self.text: dict[str, list[str]] = {"all": [], "body": [], "main": []}
        self.seen: set[str] = set()
        self.open: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "html" and self.lang is None:
            self.lang = a.get("lang") or ""
        if tag == "link" and self.canonical is None and "canonical" in (a.get("rel") or "").lower().split() and a.get("href"):
            self.canonical = a["href"]
        if tag == "a" and a.get("href") is not None and not self.skipped.intersection(self.open):
            self.links.append(a["href"].strip())
        if tag in _VOID:
            return
        if tag in ("h1", "h2", "h3"):
            self.headings.append([])
        if tag == "title" and self.title is None:
            self.title = []
        if tag == "main" and "main" in self.seen:
            tag = "main (another)"  # the page's text is that of the first
        self.seen.add(tag)
        self.open.append(tag)

    def handle_endtag(self, tag):
        if tag == "main" and tag not in self.open:
            tag = "main (another)"
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if "title" in self.open and self.title is not None and "svg" not in self.open:
            self.title.append(data)
        if self.headings and any(h in self.open for h in ("h1", "h2", "h3")):
            self.headings[-1].append(data)
        if self.skipped.intersection(self.open):
            return
        self.text["all"].append(data)
        for area in ("body", "main"):
            if area in self.open:
                self.text[area].append(data)


def _joined(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


def extract(html: str | None, fetched_url: str) -> dict:
    """All fields of one page. A malformed link is dropped by itself; without a title the URL stands for it."""
    p = PageParser()
    p.feed(html or "")
    p.close()
    links = set()
    for href in p.links:
        if href.lower().startswith(_NO_LINK) or _EMAIL.fullmatch(href):
            continue
        try:
            url = normalize(href, fetched_url)
            if is_page(url):
                links.add(url)
        except ValueError:
            continue
    try:
        canonical = normalize(p.canonical, fetched_url) if p.canonical else fetched_url
    except ValueError:
        canonical = fetched_url
    area = "main" if "main" in p.seen else "body" if "body" in p.seen else "all"
    return {
        "title": _joined(p.title) if p.title is not None else fetched_url,
        "headings": [h for h in map(_joined, p.headings) if h],
        "canonical_url": canonical,
        "html_lang": p.lang or "",
        "outgoing_links": sorted(links),
        "body": _joined(p.text[area]),
    }


#: Parts of a page that don't belong to its text when it is read for a summary.
FRAME = frozenset({"nav", "footer", "header"})


def readable_text(html: str | None) -> str:
    """A page's text without scripts, styles, drawings and the frame around it."""
    p = PageParser(_SKIPPED | FRAME)
    p.feed(html or "")
    p.close()
    return _joined(p.text["main" if "main" in p.seen else "body" if "body" in p.seen else "all"])


def extract_pages(pages: DataFrame, html_col: str = "html", url_col: str = "fetched_url") -> DataFrame:
    """``pages`` with the extracted fields beside; fields of the same name are replaced. Null HTML is an empty page."""
    new = [f.split()[0] for f in SCHEMA.split(", ")]
    kept = [c for c in pages.columns if c not in new]
    own = pages.select(*[f"`{c}`" for c in kept])
    kinds = {"headings": pa.list_(pa.string()), "outgoing_links": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            html, urls = b.column(kept.index(html_col)).to_pylist(), b.column(kept.index(url_col)).to_pylist()
            rows = [extract(h, u or "") for h, u in zip(html, urls)]
            cols = [pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in new]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*kept, *new])

    return own.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in own.dtypes) + ", " + SCHEMA)
