"""URL functions as Column expressions: normal form, keys, hosts, domains and predicates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# File endings that never hold a page, and public suffixes of two labels.
ASSET_SUFFIXES = (
    ".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".exe", ".dmg",
    ".zip", ".rar", ".tar", ".gz", ".7z", ".jpg", ".jpeg", ".png", ".gif",
    ".bmp", ".webp", ".svg", ".ico", ".mp3", ".mp4", ".avi", ".mov", ".wav",
    ".css", ".js", ".json", ".xml", ".rss", ".woff", ".woff2", ".ttf", ".eot",
    ".py", ".pyc", ".ipynb", ".whl", ".jar", ".war", ".csv",
)
TWO_LABEL_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "net.uk",
    "co.jp", "ne.jp", "or.jp",
    "com.au", "net.au", "org.au",
    "co.nz", "co.za", "co.in", "co.at", "or.at",
    "com.br", "com.mx", "com.tr", "com.cn",
)
BLACKLIST = ("archive.org",)

# RFC 3986, appendix B: scheme, authority, path, query, fragment.
_PARTS = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_part(url: Column, part: str) -> Column:
    """One raw part of a URL; empty where it has none, null for a null URL."""
    return F.regexp_extract(url, _PARTS, {"scheme": 1, "authority": 2, "path": 3, "query": 4}[part])


def host(url: Column) -> Column:
    """Lower-case host without user and port; empty where the URL has none, null for null."""
    return F.regexp_replace(F.lower(url_part(F.trim(url), "authority")), r"^.*@|:\d*$", "")


def registrable_domain(url: Column) -> Column:
    """Last two labels of the host, three under a known two-label suffix; hosts of one label stay whole."""
    suffixes = "|".join(s.replace(".", r"\.") for s in TWO_LABEL_SUFFIXES)
    # one pattern, so that compiled plans that use a domain several times stay small; the leftmost match is the longest
    return F.regexp_extract(host(url), rf"(?s)(?:(?:[^.]*\.)?(?:{suffixes})|[^.]*\.[^.]*|^[^.]*)\z", 0)


def site(url: Column) -> Column:
    """The last two labels of the host; null for null URLs and URLs without a host."""
    return F.nullif(F.substring_index(host(url), ".", -2), F.lit(""))


def normalize_url(url: Column) -> Column:
    """Absolute URLs in one spelling: http(s) as https, host in lower case, no user, no fragment, '/' for no path."""
    scheme = F.lower(url_part(url, "scheme"))
    path = url_part(url, "path")
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]+)", 1)
    return F.concat(
        F.when(scheme.isin("http", "https", ""), F.lit("https")).otherwise(scheme),
        F.lit("://"),
        F.regexp_replace(F.lower(url_part(url, "authority")), r"^.*@", ""),
        F.when(path == "", F.lit("/")).otherwise(path),
        query,
    )


def url_key(url: Column) -> Column:
    """Key under which two URLs are one page: the normal form without slashes at its end."""
    return F.regexp_replace(normalize_url(url), "/+$", "")


def is_page_url(url: Column) -> Column:
    """Whether the URL is http(s) and its path doesn't end as an asset does."""
    endings = "|".join(s.replace(".", r"\.") for s in ASSET_SUFFIXES)
    path = F.lower(url_part(url, "path"))
    return F.lower(url_part(url, "scheme")).isin("http", "https") & ~path.rlike(f"(?:{endings})$")


def is_blacklisted(domain: Column, blacklist: tuple[str, ...] = BLACKLIST) -> Column:
    """Whether a domain is on the list or below an entry of it."""
    d, out = F.lower(domain), F.lit(False)
    for b in blacklist:
        out = out | (d == b) | d.endswith("." + b)
    return out
