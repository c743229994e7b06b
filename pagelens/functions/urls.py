"""URL functions. A page's links are normalised by the hundred, so the work is done in vectorised UDFs."""

from __future__ import annotations

import ipaddress
import re
import socket
from urllib.parse import parse_qs, parse_qsl, quote, unquote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normal_form_udf, with_singulars

# Fixed values.
DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21}
METADATA_HOSTS = ("metadata.google.internal", "metadata.azure.com", "metadata.azure.internal", "169.254.169.254", "metadata.ec2.internal")
DOCUMENT_EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp")
QUERY_DOCUMENT_EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx")
PATH_NOISE = ("", "html", "htm", "xhtml", "php", "asp", "aspx", "jsp", "xml", "json", "pdf", "rss", "atom")
FILENAME_PATTERN = r"(?i)filename\*?\s*=\s*(?:UTF-8'')?[\"']?([^\"';\r\n]+)[\"']?"

_PLAIN_ESCAPE = re.compile(r"%(2[DdEe]|3[0-9]|4[1-9A-Fa-f]|5[0-9AaFf]|6[1-9A-Fa-f]|7[0-9AaEe])")


def _walk(path: str) -> str:
    """The path without empty, ``.`` and ``..`` segments, and without a slash at its end."""
    kept: list[str] = []
    rooted = path.startswith("/")
    for segment in path.split("/"):
        if segment == ".." and (kept and kept[-1] != ".." or rooted):
            del kept[-1:]
        elif segment not in ("", "."):
            kept.append(segment)
    return ("/" if rooted else "") + "/".join(kept) or "/"


def normalize(url: str | None, base: str | None = None) -> str | None:
    """The form in which URLs are compared; null where there is none.

    Scheme and host in lower case, default port dropped, relative references resolved, escapes of unreserved characters
    decoded in the path, fragment dropped, path segments resolved, query sorted by key (stable), no slash at the end.
    """
    if not url:
        return None
    try:
        parts = urlsplit(urljoin(base, url) if base else url)
        port = parts.port
        if not parts.scheme:
            return None
        host = (parts.hostname or "").lower()
        place = f"[{host}]" if ":" in host else host
        if port and port != DEFAULT_PORTS.get(parts.scheme):
            place += f":{port}"
        if parts.username:
            place = parts.username + (f":{parts.password}" if parts.password else "") + "@" + place
        path = _walk(_PLAIN_ESCAPE.sub(lambda m: chr(int(m[1], 16)), parts.path))
        pairs = sorted(parse_qsl(parts.query, keep_blank_values=True), key=lambda kv: kv[0])
        return urlunsplit((parts.scheme, place, path, urlencode(pairs, quote_via=quote), ""))
    except ValueError:
        return None


def resolve(href: str, page_url: str) -> str | None:
    """The absolute address of a reference; null unless it is http or https."""
    try:
        url = urljoin(page_url, href)
        return url if urlsplit(url).scheme in ("http", "https") else None
    except ValueError:
        return None


def host_of(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


def path_of(url: str) -> str:
    try:
        return urlsplit(url).path
    except ValueError:
        return ""


def is_document(url: str) -> bool:
    """Whether the last path segment has a document's extension."""
    name = path_of(url).rsplit("/", 1)[-1]
    return "." in name and name.rsplit(".", 1)[-1].lower() in DOCUMENT_EXTENSIONS


def in_domains(host: str, domains: frozenset[str] | set[str] | list[str]) -> bool:
    """Whether a host is one of the domains or below one: every suffix of its labels is looked up."""
    labels = host.split(".")
    wanted = set(domains)
    return any(".".join(labels[i:]) in wanted for i in range(len(labels)))


def start_domain(url: str) -> str:
    """The domain a crawl keeps to by default."""
    return host_of(url).removeprefix("www.")


def nested_documents(url: str) -> list[str]:
    """Document addresses that stand in a URL's query."""
    found = []
    for values in parse_qs(urlsplit(url).query).values():
        for value in map(unquote, values):
            name = value.rsplit("/", 1)[-1].rsplit("?", 1)[0]
            if value.startswith(("http://", "https://")) and "." in name and name.rsplit(".", 1)[-1].lower() in QUERY_DOCUMENT_EXTENSIONS:
                found.append(value)
    return found


def address_of(host: str) -> ipaddress.IPv4Address | ipaddress.IPv6Address | None:
    """The address that a host spells, in any form a resolver takes for a number; null for names."""
    for read in (ipaddress.ip_address, lambda h: ipaddress.ip_address(socket.inet_aton(h))):
        try:
            return read(host)
        except (OSError, ValueError):
            continue
    return None


def unsafe_reason(url: str) -> str | None:
    """Why a URL must not be fetched; null if it may."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower().rstrip(".")
    except ValueError:
        return "unparsable"
    if parts.scheme not in ("http", "https"):
        return f"scheme:{parts.scheme}"
    if host in METADATA_HOSTS:
        return "metadata_host"
    if host == "localhost":
        return "localhost"
    address = address_of(host)
    if address is not None and (not address.is_global or address.is_multicast or address.is_reserved or address.is_loopback or address.is_link_local or address.is_unspecified):
        return f"non_public:{address.compressed}"
    return None


def _series(fn, kind: str):
    def run(values: pd.Series) -> pd.Series:
        return values.map(fn, na_action="ignore")

    return F.pandas_udf(run, kind)


def normalize_udf(url: Column) -> Column:
    return _series(normalize, "string")(url)


def unsafe_reason_udf(url: Column) -> Column:
    return _series(unsafe_reason, "string")(url)


def resolve_udf(href: Column, page_url: Column) -> Column:
    def run(refs: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([None if r is None or p is None else resolve(r, p) for r, p in zip(refs, pages, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(href, page_url)


# Catalyst expressions

def host_expr(url: Column) -> Column:
    """Host in lower case, without user and port; empty for none."""
    return F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def path_expr(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1)


def start_domain_expr(url: Column) -> Column:
    return F.regexp_replace(host_expr(url), r"^www\.", "")


def extension_expr(url: Column) -> Column:
    """Extension of the last path segment in lower case; empty for none."""
    return F.lower(F.regexp_extract(path_expr(url), r"\.([^./]*)$", 1))


def is_document_expr(url: Column) -> Column:
    return extension_expr(url).isin(*DOCUMENT_EXTENSIONS)


def host_suffixes(host: Column) -> Column:
    """The host and every domain above it, for an equality join with a domain list."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def is_web_url(value: Column) -> Column:
    """An http or https URL with a host part."""
    return F.coalesce(value.rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))


def path_tokens(url: Column) -> Column:
    """Ordered distinct words of the path with their singulars, without extensions and single letters."""
    parts = F.split(normal_form_udf(F.regexp_replace(path_expr(url), r"[/\-_.]", " \x01 ")), "\x01")
    words = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: ~p.isin(*PATH_NOISE) & (F.length(p) > 1))
    return with_singulars(words)


def filename_expr(disposition: Column, url: Column) -> Column:
    """A file's suggested name: from the header, else the last path segment with a dot; null for none."""
    named = F.nullif(F.trim(F.regexp_extract(F.coalesce(disposition, F.lit("")), FILENAME_PATTERN, 1)), F.lit(""))
    last = F.nullif(F.regexp_extract(path_expr(url), r"([^/]*\.[^/]*)$", 1), F.lit(""))
    return F.coalesce(named, last)
