"""Page features: one vectorised parse a page gives title, text and links; the rest is DataFrame work.

html is the wide column and is gone after this step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import html as page_html
from pagelens.functions.urls import is_document_expr

# Fixed values.
CHALLENGE_STATUSES = (200, 403, 429, 503)
CHALLENGE_MARKERS = (
    "challenges.cloudflare.com", "/cdn-cgi/challenge-platform/", "just a moment...", "cf-browser-verification", "_cf_chl_opt", "checking your browser before accessing",
    "enable javascript and cookies to continue", "window._cf_chl_opt", "/hcaptcha.com/", "h-captcha",
)
CHALLENGE_CHARS = 4096

_LINK = pa.struct([("text", pa.string()), ("url", pa.string()), ("norm", pa.string()), ("zone", pa.int32()), ("pos", pa.int32())])
LINK_TYPE = "struct<text:string,url:string,norm:string,zone:int,pos:int>"


def features(pages: DataFrame, most_text: int = page_html.MAX_TEXT) -> DataFrame:
    """page_id, url, title, text, links of every page; null html is an empty page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [page_html.read_page(h, u or "", most_text) for u, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                titles, texts, links = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(titles, pa.string()), pa.array(texts, pa.string()), pa.array(links, pa.list_(_LINK))], names=["page_id", "url", "title", "text", "links"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, title string, text string, links array<{LINK_TYPE}>")


def sanitized(pages: DataFrame) -> DataFrame:
    """page_id and html without what a reader does not see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [page_html.to_html(page_html.sanitize(page_html.parse(h or ""))) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["page_id", "html"])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, html string")


def links(pages: DataFrame) -> DataFrame:
    """A row for each link of each page: page_id, text, link_url, norm_url, zone, pos."""
    rows = features(pages).select("page_id", F.explode("links").alias("l"))
    return rows.select("page_id", F.col("l.text").alias("text"), F.col("l.url").alias("link_url"), F.col("l.norm").alias("norm_url"), F.col("l.zone").alias("zone"), F.col("l.pos").alias("pos"))


def distinct_links(found: DataFrame, most: int = page_html.MAX_LINKS) -> DataFrame:
    """Each address of a page once, the first by zone and position; at most so many, renumbered from 1 (link_no)."""
    first = Window.partitionBy("page_id", "norm_url").orderBy("zone", "pos")
    order = Window.partitionBy("page_id").orderBy("zone", "pos")
    once = found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return once.withColumn("link_no", F.row_number().over(order)).filter(F.col("link_no") <= most)


def is_success(status):
    return (status >= 200) & (status < 300)


def is_challenge(status, html):
    """Whether a response is a bot challenge: a status that challenges use and a marker near the start."""
    head = F.lower(F.substring(html, 1, CHALLENGE_CHARS))
    marked = F.lit(False)
    for marker in CHALLENGE_MARKERS:
        marked = marked | head.contains(marker)
    return F.coalesce(status.isin(*CHALLENGE_STATUSES) & marked, F.lit(False))


def has_password_form(html):
    return F.coalesce(html.rlike(page_html.PASSWORD_INPUT), F.lit(False))


def page_kind(pages: DataFrame, url: str = "url") -> DataFrame:
    """Marks documents, which are not parsed as pages."""
    return pages.withColumn("is_document", is_document_expr(F.col(url)))
