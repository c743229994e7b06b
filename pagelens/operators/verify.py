"""Destination checks: the ladder of existence and relevance tests, BM25 over chunks, cosine over given vectors."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.html import PASSWORD_INPUT, plain_text
from pagelens.functions.text import tokens
from pagelens.functions.urls import path_expr, unsafe_reason, unsafe_reason_udf

# Fixed values.
LOGIN_PATHS = ("login", "signin", "sign-in", "sign_in", "auth", "authenticate", "authentication", "session/new", "users/sign_in", "account/login")
MIN_CHUNK = 30
THRESHOLD = 0.3
LEXICAL_EXTRA = 0.15
K1, B = 1.5, 0.75

_LOGIN = re.compile(rf"(?:^|/)(?:{'|'.join(map(re.escape, LOGIN_PATHS))})$")


def is_login_path(url: str) -> bool:
    return _LOGIN.search(urlsplit(url).path.strip("/").lower()) is not None


def login_redirect(chain: Column) -> Column:
    """Whether a redirect led to a page whose path ends like a login page's; chain: array of structs with url."""
    pattern = rf"(?:^|/)(?:{'|'.join(map(re.escape, LOGIN_PATHS))})/*$"
    return F.coalesce(F.exists(chain, lambda hop: F.lower(path_expr(hop["url"])).rlike(pattern)), F.lit(False))


def chunk_tokens(text: str) -> list[list[str]]:
    """Tokens of the text's paragraphs (of MIN_CHUNK characters or more; the whole text if none is so long)."""
    chunks = [p.strip() for p in re.split(r"\n+", text) if len(p.strip()) >= MIN_CHUNK] or [text.strip()]
    return [tokens(c) for c in chunks if c]


def bm25(text: str, terms: list[str]) -> float:
    """Greatest BM25 score of a paragraph.

    The paragraphs stand beside one more one-word filler than there are paragraphs, so every weight is positive.
    """
    chunks, query = chunk_tokens(text), [t for term in terms for t in tokens(term)]
    if not chunks or not query:
        return 0.0
    n = 2 * len(chunks) + 1
    mean = (sum(max(1, len(c)) for c in chunks) + len(chunks) + 1) / n
    counts = [Counter(c) for c in chunks]
    df = Counter(t for c in counts for t in c)
    weight = {t: math.log(n - df[t] + 0.5) - math.log(df[t] + 0.5) for t in query if t in df}
    norm = [K1 * (1 - B + B * max(1, len(c)) / mean) for c in chunks]
    return max(max((sum(weight[t] * c[t] * (K1 + 1) / (c[t] + k) for t in query if c.get(t)) for c, k in zip(counts, norm, strict=True)), default=0.0), 0.0)


def bm25_table(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """page_id, score from a table page_id, chunk_no, words (array of normal tokens): the closed form as aggregates."""
    query = [t for term in terms for t in tokens(term)]
    sizes = chunks.select("page_id", "chunk_no", "words", F.greatest(F.lit(1), F.size("words")).alias("len"))
    pages = sizes.groupBy("page_id").agg(F.count("*").alias("chunks"), F.sum("len").alias("total"))
    pages = pages.select("page_id", (2 * F.col("chunks") + 1).alias("n"), ((F.col("total") + F.col("chunks") + 1) / (2 * F.col("chunks") + 1)).alias("mean"))
    if not query:
        return pages.select("page_id", F.lit(0.0).alias("score"))
    repeats = F.create_map(*(x for t, k in Counter(query).items() for x in (F.lit(t), F.lit(float(k)))))
    words = F.filter("words", lambda w: w.isin(*set(query)))
    hits = sizes.select("page_id", "chunk_no", "len", F.explode(words).alias("word")).groupBy("page_id", "chunk_no", "len", "word").agg(F.count("*").alias("tf"))
    df = hits.groupBy("page_id", "word").agg(F.count("*").alias("df"))
    known = hits.join(df, ["page_id", "word"]).join(pages, "page_id")
    weight = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    part = F.element_at(repeats, F.col("word")) * weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    best = known.groupBy("page_id", "chunk_no").agg(F.sum(part).alias("s")).groupBy("page_id").agg(F.max("s").alias("score"))
    return pages.select("page_id").join(best, "page_id", "left").select("page_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def relevance(html: Column, terms: list[str]) -> Column:
    """BM25 of each page's visible text."""

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: bm25(plain_text(h or ""), terms)).astype(float)

    return F.pandas_udf(run, "double")(html)


def ladder(snapshots: DataFrame, terms: list[str], goal_type: str, mode: str = "relevance", threshold: float = THRESHOLD, similarity: str | None = None) -> DataFrame:
    """Add passed, score and reason to candidates with url, status, redirect_chain, html (null for binary bodies) and
    content_length. In full mode ``similarity`` names a column of given similarities; without one BM25 has a higher bar."""
    if mode == "off":
        return snapshots.withColumns({"passed": F.lit(True), "score": F.lit(None).cast("double"), "reason": F.lit("verification_disabled")})
    page = F.coalesce(F.col("html"), F.lit("")) != ""
    unsafe = unsafe_reason_udf(F.col("url"))
    why = [
        F.when(F.col("_unsafe").isNotNull(), F.concat(F.lit("unsafe_url: "), F.col("_unsafe"))),
        F.when(F.col("status").isNull(), "fetch_failed"),
        F.when(~F.col("status").between(200, 299), F.concat(F.lit("http_"), F.col("status").cast("string"))),
        F.when(login_redirect(F.col("redirect_chain")), "login_wall_redirect"),
        F.when(page & F.col("html").rlike(PASSWORD_INPUT), "login_wall_form"),
        F.when(F.col("content_length") == 0, "empty_response"),
        F.when(F.lit(mode == "existence"), "ok_existence"),
        F.when(page & F.lit(goal_type == "document_link"), "html_not_document"),
        F.when(~page, "ok_existence_binary"),
    ]
    rows = snapshots.withColumn("_unsafe", unsafe).withColumn("_early", F.coalesce(*why))
    bar = min(1.0, threshold + LEXICAL_EXTRA) if mode == "full" and similarity is None else threshold
    score = F.col(similarity) if mode == "full" and similarity else relevance(F.when(F.col("_early").isNull(), F.col("html")), terms)
    rows = rows.withColumn("score", F.when(F.col("_early").isNull(), score))
    late = F.when(F.col("score") >= bar, "ok_relevance").otherwise(F.concat(F.lit("score_below_threshold:"), F.format_string("%.3f", "score")))
    rows = rows.withColumn("reason", F.coalesce("_early", late))
    return rows.withColumn("passed", F.col("reason").startswith("ok_")).drop("_unsafe", "_early")


def check_one(url: str, snapshot: dict | None, terms: list[str], goal_type: str, mode: str = "relevance", threshold: float = THRESHOLD) -> tuple[bool, float | None, str]:
    """The ladder for one candidate of a crawl; the snapshot has status, redirects, html, content_length and plain."""
    if mode == "off":
        return True, None, "verification_disabled"
    bad = unsafe_reason(url)
    if bad:
        return False, None, f"unsafe_url: {bad}"
    if snapshot is None:
        return False, None, "fetch_failed"
    html = snapshot.get("html") or ""
    if not 200 <= snapshot["status"] < 300:
        return False, None, f"http_{snapshot['status']}"
    if any(is_login_path(u) for u in snapshot.get("redirects") or []):
        return False, None, "login_wall_redirect"
    if re.search(PASSWORD_INPUT, html):
        return False, None, "login_wall_form"
    if snapshot.get("content_length") == 0:
        return False, None, "empty_response"
    if mode == "existence":
        return True, None, "ok_existence"
    if html and goal_type == "document_link":
        return False, None, "html_not_document"
    if not html:
        return True, None, "ok_existence_binary"
    score = bm25(plain_text(html), terms)
    bar = min(1.0, threshold + LEXICAL_EXTRA) if mode == "full" else threshold
    return score >= bar, score, "ok_relevance" if score >= bar else f"score_below_threshold:{score:.3f}"


def _chunks(pages: DataFrame, column: str, read: Callable[[str], str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, number, words = [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                for n, c in enumerate(chunk_tokens(read(value or ""))):
                    owner.append(i)
                    number.append(n)
                    words.append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(words, pa.list_(pa.string()))], names=["page_id", "chunk_no", "words"])

    return pages.select("page_id", column).mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, chunk_no int, words array<string>")


def page_chunks(pages: DataFrame) -> DataFrame:
    """page_id, chunk_no, words of every page's visible text, for :func:`bm25_table`."""
    return _chunks(pages, "html", plain_text)


def text_chunks(texts: DataFrame) -> DataFrame:
    """page_id, chunk_no, words of every plain text, for :func:`bm25_table`."""
    return _chunks(texts, "text", str)
