"""Main text of HTML pages: structure first, then differencing against the page with the nearest URL.

A page is cut into text blocks in page order. Containers that hold no article text (menus, page headers and footers,
sidebars, notices, adverts, forms, comments, scripts, styles) are known by element, role, or a word of their class or
id. Pages of a host are ordered by URL path; each is aligned, block by block, with the nearer of the two pages beside it
whose text is not equal to its own, by longest common subsequence (with the other if that one is a copy). Blocks both
have are page furniture and are deleted, unless the page's markup says that they are article text (inside ``article`` or
``main`` and not mostly links): copies of an article keep their text.

A copy says nothing about furniture. It shares most of the text, and the lines that differ tell it from another article
in the same long template: those of a copy are missing on one side, or have nearly the same words (numbers aside). A
page that shares less is taken before one that shares so much; where both share so much, what all of them have goes.

Defined results: null and empty html give an empty text; a null URL is its own host; pages that repeat a URL are
neighbours; rows that repeat a page are each returned; long pages are read whole; an empty table gives no rows; columns
other than page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import save

#: Elements whose content is not text of the page.
UNSEEN = frozenset("script style noscript template svg math iframe object embed audio video canvas head title select option textarea button map datalist".split())
#: Elements that hold page furniture.
FURNITURE = frozenset("nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())
#: Words of a class or id that mark furniture.
MARKS = frozenset(
    "nav navbar navigation menu menus sidebar sidebars footer masthead topbar breadcrumb breadcrumbs ad ads advert adverts advertisement advertising sponsor sponsored promo promos promotion "
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus reply replies respond "
    "share sharing social related recommended recommendations teaser teasers widget widgets pagination pager skip toolbar copyright".split()
)
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements whose classes name parts of code.
CODE = frozenset(("pre", "code"))
#: Unseen elements whose content is not parsed: it ends at the first end tag.
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an end tag of another name does not close.
SCOPES = frozenset("article main section div table td th body nav aside footer header form ul ol".split())

#: A quote that is never closed ends with its tag.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_SPACE = re.compile(r"\s+")
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    article: bool
    furniture: bool
    linked: int


def _is_furniture(tag: str, attributes: str) -> bool:
    """Whether the element's name or attributes say that it holds no article text."""
    if tag in FURNITURE:
        return True
    if not attributes.strip() or tag in ("html", "body"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or (name == "style" and _HIDDEN.search(value)) or (name == "role" and value.strip().lower() in ROLES) or (name == "aria-hidden" and value.strip().lower() == "true"):
            return True
        if name in ("class", "id") and tag not in ARTICLE and any(w.lower() in MARKS for w in _WORDS.findall(value)):
            return True
    return False


@cache
def _ends(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I)


def _after(html: str, tag: str, at: int) -> int | None:
    """Where the element opened before ``at`` ends, elements of its name inside it included; None if it is not closed."""
    depth = 1
    for m in _ends(tag).finditer(html, at):
        if m[1]:
            depth -= 1
            if not depth or tag in RAW:
                return m.end()
        elif not m[0].endswith("/>"):
            depth += 1
    return None


def blocks(html: str) -> list[Block]:
    """Text blocks in page order; open elements close at the end of the page.

    A page header is furniture; of a header inside an article the headings are text. Inline elements that are furniture
    are silent: what they hold belongs to no block.
    """
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # tag, inside an article, 2 inside furniture, 1 inside an article's header
    parts: list[str] = []
    linked, links, at, end, code = 0, 0, 0, len(html), 0
    silent, silent_depth, silent_below = "", 0, 0  # the silent inline element, how often it is open, elements around it

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            article, furniture = stack[-1][1:] if stack else (False, 0)
            out.append(Block(text, article, furniture > 0, linked))
        parts.clear()
        linked = 0

    while at < end:
        m = _TOKEN.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text and not silent:
            text = unescape(text)
            parts.append(text)
            if links:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag == silent:
                silent_depth -= 1
                if not silent_depth:
                    silent = ""
            if tag in CODE:
                code = max(0, code - 1)
            if tag not in INLINE:
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if stack[k][0] in SCOPES and tag not in SCOPES:
                        break
                if silent and len(stack) < silent_below:
                    silent = ""
            continue
        if tag in UNSEEN:
            if tag not in VOID and not m[3].rstrip().endswith("/"):
                close = _after(html, tag, at)
                at = close if close is not None else (end if tag in RAW else at)
            continue
        if tag == "a":
            links += 1
        if tag in CODE:
            code += 1
        if tag in INLINE:
            if silent:
                silent_depth += tag == silent
            elif tag not in VOID and not code and _is_furniture(tag, m[3]):
                silent, silent_depth, silent_below = tag, 1, len(stack)
            continue
        flush()
        if tag in VOID:
            continue
        if tag == "p" and stack and stack[-1][0] == "p":
            stack.pop()
        inside, furniture = stack[-1][1:] if stack else (False, 0)
        if furniture == 1 and tag in HEADINGS:
            furniture = 0
        if tag == "header":
            furniture = max(furniture, 1 if inside else 2)
        if _is_furniture(tag, m[3]):
            furniture = 2
        stack.append((tag, inside or tag in ARTICLE, furniture))
    flush()
    return out


def common_lines(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of a belong to a longest common subsequence with b (bit-parallel, one big integer a line of a)."""
    where: dict[str, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, v = [], full
    for line in a:
        u = v & where.get(line, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    shared = [False] * len(a)
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not (i and not rows[i - 1] >> (j - 1) & 1):
                shared[i] = True
                j -= 1
    return shared


#: Of the text of two pages, the share in common from which one may be a copy of the other; of the words in the lines
#: that differ, the share in common from which it is one.
COPY_SHARE = 0.8


#: Pages in a range, about, and the most ranges: what the driver holds (SAMPLES keys a range for the bounds, four pages'
#: keys a range at its ends) is bounded at any size, beyond it ranges grow. A task streams its range, whatever its size.
RANGE_PAGES = 1000
MAX_RANGES = 20_000
SAMPLES = 20


def _is_copy(own: list[Block], shared: list[bool], other: list[Block]) -> bool:
    """Whether the lines that differ between two pages that share most text are those of an edited copy."""
    mine = Counter(b.text for b, s in zip(own, shared, strict=True) if not s and not b.furniture)
    theirs = Counter(b.text for b in other if not b.furniture) - Counter(b.text for b, s in zip(own, shared, strict=True) if s)
    x, y = (Counter(w for t, n in lines.items() for w in _LETTERS.findall(t.lower()) * n) for lines in (mine, theirs))
    return not x or not y or (x & y).total() >= COPY_SHARE * max(x.total(), y.total())


def _article(own: list[Block], *neighbours: list[Block]) -> str:
    lines = [b.text for b in own]
    whole = sum(len(b.text) for b in own if not b.furniture)
    shared, close = [False] * len(own), []
    for neighbour in neighbours if own else ():
        common = common_lines(lines, [b.text for b in neighbour])
        if not whole or sum(len(b.text) for b, s in zip(own, common, strict=True) if s and not b.furniture) < COPY_SHARE * whole:
            shared = common
            break
        if not _is_copy(own, common, neighbour):
            close.append(common)
    else:
        if close:
            shared = [all(x) for x in zip(*close, strict=True)]
    marked = any(b.article and not b.furniture for b in own)
    kept = []
    for b, s in zip(own, shared, strict=True):
        dense = b.linked * 2 > len(b.text)
        if not b.furniture and (b.article or not marked) and not (s and (dense or not b.article)):
            kept.append(b.text)
    return " ".join(kept)


def main_text(html: str | None, *neighbours: str) -> str:
    """The article of a page; neighbours are pages of the same host, the nearest first: the first that is no copy counts."""
    return _article(blocks(html or ""), *(blocks(n) for n in neighbours))


def _print(own: list[Block]) -> int:
    """Equal for pages whose text outside known furniture is equal."""
    return xxhash.xxh3_64_intdigest("\0".join(b.text for b in own if not b.furniture)) - (1 << 63)


def _segments(path: str) -> list[str]:
    return [x for x in path.split("/") if x]


def nearness(a: str, b: str) -> int:
    """Leading path segments that two URLs of a host share."""
    n = 0
    for x, y in zip(_segments(a), _segments(b), strict=False):
        if x != y:
            break
        n += 1
    return n


@dataclass
class _Page:
    site: tuple[int, str]
    key: str
    page_id: int | None
    url: str | None
    blocks: list[Block]
    print: int


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, page_id, h of rows with a html, and t: equal for equal texts."""
    for batch in batches:
        t = [_print(blocks(h.as_py() or "")) for h in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(t, pa.int64())], names=["key", "page_id", "h", "t"])


def _lent(edges: list, i: int) -> Iterator:
    """What range i needs of others: of the pages before and after it on its first and last host, the nearest two with different texts."""
    for end, far, way in (("hi", "lo", range(i - 1, -1, -1)), ("lo", "hi", range(i + 1, len(edges)))):
        site, seen = edges[i][far]["key"].split("\0")[0], set()
        for k in way:
            for x in (edges[k][end], edges[k][f"{end}2"]):
                if x is not None and x["key"].split("\0")[0] == site and x["t"] not in seen and len(seen) < 2:
                    seen.add(x["t"])
                    yield x
            if len(seen) == 2 or edges[k][far]["key"].split("\0")[0] != site:
                break


def extract(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """page_id, url, text of every page.

    Pages are cut into ranges of (host, path, page_id) by sampled bounds. On each side a range is also sent the two
    nearest pages of the same host with different texts, from however far, so neighbours do not depend on the cut: one
    of them differs from any page. A host may fill many ranges.
    """
    spark = pages.sparkSession
    host = F.coalesce(F.lower(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    key = F.concat(host, F.lit("\0"), path)
    keyed = rows.withColumn("key", key)
    # order of pages with equal keys: page_id, then a hash of the page
    full = keyed.withColumn("h", F.xxhash64("url", "html"))
    keys = save(full.select("key", "page_id", "h", "html").mapInArrow(_prints, "key string, page_id long, h long, t long"), "keys")
    total = keys.count()
    ranges = ranges or min(MAX_RANGES, max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_PAGES))
    if not total:
        return rows.select("page_id", "url", F.lit("").alias("text"))
    share = min(1.0, SAMPLES * max(ranges, 50) / total)  # few ranges are cut by more keys
    sample = sorted((r["key"], -1 if r["page_id"] is None else r["page_id"]) for r in keys.sample(share, seed=1).select("key", "page_id").collect())
    shared = spark.sparkContext.broadcast(sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else [])

    def number(keys: pd.Series, pages: pd.Series) -> pd.Series:
        """How many bounds are not after the row."""
        bounds = shared.value
        return pd.Series([bisect.bisect_right(bounds, (k, -1 if pd.isna(p) else int(p))) for k, p in zip(keys, pages, strict=True)], dtype="int32")

    place = F.pandas_udf(number, "int")

    order = F.struct("key", "page_id", "h", "t")
    placed = keys.withColumn("place", place("key", "page_id"))
    ends = placed.groupBy("place").agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    # beside the first and last page of a range, the nearest of the same host with another text: two rows a range
    other = lambda end: (F.substring_index("key", "\0", 1) == F.substring_index(f"{end}.key", "\0", 1)) & (F.col("t") != F.col(f"{end}.t"))
    inner = placed.join(F.broadcast(ends), "place").groupBy("place", "lo", "hi").agg(F.min(F.when(other("lo"), order)).alias("lo2"), F.max(F.when(other("hi"), order)).alias("hi2"))
    edges = inner.orderBy("place").collect()
    extra = [(edges[i]["place"], x["key"], x["page_id"], x["h"]) for i in range(len(edges)) for x in _lent(edges, i)]
    halo = spark.createDataFrame(extra, "place int, key string, page_id long, h long") if extra else None
    own = full.withColumn("place", place("key", "page_id")).withColumn("own", F.lit(True))
    if halo is not None:  # four rows a range at most
        lent = full.alias("f").join(F.broadcast(halo).alias("e"), (F.col("f.key") == F.col("e.key")) & (F.col("f.h") == F.col("e.h")) & F.col("f.page_id").eqNullSafe(F.col("e.page_id")))
        own = own.unionByName(lent.select("f.*", "e.place").withColumn("own", F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[_Page | None] = [None, None]  # the last page, and the last one before it with another text
        waiting: list[tuple[_Page, _Page | None]] = []  # pages with the last page's text, and what stands before each

        def finish(after: _Page | None) -> Iterator[tuple]:
            for page, before in waiting:
                near = [x for x in (before, after) if x is not None]
                near.sort(key=lambda x: -nearness(x.key, page.key))
                yield page.page_id, page.url, _article(page.blocks, *(x.blocks for x in near))
            waiting.clear()

        def step(page: _Page, own: bool) -> Iterator[tuple]:
            if last[0] is not None and last[0].site != page.site:
                yield from finish(None)
                last[:] = None, None
            if last[0] is not None and last[0].print != page.print:
                yield from finish(page)
                last[1] = last[0]
            elif last[0] is not None and last[0].blocks == page.blocks:
                page.blocks = last[0].blocks  # a run of copies is held once
            last[0] = page
            if own:
                waiting.append((page, last[1]))

        for batch in batches:
            out = []
            for place, key, page_id, url, html, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = blocks(html or "")
                out += step(_Page((place, key.split("\0")[0]), key, page_id, url, found, _print(found)), own)
            if out:
                yield _batch(out)
        out = list(finish(None))
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())], names=["page_id", "url", "text"])

    ordered = own.repartition(ranges, "place").sortWithinPartitions("place", "key", "page_id", "h", "own")
    return ordered.select("place", "key", "page_id", "url", "html", "own").mapInArrow(run, "page_id long, url string, text string")
