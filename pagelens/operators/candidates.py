"""Candidate facts of a page: phones, dates, addresses, prices, document links, with scores.

Matches need positions in code points, which Catalyst's regular expressions do not give, so a vectorised function finds
them; uniqueness, score and order are columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.dates import MONTHS, make_date
from pagelens.functions.text import normal_form
from pagelens.functions.urls import path_of

from .goals import Goal

# Fixed values.
ZONE_WEIGHTS = {"content": 1.0, "neutral": 0.5, "chrome": 0.3}
WEIGHTS = {"zone_weight": 0.35, "anchor_proximity": 0.30, "negative_proximity": -0.15, "format_quality": 0.10, "uniqueness": 0.10}
REACH = 500.0
NEARBY = 50
LINK_STEP = 80
DOCUMENT_EXTENSIONS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".csv", ".txt", ".rtf", ".odt", ".ods", ".odp", ".zip", ".epub")
_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_STREET = "Street|St|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Road|Rd|Way|Lane|Ln|Court|Ct|Place|Pl|Parkway|Pkwy|Circle|Cir|Highway|Hwy"
PHONE = r"(?:\+?1[\s\-.]?)?\(?(\d{3})\)?[\s\-.]?(\d{3})[\s\-.]?(\d{4})(?!\d)"
DATES = (
    (r"\b(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})\b", 0),
    (rf"\b(?P<n>{_MONTH})\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}})\b", re.I),
    (rf"\b(?P<n>{_MONTH})\s+(?P<y>\d{{4}})\b", re.I),
    (r"\b(?P<m>\d{1,2})[/\-](?P<d>\d{1,2})[/\-](?P<y>\d{4})\b", 0),
)
ADDRESS = rf"(?<!\w)\d{{1,5}}\s+[A-Za-z][A-Za-z0-9\s\-.]{{1,40}}(?:{_STREET})\.?(?:\s+(?:Ste|Suite|Apt|Unit|#)\s*[\w\-]+)?(?:,\s*[A-Za-z][\w\s]{{2,25}})?"
PRICE = r"(?:[$€£¥₹])\s*[\d,]++(?:\.\d{1,2})?|(?<![\d,])[\d,]++(?:\.\d{1,2})?\s*(?:USD|EUR|GBP|JPY|CAD|AUD)\b"


@dataclass(frozen=True)
class Match:
    value: str
    raw: str
    position: int


def phone_form(raw: str) -> str:
    digits = "".join(c for c in raw if c.isdecimal())
    digits = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    return f"+1-{digits[:3]}-{digits[3:6]}-{digits[6:]}" if len(digits) == 10 else raw.strip()


def phone_form_expr(raw: Column) -> Column:
    digits = F.regexp_replace(raw, r"\D", "")
    ten = F.when(F.length(digits) == 10, digits).when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10))
    return F.when(ten.isNotNull(), F.concat(F.lit("+1-"), F.substring(ten, 1, 3), F.lit("-"), F.substring(ten, 4, 3), F.lit("-"), F.substring(ten, 7, 4))).otherwise(F.trim(raw))


def _phones(text: str) -> list[Match]:
    return [Match(phone_form(m[0]), m[0], m.start()) for m in re.finditer(PHONE, text)]


def _dates(text: str) -> list[Match]:
    out = []
    for pattern, flags in DATES:
        for m in re.finditer(pattern, text, flags):
            g = m.groupdict()
            month = MONTHS.get(g["n"].lower()) if g.get("n") else int(g["m"])
            when = make_date(int(g["y"]), month, int(g.get("d") or 1))
            if when:
                out.append(Match(when.isoformat(), m[0], m.start()))
    return out


def _pieces(pattern: str):
    return lambda text: [Match(" ".join(m[0].split()), m[0].strip(), m.start()) for m in re.finditer(pattern, text, re.I)]


FINDERS = {"phone_extraction": _phones, "date_extraction": _dates, "address_extraction": _pieces(ADDRESS), "price_extraction": _pieces(PRICE)}


def format_quality(value: str, hints: list[str]) -> float:
    """1 if a pattern matches all of the value, 0.5 if one matches a part; patterns that do not compile are passed over."""
    best = 0.0
    for hint in hints:
        try:
            if re.fullmatch(hint, value, re.I):
                return 1.0
            if not best and re.search(hint, value, re.I):
                best = 0.5
        except re.error:
            continue
    return best


def _documents(text: str, links: list[dict], hints: list[str]) -> list[Match]:
    out = []
    for i, link in enumerate(links):
        name = path_of(link["url"]).rsplit("/", 1)[-1]
        label = link["text"] or ""
        known = "." in name and "." + name.rsplit(".", 1)[-1].lower() in DOCUMENT_EXTENSIONS
        if link["url"] and (known or any(format_quality(x, hints) for x in (link["url"], label, name))):
            at = text.find(label) if label else -1
            out.append(Match(link["url"], label or name, at if at >= 0 else i * LINK_STEP))
    return out


def nearest(position: int, text: str, terms: list[str]) -> int | None:
    """Distance from a position to the nearest occurrence of a term in the text's normal form."""
    best = None
    for term in filter(None, map(normal_form, terms)):
        # occurrences may overlap; the nearest is the last at or before the position or the first after it
        before, after = text.rfind(term, 0, position + len(term)), text.find(term, position)
        for at in (before, after):
            if at >= 0 and (best is None or abs(position - at) < best):
                best = abs(position - at)
    return best


def zone_of(position: Column, length: Column) -> Column:
    share = position / length
    return F.when(length == 0, "neutral").when(share < 0.40, "content").when(share < 0.75, "neutral").otherwise("chrome")


def find(pages: DataFrame, goal: Goal) -> DataFrame:
    """page_id, value, raw_value, position, text_length, nearby_text, anchor_distance, negative_distance, format_quality,
    match_no of every match in pages with columns page_id, text and links (as :func:`pages.features` gives them)."""
    kind = dict(pages.dtypes)["page_id"]
    ddl = f"page_id {kind}, match_no int, value string, raw_value string, position int, text_length int, nearby_text string, anchor_distance int, negative_distance int, format_quality double"
    finder = FINDERS.get(goal.goal_type)
    if finder is None and goal.goal_type != "document_link":
        return pages.sparkSession.createDataFrame([], ddl)
    fields = [("match_no", pa.int32()), ("value", pa.string()), ("raw_value", pa.string()), ("position", pa.int32()), ("text_length", pa.int32()), ("nearby_text", pa.string()), ("anchor_distance", pa.int32()), ("negative_distance", pa.int32()), ("format_quality", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for i, (text, links) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                text = text or ""
                found = finder(text) if finder else _documents(text, links or [], goal.regex_hints)
                normal = normal_form(text) if found else ""
                for n, m in enumerate(found):
                    owner.append(i)
                    rows.append((n, m.value, m.raw, m.position, len(text), text[max(0, m.position - NEARBY) : m.position].strip(), nearest(m.position, normal, goal.anchor_terms), nearest(m.position, normal, goal.negative_terms), format_quality(m.value, goal.regex_hints)))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True))], names=["page_id", *(n for n, _ in fields)])

    return pages.select("page_id", "text", "links").mapInArrow(run, ddl)


def _proximity(distance: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), 1 - distance / F.lit(REACH)), F.lit(0.0))


def score(found: DataFrame) -> DataFrame:
    """Add zone, the features, score and rank to what :func:`find` gives."""
    zone = zone_of(F.col("position"), F.col("text_length"))
    weight = F.coalesce(*(F.when(F.col("zone") == z, w) for z, w in ZONE_WEIGHTS.items()))
    nearer = F.col("negative_distance").isNotNull() & (F.col("anchor_distance").isNull() | (F.col("negative_distance") < F.col("anchor_distance")))
    out = found.withColumn("zone", zone).withColumns({
        "zone_weight": weight,
        "anchor_proximity": _proximity(F.col("anchor_distance")),
        "negative_proximity": F.when(nearer, _proximity(F.col("negative_distance"))).otherwise(0.0),
        "uniqueness": 1.0 / F.count("*").over(Window.partitionBy("page_id", "value")),
    })
    total = sum((F.lit(w) * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0))
    out = out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "match_no")))


def candidates(pages: DataFrame, goal: Goal) -> DataFrame:
    """Scored candidates of every page, best first by rank; none for goals that have no extractor."""
    return score(find(pages, goal))
