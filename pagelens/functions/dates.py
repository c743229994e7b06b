"""Dates of links and documents."""

from __future__ import annotations

import re
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import is_document, path_of

# Fixed values.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}
TEMPORAL = r"\b(?:latest|newest|most\s+recent|recent|current|today|this\s+week|this\s+month|this\s+year|upcoming)\b"
FUTURE_DAYS = 14
STALE_DAYS = 28
BONUS = 2.0
HALF_LIFE_DAYS = 30.0

_DAY, _MONTH = r"0?[1-9]|[12]\d|3[01]", r"0?[1-9]|1[0-2]"
_COMPACT = re.compile(r"(?<![0-9])(?P<y>20\d\d)(?P<m>0[1-9]|1[0-2])(?P<d>0[1-9]|[12]\d|3[01])(?![0-9])")
_ISO = re.compile(rf"\b(?P<y>20\d\d)[/\-](?P<m>{_MONTH})[/\-](?P<d>{_DAY})\b")
_US = re.compile(rf"\b(?P<m>{_MONTH})[/\-](?P<d>{_DAY})(?!\d)[/\-](?P<y>20\d\d)\b")
_NAMED = re.compile(rf"\b(?P<n>{'|'.join(sorted(MONTHS, key=len, reverse=True))})[\s\-_]+(?P<d>{_DAY})(?:st|nd|rd|th)?(?!\d)(?:[\s,\-_]+(?P<y>20\d\d))?\b", re.I)
_YEAR = re.compile(r"(?<![0-9])20\d\d(?![0-9])")


def make_date(year: int, month: int, day: int) -> date | None:
    try:
        return date(year, month, day)
    except ValueError:
        return None


def likely_year(month: int, day: int, reference: date) -> int:
    """The latest year that puts a day no more than FUTURE_DAYS ahead."""
    limit = reference + timedelta(days=FUTURE_DAYS)
    fits = (y for y in (reference.year, reference.year - 1) if (d := make_date(y, month, day)) and d <= limit)
    return next(fits, reference.year)


def link_date(anchor: str, url: str, reference: date) -> date | None:
    """Of the dates in a link's text and path, the one nearest to the reference (the first of equals), none far ahead.

    A named day without a year takes the path's year if there is one alone, else the likely one.
    """
    path = path_of(url)
    both = f"{anchor} {path}"
    years = {int(y) for y in _YEAR.findall(path)}
    found = [make_date(int(m["y"]), int(m["m"]), int(m["d"])) for pattern, where in ((_COMPACT, path), (_ISO, both), (_US, both)) for m in pattern.finditer(where)]
    for m in _NAMED.finditer(both):
        month, day = MONTHS[m["n"].lower()], int(m["d"])
        year = int(m["y"]) if m["y"] else next(iter(years)) if len(years) == 1 else likely_year(month, day, reference)
        found.append(make_date(year, month, day))
    near = [d for d in found if d and d <= reference + timedelta(days=FUTURE_DAYS)]
    return min(near, key=lambda d: abs((reference - d).days), default=None)


def recency_bonus(when: date | None, reference: date) -> float:
    """BONUS for today and later, half of it for every HALF_LIFE_DAYS before; 0 without a date."""
    return 0.0 if when is None else BONUS * 0.5 ** (max(0, (reference - when).days) / HALF_LIFE_DAYS)


def recency_bonus_expr(when: Column, reference: Column) -> Column:
    days = F.greatest(F.lit(0), F.datediff(reference, when))
    return F.when(when.isNull(), 0.0).otherwise(F.lit(BONUS) * F.pow(F.lit(0.5), days / F.lit(HALF_LIFE_DAYS)))


def document_age(url: str, reference: date) -> int | None:
    """Days since the date in a document's address; null for pages and undated documents."""
    when = link_date("", url, reference) if is_document(url) else None
    return None if when is None else (reference - when).days


def is_stale(url: str, reference: date | None) -> bool:
    """Whether a dated document is older than STALE_DAYS."""
    age = document_age(url, reference) if reference else None
    return age is not None and age > STALE_DAYS


def link_date_udf(anchor: Column, url: Column, reference: date) -> Column:
    def run(anchors: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([link_date(a or "", u or "", reference) for a, u in zip(anchors, urls, strict=True)], dtype=object)

    return F.pandas_udf(run, "date")(anchor, url)


def document_age_udf(url: Column, reference: date) -> Column:
    def run(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: document_age(u, reference), na_action="ignore").astype("Int64")

    return F.pandas_udf(run, "long")(url)


def reference_date(goal: str, hint: str | None, today: date) -> date | None:
    """Today, if the goal or its hint speaks of the present; the day is a parameter, so results can be repeated."""
    return today if re.search(TEMPORAL, f"{goal} {hint or ''}", re.I) else None
