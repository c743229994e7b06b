"""Link ranking: coverage of the goal's terms in closed form, a recency bonus, stable order.

Words of the anchor and of the path are each distinct, so a term occurs once or twice and the saturated frequency is 1
or 10/7: the score is the number of covered terms and 3/7 for each that both sides hold.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.dates import link_date, link_date_udf, recency_bonus, recency_bonus_expr
from pagelens.functions.text import normal_form, normal_form_udf, token_array, tokens, with_singulars
from pagelens.functions.urls import PATH_NOISE, path_of, path_tokens

from .goals import Goal

K1 = 1.5
EXTRA = 2 * (K1 + 1) / (2 + K1) - 1  # what a second occurrence adds: 3/7


def anchor_tokens(text: Column) -> Column:
    return with_singulars(token_array(normal_form_udf(text)))


def coverage(anchor: Column, path: Column, terms: Iterable[str]) -> Column:
    """Score of a link from the words of its anchor and path."""
    query = F.array_distinct(F.array(*map(F.lit, terms)))
    either = F.size(F.array_intersect(F.array_union(anchor, path), query))
    both = F.size(F.array_intersect(F.array_intersect(anchor, path), query))
    return either + F.lit(EXTRA) * both


def score_links(found: DataFrame, goal: Goal) -> DataFrame:
    """Add score to rows with text and link_url."""
    if not goal.query_terms:
        return found.withColumn("score", F.lit(0.0))
    text, url = F.coalesce("text", F.lit("")), F.coalesce("link_url", F.lit(""))
    score = coverage(anchor_tokens(text), path_tokens(url), goal.query_terms).cast("double")
    if goal.reference_date is not None:
        when = link_date_udf(text, url, goal.reference_date)
        score = score + recency_bonus_expr(when, F.lit(goal.reference_date))
    return found.withColumn("score", score)


def rank_links(found: DataFrame, goal: Goal, top: int | None = None) -> DataFrame:
    """Add score and rank (1: best; the page's order decides ties); with ``top``, only the best of each page."""
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), "link_no")
    ranked = score_links(found, goal).withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


# The same for the links of one page, inside a crawl.

def _distinct(words: Iterable[str]) -> dict[str, None]:
    out: dict[str, None] = {}
    for w in words:
        out[w] = None
        if len(w) > 3 and w.endswith("s"):
            out[w[:-1]] = None
    return out


def link_score(text: str, url: str, goal: Goal) -> float:
    query = set(goal.query_terms)
    if not query:
        return 0.0
    parts = path_of(url).translate(str.maketrans("-_.", "///")).split("/")
    anchor = _distinct(tokens(text))
    path = _distinct(w for w in map(normal_form, parts) if len(w) > 1 and w not in PATH_NOISE)
    score = float(sum(1 + EXTRA * (w in anchor and w in path) for w in query if w in anchor or w in path))
    if goal.reference_date is not None:
        score += recency_bonus(link_date(text, url, goal.reference_date), goal.reference_date)
    return score


def rank_page(found: list[dict], goal: Goal) -> list[tuple[str, float]]:
    """(url, score) of a page's links, best first, the page's order on ties."""
    scored = [(x["url"], link_score(x["text"] or "", x["url"], goal)) for x in found]
    return sorted(scored, key=lambda p: -p[1])
