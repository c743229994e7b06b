"""Gates on model decisions: schema, plausibility, provenance, visible answer, staleness.

Each gate is written as columns for tables of decisions, and as a function of one decision for the crawl, which must
decide page by page.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date
from typing import Any
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.dates import document_age_udf, is_stale
from pagelens.functions.text import is_visible, scrub, scrub_text, visible_udf, word_count
from pagelens.functions.urls import host_of, in_domains, is_web_url, normalize, normalize_udf

from .goals import Goal

# Fixed values.
FIELDS = ("found", "confidence", "result_url", "links_to_follow", "reasoning", "answer")
MAX_REASONING = 4096
MAX_ANSWER = 1024
MAX_FOLLOWED = 50
THIN_WORDS = 50
SPIKE_CONFIDENCE = 0.8
FALLBACK_LINKS = 3
MIRRORED = (
    r"i have been instructed", r"my new goal is", r"ignore (?:your |the )?(?:previous |prior )?(?:goal|instructions?|task)", r"new (?:goal|instructions?|task) is",
    r"disregard (?:your |the )?(?:previous |prior )?(?:goal|instructions?)", r"instead[,.]?\s+(?:i will|i should|let me|my goal)", r"you are now\b",
    r"forget (?:your |the )?(?:previous |prior )?(?:goal|instructions?|task)",
)


@dataclass(frozen=True)
class Decision:
    """A decision that passed the schema."""

    found: bool
    confidence: float
    result_url: str | None
    links_to_follow: list[str]
    reasoning: str
    answer: str | None = None


class InvalidDecision(ValueError):
    """A decision breaks the schema."""


def _web(value: Any) -> bool:
    try:
        return isinstance(value, str) and urlparse(value).scheme in ("http", "https") and bool(urlparse(value).netloc)
    except ValueError:
        return False


def check_schema(raw: Any) -> Decision:
    """The decision in a parsed reply; raises InvalidDecision with the first rule that is broken."""

    def need(ok: bool, said: str) -> None:
        if not ok:
            raise InvalidDecision(said)

    need(isinstance(raw, dict), "not_object")
    need(not set(raw) - set(FIELDS), "extra_fields")
    need("found" in raw, "found_missing")
    need(isinstance(raw["found"], bool), "found_type")
    found = raw["found"]
    need("confidence" in raw, "confidence_missing")
    need(isinstance(raw["confidence"], int | float) and not isinstance(raw["confidence"], bool), "confidence_type")
    need(0 <= raw["confidence"] <= 1, "confidence_range")
    need("result_url" in raw, "result_url_missing")
    need((raw["result_url"] is not None) == found, "result_url_presence")
    need(not found or _web(raw["result_url"]), "result_url_invalid")
    need("links_to_follow" in raw, "links_missing")
    need(isinstance(raw["links_to_follow"], list), "links_type")
    need("reasoning" in raw, "reasoning_missing")
    need(isinstance(raw["reasoning"], str), "reasoning_type")
    reasoning = scrub_text(raw["reasoning"], MAX_REASONING)
    need(bool(reasoning.strip()), "reasoning_blank")
    answer = raw.get("answer")
    if answer is not None:
        need(found, "answer_without_find")
        need(isinstance(answer, str), "answer_type")
        answer = scrub_text(answer, MAX_ANSWER)
        need(bool(answer.strip()), "answer_blank")
    return Decision(found, float(raw["confidence"]), raw["result_url"], [x for x in raw["links_to_follow"] if _web(x)][:MAX_FOLLOWED], reasoning, answer)


def schema_columns(decisions: DataFrame, raw: str = "raw") -> DataFrame:
    """Add error (null if the JSON text passes) and the decision's fields to a table of replies.

    Types are read from the parsed value itself: casts would turn numbers into text and booleans into numbers.
    """
    rows = decisions.withColumn("_v", F.try_parse_json(F.col(raw)))
    kind = lambda path: F.expr(f"schema_of_variant(try_variant_get(_v, '{path}', 'variant'))")
    text = lambda path: F.expr(f"try_variant_get(_v, '{path}', 'string')")
    numeric = r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"
    rows = rows.withColumns({
        "_top": F.expr("schema_of_variant(_v)"), "_keys": F.when(F.expr("schema_of_variant(_v)").startswith("OBJECT"), F.json_object_keys(F.col(raw))),
        "_found_t": kind("$.found"), "_conf_t": kind("$.confidence"), "_url_t": kind("$.result_url"), "_links_t": kind("$.links_to_follow"), "_why_t": kind("$.reasoning"), "_answer_t": kind("$.answer"),
    })
    rows = rows.withColumns({
        "_found": F.when(F.col("_found_t") == "BOOLEAN", F.expr("try_variant_get(_v, '$.found', 'boolean')")),
        "_conf": F.when(F.col("_conf_t").rlike(numeric), F.expr("try_variant_get(_v, '$.confidence', 'double')")),
        "_url": F.when(F.col("_url_t") == "STRING", text("$.result_url")),
        "_why": F.when(F.col("_why_t") == "STRING", scrub(text("$.reasoning"), MAX_REASONING)),
        "_answer": F.when(F.col("_answer_t") == "STRING", scrub(text("$.answer"), MAX_ANSWER)),
        "_links": F.expr("try_variant_get(_v, '$.links_to_follow', 'array<variant>')"),
    })
    # one row of one struct: a generator, which the optimizer neither inlines nor moves filters through, so that the
    # rules below read finished columns and their generated code stays small
    made = [c for c in rows.columns if c not in decisions.columns]
    rows = rows.select(*decisions.columns, F.explode(F.array(F.struct(*made))).alias("_p")).select(*decisions.columns, "_p.*")
    has = lambda name: F.array_contains("_keys", name)
    none = lambda c: F.col(c).isNull() | (F.col(c) == "VOID")
    blank = lambda c: F.trim(F.regexp_replace(F.col(c), r"(?U)\s+", " ")) == ""
    rules = [
        (F.col("_keys").isNull(), "not_object"),
        (F.size(F.array_except("_keys", F.array(*map(F.lit, FIELDS)))) > 0, "extra_fields"),
        (~has("found"), "found_missing"), (F.col("_found").isNull(), "found_type"),
        (~has("confidence"), "confidence_missing"), (F.col("_conf").isNull(), "confidence_type"), (~F.col("_conf").between(0, 1), "confidence_range"),
        (~has("result_url"), "result_url_missing"), (none("_url_t") == F.col("_found"), "result_url_presence"), (F.col("_found") & ~is_web_url(F.col("_url")), "result_url_invalid"),
        (~has("links_to_follow"), "links_missing"), (F.coalesce(~F.col("_links_t").startswith("ARRAY"), F.lit(True)), "links_type"),
        (~has("reasoning"), "reasoning_missing"), (F.col("_why").isNull(), "reasoning_type"), (blank("_why"), "reasoning_blank"),
        (~none("_answer_t") & ~F.col("_found"), "answer_without_find"), (~none("_answer_t") & F.col("_answer").isNull(), "answer_type"), (blank("_answer"), "answer_blank"),
    ]
    error = F.coalesce(*(F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for broken, name in rules))
    strings = F.expr("transform(filter(_links, x -> schema_of_variant(x) = 'STRING'), x -> try_variant_get(x, '$', 'string'))")
    rows = rows.select("*", F.explode(F.array(error)).alias("error"))
    good = F.col("error").isNull()
    rows = rows.withColumns({
        "found": F.when(good, F.col("_found")), "confidence": F.when(good, F.col("_conf")), "result_url": F.when(good, F.col("_url")),
        "links_to_follow": F.when(good, F.slice(F.filter(strings, is_web_url), 1, MAX_FOLLOWED)), "reasoning": F.when(good, F.col("_why")), "answer": F.when(good, F.col("_answer")),
    })
    return rows.drop(*(c for c in rows.columns if c.startswith("_") and c not in decisions.columns))


def first_valid(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key's attempts (column attempt), the first that passes the schema, else the last with its error; a
    second attempt is the last that counts."""
    checked = schema_columns(attempts.filter("attempt <= 2"))
    order = F.struct(F.col("error").isNotNull().alias("bad"), F.when(F.col("error").isNull(), F.col("attempt")).otherwise(-F.col("attempt")).alias("n"))
    rest = [c for c in checked.columns if c not in keys]
    best = checked.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return best.select(*keys, "r.*")


# Plausibility

def mirrored(reasoning: str) -> str | None:
    """The first piece of reasoning that sounds like an instruction taken from the page."""
    return next((m[0] for p in MIRRORED if (m := re.search(p, reasoning, re.I))), None)


def flags(decision: Decision, page_text: str, goal_type: str | None) -> list[tuple[str, str]]:
    """(name, detail) of every plausibility flag of one decision."""
    out = []
    said = mirrored(decision.reasoning)
    if said is not None:
        out.append(("instruction_mirroring", f"the reasoning repeats an instruction: {said!r}"))
    words = len(page_text.split())
    if words < THIN_WORDS and decision.confidence > SPIKE_CONFIDENCE and not (goal_type == "document_link" and decision.found):
        out.append(("confidence_spike", f"{decision.confidence:.2f} is much confidence for {words} words (over {SPIKE_CONFIDENCE} takes {THIN_WORDS})"))
    if not decision.found and not decision.links_to_follow:
        out.append(("zero_links_no_path", "nothing found and no link to follow"))
    return out


def plausibility(found: Column, confidence: Column, links: Column, reasoning: Column, page_text: Column, goal_type: Column) -> Column:
    """Names of the plausibility flags of a row; an empty array passes."""
    mirror = reasoning.rlike(f"(?iU){'|'.join(f'(?:{p})' for p in MIRRORED)}")
    spike = (word_count(page_text) < THIN_WORDS) & (confidence > SPIKE_CONFIDENCE) & ~(F.coalesce(goal_type == "document_link", F.lit(False)) & found)
    stuck = ~found & (F.coalesce(F.size(links), F.lit(0)) <= 0)
    named = F.array(F.when(mirror, "instruction_mirroring"), F.when(spike, "confidence_spike"), F.when(stuck, "zero_links_no_path"))
    return F.filter(named, lambda x: x.isNotNull())


# Provenance

def provenance(claims: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of claims (page_id, norm_url, …) whose URL stands on the page: a left semi join."""
    return claims.join(found.select("page_id", "norm_url").distinct(), ["page_id", "norm_url"], "left_semi")


def unvisited(links: DataFrame, visited: DataFrame) -> DataFrame:
    """Rows whose norm_url was not visited by the crawl: a left anti join."""
    return links.join(visited.select("crawl_id", "norm_url").distinct(), ["crawl_id", "norm_url"], "left_anti")


def accepted(decision: Decision, page_url: str, title: str, text: str, links: Iterable[dict]) -> tuple[bool, str | None, list[str]]:
    """Whether a claim stands, its URL, and the suggested links that the page has.

    A fact answers with its own page, and must be visible there; any other result must be the page or one of its links.
    """
    on_page = {normalize(page_url), *(x["norm"] for x in links)} - {None}
    url = page_url if decision.found and decision.answer is not None else decision.result_url
    stands = decision.found and (url is None or normalize(url) in on_page)
    if stands and decision.answer is not None:
        stands = is_visible(decision.answer, title, text)
    return stands, url if stands else None, [x for x in decision.links_to_follow if normalize(x) in on_page]


def result_check(decisions: DataFrame, pages: DataFrame, found: DataFrame) -> DataFrame:
    """:func:`accepted` of tables: decisions (page_id, found, result_url, answer) with stands and the URL that stands.

    pages: page_id, url, title, text; found: the pages' links (page_id, norm_url).
    """
    page = pages.select("page_id", F.col("url").alias("_page"), F.col("title").alias("_title"), F.col("text").alias("_text"))
    rows = decisions.join(page, "page_id")
    rows = rows.withColumn("_url", F.when(F.col("found") & F.col("answer").isNotNull(), F.col("_page")).otherwise(F.col("result_url")))
    rows = rows.withColumns({"_norm": normalize_udf(F.col("_url")), "_own": normalize_udf(F.col("_page"))})
    links = found.select("page_id", F.col("norm_url").alias("_norm")).distinct().withColumn("_there", F.lit(True))
    rows = rows.join(links, ["page_id", "_norm"], "left")
    on_page = F.col("_url").isNull() | F.coalesce(F.col("_norm") == F.col("_own"), F.lit(False)) | F.col("_there").isNotNull()
    visible = F.when(F.col("answer").isNull(), True).otherwise(visible_udf(F.col("answer"), F.col("_title"), F.col("_text")))
    rows = rows.withColumn("stands", F.col("found") & on_page & visible)
    return rows.select(*decisions.columns, "stands", F.when(F.col("stands"), F.col("_url")).alias("checked_url"))


# Staleness

def fresh_links(ranked: DataFrame, reference: date, limit: int = FALLBACK_LINKS) -> DataFrame:
    """page_id, link_url, norm_url, choice (from 1) of the best relevant links that are no stale documents, each address
    once; ranked: page_id, link_url, norm_url, score, rank and open (not visited, in the crawl's domains)."""
    rows = stale_columns(ranked.filter(F.col("open") & (F.col("score") > 0)), reference).filter(~F.col("is_stale"))
    once = rows.groupBy("page_id", "norm_url").agg(F.min(F.struct("rank", "link_url")).alias("l"))
    choice = F.row_number().over(Window.partitionBy("page_id").orderBy("l.rank", "norm_url"))
    return once.select("page_id", F.col("l.link_url").alias("link_url"), "norm_url", choice.alias("choice")).filter(F.col("choice") <= limit)


def downgrade(claims: DataFrame, ranked: DataFrame, reference: date) -> DataFrame:
    """Claims (page_id, found, result_url, links_to_follow) of a goal for the newest document: one whose document is
    stale, where the page has fresher links, is no find; those links (three at most) are to be followed."""
    rows = stale_columns(claims, reference, "result_url").withColumn("_norm", normalize_udf(F.col("result_url")))
    fresh = fresh_links(ranked, reference, FALLBACK_LINKS + 1).join(rows.select("page_id", "_norm"), "page_id").filter(~F.coalesce(F.col("norm_url") == F.col("_norm"), F.lit(False)))
    fresh = fresh.groupBy("page_id").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("choice", "link_url"))), lambda x: x["link_url"]), 1, FALLBACK_LINKS).alias("_fresh"))
    gone = F.col("found") & F.col("is_stale") & F.col("_fresh").isNotNull()
    out = rows.join(fresh, "page_id", "left").withColumn("_gone", gone)
    made = {"found": F.col("found") & ~F.col("_gone"), "result_url": F.when(~F.col("_gone"), F.col("result_url")), "links_to_follow": F.when(F.col("_gone"), F.concat("links_to_follow", "_fresh")).otherwise(F.col("links_to_follow"))}
    return out.select(*((made[c] if c in made else F.col(c)).alias(c) for c in claims.columns), F.col("_gone").alias("downgraded"))


def without_stale(follow: DataFrame, ranked: DataFrame, reference: date) -> DataFrame:
    """Links to follow (page_id, link_url), without stale documents where the page has a fresher path."""
    fresher_pages = fresh_links(ranked, reference, 1).select("page_id").withColumn("_fresher", F.lit(True))
    rows = stale_columns(follow, reference).join(fresher_pages, "page_id", "left")
    return rows.filter(F.col("_fresher").isNull() | ~F.col("is_stale")).select(*follow.columns)


def explorable(ranked: Iterable[tuple[str, float]], *, visited: set[str], domains: frozenset[str], reference: date | None, limit: int = FALLBACK_LINKS, besides: str | None = None, relevant: bool = False) -> list[tuple[str, float]]:
    """The best links that a crawl could go to: not visited, in its domains, no stale document, each once."""
    out: dict[str, tuple[str, float]] = {}
    for url, score in ranked:
        norm = normalize(url)
        if len(out) == limit:
            break
        if norm is None or norm in visited or norm in out or norm == besides or (relevant and score <= 0):
            continue
        if in_domains(host_of(norm), domains) and not is_stale(url, reference):
            out[norm] = (url, score)
    return list(out.values())


def fresher(goal: Goal, ranked: Iterable[tuple[str, float]], visited: set[str], domains: frozenset[str], besides: str | None = None) -> list[str]:
    """Relevant links that may lead to something newer than a dated document, for goals that ask for the newest."""
    if goal.reference_date is None or goal.goal_type != "document_link":
        return []
    return [u for u, _ in explorable(ranked, visited=visited, domains=domains, reference=goal.reference_date, besides=besides, relevant=True)]


def stale_columns(links: DataFrame, reference: date, url: str = "link_url") -> DataFrame:
    """Add document_age (days, null for pages and undated documents) and is_stale."""
    aged = links.withColumn("document_age", document_age_udf(F.col(url), reference))
    return aged.withColumn("is_stale", F.coalesce(F.col("document_age") > 28, F.lit(False)))


def to_json(decision: Decision) -> str:
    return json.dumps(decision.__dict__, ensure_ascii=False)
