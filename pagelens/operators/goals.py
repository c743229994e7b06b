"""Goals: their type, terms and reference date. One row a request, so this runs where the query is built."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import date
from typing import Any

from pagelens.functions.dates import reference_date
from pagelens.functions.text import FIELD_CONTROL, normal_form, tokens

# Fixed values.
GOAL_TYPES = ("navigation", "phone_extraction", "address_extraction", "price_extraction", "date_extraction", "document_link", "freeform_fact")
STOP_WORDS = frozenset(
    "a an the is are was were be been being have has had do does did will would could should may might shall can to of in on at by for with about from into through "
    "i me my we our you your he she it they this that these those and or but if not no nor so yet just how what where when who which find get go look search "
    "page site web section".split()
)
TYPE_WORDS = (
    ("phone number", "phone_extraction"), ("phone #", "phone_extraction"), ("how much", "price_extraction"), ("when was", "date_extraction"), ("when is", "date_extraction"),
    ("download the", "document_link"), ("download a", "document_link"), ("phone", "phone_extraction"), ("address", "address_extraction"), ("price", "price_extraction"),
    ("pricing", "price_extraction"), ("fee", "price_extraction"), ("cost", "price_extraction"), ("date", "date_extraction"), ("published", "date_extraction"),
    ("schedule", "date_extraction"), ("pdf", "document_link"), ("bulletin", "document_link"), ("handbook", "document_link"), (".doc", "document_link"), (".xlsx", "document_link"),
    (".csv", "document_link"), ("hours", "freeform_fact"), ("what is the name", "freeform_fact"), ("what is the", "freeform_fact"), ("what are the", "freeform_fact"),
    ("what are", "freeform_fact"), ("what does", "freeform_fact"), ("what function", "freeform_fact"), ("what version", "freeform_fact"), ("who is", "freeform_fact"),
    ("who are", "freeform_fact"), ("how many", "freeform_fact"),
)
MOST_BYTES = 4096
DETERMINISTIC_CONFIDENCE = 0.7
REASONING_MODELS = ("qwen3", "qwq", "deepseek-r1", "gpt-oss", "reason")


@dataclass(frozen=True)
class Goal:
    """What a crawl looks for."""

    goal: str
    navigation_hint: str | None = None
    goal_type: str = "navigation"
    goal_type_confidence: float = DETERMINISTIC_CONFIDENCE
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    anchor_terms: list[str] = field(default_factory=list)
    negative_terms: list[str] = field(default_factory=list)
    regex_hints: list[str] = field(default_factory=list)
    description: str = ""
    source: str = "deterministic"
    model_used: str | None = None
    locale: str = "en_US"
    validation_warnings: list[str] = field(default_factory=list)
    reference_date: date | None = None

    @property
    def synonym_values(self) -> list[str]:
        return [v for values in self.synonyms.values() for v in values]

    @property
    def query_terms(self) -> list[str]:
        return [*self.anchor_terms, *self.synonym_values]


class GoalRejected(ValueError):
    """A proposed goal context breaks a rule."""


def bounded(term: str, text: str) -> bool:
    """Whether a term stands in a text between other characters than a-z and 0-9."""
    return re.search(rf"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])", text) is not None


def goal_type(normal: str) -> str:
    """The type of the first rule whose words occur: phrases and extensions anywhere, single words as whole words."""
    loose = lambda w: " " in w or w.startswith(".")
    return next((t for w, t in TYPE_WORDS if (w in normal if loose(w) else bounded(w, normal))), "navigation")


def anchors(goal: str, hint: str | None) -> list[str]:
    return [t for t in tokens(goal) + tokens(hint or "") if t not in STOP_WORDS and len(t) > 1]


def preprocess(goal: str, hint: str | None = None, locale: str = "en_US", *, today: date) -> Goal:
    """The deterministic context of a goal."""
    kind, terms = goal_type(normal_form(goal)), anchors(goal, hint)
    return Goal(goal, hint, kind, anchor_terms=terms, description=f"Deterministic: {kind}, {len(terms)} anchor term(s)", locale=locale, reference_date=reference_date(goal, hint, today))


class _Checker:
    """Collects the warnings of one proposed context."""

    def __init__(self, goal: str, hint: str | None):
        self.warnings: list[str] = []
        self.spoken = f"{normal_form(goal)} {normal_form(hint or '')}".strip()

    def clean(self, value: object, name: str) -> str:
        text = value if isinstance(value, str) else str(value)
        out = re.sub(FIELD_CONTROL, "", text)
        if out != text:
            self.warnings.append(f"sanitization: control chars stripped from {name}")
        return out

    def spoken_of(self, term: str) -> bool:
        return bounded(normal_form(term), self.spoken)

    def strings(self, value: object, name: str) -> list[str]:
        return [self.clean(x, name) for x in value if isinstance(x, str)] if isinstance(value, list) else []


def validate(raw: dict[str, Any], goal: str, hint: str | None, locale: str, model: str, *, today: date) -> Goal:
    """A model's proposal as a context. Raises GoalRejected for what must not pass and warns of what is dropped."""
    check = _Checker(goal, hint)
    kind = check.clean(raw.get("goal_type", ""), "goal_type")
    if kind not in GOAL_TYPES:
        raise GoalRejected(f"invalid goal_type: {kind!r}")
    confidence = raw.get("goal_type_confidence")
    if not isinstance(confidence, int | float) or not 0 <= float(confidence) <= 1:
        raise GoalRejected(f"invalid goal_type_confidence: {confidence!r}")

    synonyms: dict[str, list[str]] = {}
    proposed = raw.get("synonyms") or {}
    for key, values in proposed.items() if isinstance(proposed, dict) else ():
        key = check.clean(key, "synonyms key")
        if not normal_form(key) or not check.spoken_of(key):
            raise GoalRejected(f"synonym key {key!r} not in goal/hint")
        synonyms[key] = check.strings(values, "synonym value")

    terms = []
    for term in check.strings(raw.get("anchor_terms") or [], "anchor_term"):
        if check.spoken_of(term):
            terms.append(term)
        else:
            check.warnings.append(f"near_miss: anchor_term {term!r} not in goal/hint, dropped")
    terms = terms or anchors(goal, hint)

    patterns = raw.get("regex_hints") or []
    if isinstance(patterns, str):
        check.warnings.append("format_coerced: regex_hints was a string, wrapped in list")
        patterns = [patterns]
    hints = []
    for pattern in check.strings(patterns, "regex_hint"):
        try:
            re.compile(pattern)
            hints.append(pattern)
        except re.error as error:
            check.warnings.append(f"regex_dropped: {error}: {pattern!r}")

    wanted = {normal_form(x) for x in (*synonyms, *(v for vs in synonyms.values() for v in vs), *terms)}
    negatives = check.strings(raw.get("negative_terms") or [], "negative_term")
    for term in negatives:
        if check.spoken_of(term):
            raise GoalRejected(f"negative_term {term!r} appears in goal/hint")
        if normal_form(term) in wanted:
            raise GoalRejected(f"negative_term {term!r} overlaps positive terms")

    out = Goal(goal, hint, kind, float(confidence), synonyms, terms, negatives, hints, check.clean(str(raw.get("description", "")), "description"), "model", model, locale, check.warnings, reference_date(goal, hint, today))
    fields = ("goal", "navigation_hint", "goal_type", "goal_type_confidence", "synonyms", "anchor_terms", "negative_terms", "regex_hints", "description")
    size = len(json.dumps({f: getattr(out, f) for f in fields}, ensure_ascii=False, sort_keys=True).encode())
    if size > MOST_BYTES:
        raise GoalRejected(f"goal context takes {size} bytes, {MOST_BYTES} at most")
    return out


def hybrid(propose: Callable[[str, str | None, str], dict], model: str, *, today: date) -> Callable[[str, str | None, str], Goal]:
    """A preprocessor that asks a model and falls back to the deterministic context on any failure."""

    def run(goal: str, hint: str | None = None, locale: str = "en_US") -> Goal:
        try:
            return validate(propose(goal, hint, locale), goal, hint, locale, model, today=today)
        except Exception:
            return preprocess(goal, hint, locale, today=today)

    return run


def auto(propose: Callable[[str, str | None, str], dict], model: str, *, today: date) -> Callable[[str, str | None, str], Goal]:
    """Deterministic for navigation and document goals, hybrid for the others."""
    asked = hybrid(propose, model, today=today)

    def run(goal: str, hint: str | None = None, locale: str = "en_US") -> Goal:
        plain = preprocess(goal, hint, locale, today=today)
        return plain if plain.goal_type in ("navigation", "document_link") else asked(goal, hint, locale)

    return run


class GoalCache:
    """Contexts by normal form of goal and hint, preprocessor, model, locale and format version."""

    def __init__(self, version: str = "1"):
        self.version, self._held = version, {}

    def get_or_create(self, goal: str, hint: str | None, locale: str, make: Callable[[str, str | None, str], Goal], name: str = "deterministic", model: str | None = None) -> Goal:
        key = (normal_form(goal), normal_form(hint or ""), name, model, locale, self.version)
        if key not in self._held:
            self._held[key] = make(goal, hint, locale)
        return self._held[key]


def is_reasoning_model(model: str) -> bool:
    return any(part in model.lower() for part in REASONING_MODELS)


def with_reference(goal: Goal, day: date | None) -> Goal:
    return replace(goal, reference_date=day)
