"""Settings: a parameter, else the session's ``spark.pagelens.*``, else the default. Values that cannot be read fall back."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

PREFIX = "spark.pagelens."
DEFAULTS: dict[str, Any] = {
    "max_pages": 20, "max_depth": 5, "max_results": 1, "confidence_threshold": 0.70, "verification": "relevance", "verify_threshold": 0.3, "follow_linked_resources": False,
    "return_content": False, "render_js": False, "default_delay": 1.0, "locale": "en_US",
}
_TRUE, _FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def _read(text: str, default: Any) -> Any:
    if isinstance(default, bool):
        word = text.strip().lower()
        return True if word in _TRUE else False if word in _FALSE else default
    try:
        return type(default)(text)
    except ValueError:
        return default


def settings(spark: SparkSession, **given: Any) -> dict[str, Any]:
    """Every setting with its value; parameters that are None count as not given."""
    unknown = set(given) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    out = {}
    for name, default in DEFAULTS.items():
        text = spark.conf.get(PREFIX + name, None)
        out[name] = given[name] if given.get(name) is not None else default if text is None else _read(text, default)
    return out
