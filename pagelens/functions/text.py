"""Text functions: normal form, tokens, scrubbing. Plain functions, their vectorised UDFs, and Catalyst expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
INVISIBLE = r"[\x{AD}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
REPLY_CONTROL = r"[\x00-\x09\x0B\x0C\x0E-\x1F\x7F]|\x1B\[[0-9;]*[a-zA-Z]"
FIELD_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]|\x1B\[[0-9;]*[A-Za-z]"
CUT_MARK = " [truncated]"

_UNSEEN = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), INVISIBLE) + "|" + CONTROL)


def normal_form(text: str) -> str:
    """NFKC, runs of white space as one space, case folded: the form in which texts are compared."""
    return " ".join(unicodedata.normalize("NFKC", text).split()).casefold()


def tokens(text: str) -> list[str]:
    """Tokens of the normal form; punctuation stays on them."""
    return normal_form(text).split()


def strip_unseen(text: str) -> str:
    """The text without invisible and control characters (tab and line ends stay)."""
    return _UNSEEN.sub("", text)


def normal_form_udf(text: Column) -> Column:
    """Catalyst has neither NFKC nor case folding; ASCII text needs neither and stays in the JVM."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(normal_form, na_action="ignore")

    ascii_form = F.lower(F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r\x1C-\x1F]+", " ")))
    return F.when(text.rlike(r"\A[\x00-\x7F]*\z"), ascii_form).otherwise(F.pandas_udf(run, "string")(text))


def token_array(normal: Column) -> Column:
    """Tokens of a text in normal form."""
    return F.filter(F.split(normal, " "), lambda t: t != "")


def with_singulars(words: Column) -> Column:
    """Ordered distinct words, each followed by its form without a final s (words of four letters and more)."""
    pair = F.transform(words, lambda w: F.when(w.endswith("s") & (F.length(w) > 3), F.array(w, F.substring(w, F.lit(1), F.length(w) - 1))).otherwise(F.array(w)))
    return F.array_distinct(F.flatten(pair))


def strip_unseen_expr(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), CONTROL, "")


def scrub(text: Column, most: int) -> Column:
    """Control characters and escape sequences go, line ends become spaces, the mark closes what is cut."""
    clean = F.regexp_replace(F.regexp_replace(text, REPLY_CONTROL, ""), r"\r\n|\r|\n", " ")
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most - len(CUT_MARK)), F.lit(CUT_MARK))).otherwise(clean)


def scrub_text(text: str, most: int) -> str:
    """:func:`scrub` for one value."""
    clean = re.sub(r"\r\n?|\n", " ", re.sub(REPLY_CONTROL, "", text))
    return clean if len(clean) <= most else clean[: most - len(CUT_MARK)] + CUT_MARK


def word_count(text: Column) -> Column:
    """White-space separated words; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"(?U)[\s\x1C-\x1F]+"), lambda w: w != "")), F.lit(0))


def is_visible(answer: str, title: str, text: str) -> bool:
    """Whether an answer stands in a page, white space folded, case aside; space may stand around its dots."""
    fold = lambda s: " ".join(s.split()).casefold()
    page, wanted = fold(f"{title}\n{text}"), fold(answer)
    if not wanted:
        return True
    if "." not in wanted:
        return wanted in page
    return re.search(r"\s*\.\s*".join(re.escape(x) for x in wanted.split(".")), page) is not None


def visible_udf(answer: Column, title: Column, text: Column) -> Column:
    """:func:`is_visible` of each row; a null answer is visible."""

    def run(answers: pd.Series, titles: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([a is None or is_visible(a, t or "", x or "") for a, t, x in zip(answers, titles, texts, strict=True)], dtype=bool)

    return F.pandas_udf(run, "boolean")(answer, title, text)
