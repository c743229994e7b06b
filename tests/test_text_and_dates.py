from datetime import date

import pytest
from pyspark.sql import functions as F

from pagelens.functions import dates, text


def test_normal_form(spark):
    samples = ["  ＣＥＯ  Office ", "Straße", "a\tb\n c", "", "ΣΑΣ", "plain ASCII  Text", None]
    rows = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in rows.select(text.normal_form_udf(F.col("s"))).collect()]
    assert got == [None if s is None else text.normal_form(s) for s in samples]
    assert got[0] == "ceo office" and got[1] == "strasse"


def test_scrub(spark):
    samples = ["a\x07b", "\x1b[31mred", "one\r\ntwo\rthree\nfour", "x" * 30, ""]
    rows = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in rows.select(text.scrub(F.col("s"), 20)).collect()]
    assert got == [text.scrub_text(s, 20) for s in samples]
    assert got[2] == "one two three four" and got[3] == "x" * 8 + " [truncated]"


def test_unseen_characters(spark):
    s = "a​b­c﻿d\x00e\tf\ng‮h"
    assert text.strip_unseen(s) == "abcde\tf\ngh"
    assert spark.createDataFrame([(s,)], "s string").select(text.strip_unseen_expr(F.col("s"))).first()[0] == "abcde\tf\ngh"


def test_visible_answers():
    assert text.is_visible("Functools.Cache", "t", "use functools . cache here")
    assert text.is_visible("two  words", "", "TWO\nWORDS") and not text.is_visible("absent", "t", "x")


def test_word_count(spark):
    rows = spark.createDataFrame([("a b c\n\nd",), ("",), (None,), ("  ",)], "s string")
    assert [r[0] for r in rows.select(text.word_count(F.col("s"))).collect()] == [4, 0, 0, 0]


REF = date(2026, 6, 16)


@pytest.mark.parametrize(
    ("anchor", "path", "want"),
    [
        ("", "/bulletins/2026-06-14-third-sunday/", date(2026, 6, 14)),
        ("", "/bulletins/06-14-2026-third-sunday/", date(2026, 6, 14)),
        ("Jun 15", "/wp-content/uploads/2025/06/June-15th-Bulletin.pdf", date(2025, 6, 15)),
        ("June 2026 Newsletter", "/", None),
        ("", "/bulletins/05/1315/20260614B.pdf", date(2026, 6, 14)),
        ("20260614 Weekly Update", "/bulletin", None),
        ("", "/x/2026-12-31/", None),
        ("December 25", "/x/", date(2025, 12, 25)),
        ("2026-02-30", "/", None),
    ],
)
def test_link_date(anchor, path, want):
    assert dates.link_date(anchor, "https://example.com" + path, REF) == want


def test_recency(spark):
    assert dates.recency_bonus(REF, REF) == 2.0 and dates.recency_bonus(None, REF) == 0.0
    assert dates.recency_bonus(date(2026, 5, 17), REF) == pytest.approx(1.0)
    rows = spark.createDataFrame([(REF,), (date(2026, 5, 17),), (date(2026, 6, 20),), (None,)], "d date")
    got = [r[0] for r in rows.select(dates.recency_bonus_expr(F.col("d"), F.lit(REF))).collect()]
    assert got == pytest.approx([2.0, 1.0, 2.0, 0.0])


def test_staleness():
    e = "https://example.com"
    assert dates.is_stale(e + "/bulletins/20260301B.pdf", REF) and not dates.is_stale(e + "/bulletins/20260614B.pdf", REF)
    assert dates.document_age(e + "/bulletins/20260614B.pdf", REF) == 2 and dates.document_age(e + "/latest.pdf", REF) is None and dates.document_age(e + "/20260301/", REF) is None


def test_reference_date():
    assert dates.reference_date("Find the latest bulletin", None, REF) == REF and dates.reference_date("Find jobs", "this  week", REF) == REF and dates.reference_date("Find jobs", None, REF) is None
