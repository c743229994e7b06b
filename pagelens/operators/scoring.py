"""Scores of trial runs against an answer key, and comparison of two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score(trials: DataFrame, key: DataFrame) -> DataFrame:
    """Add verdict (PASS, FAIL, ERROR, or SKIP without a key) to trials: trial, found, answer, result_url, error.

    key: trial, found, answer_contains (any of them, case aside; null: none asked), result_url_contains (null: none).
    """
    wanted = key.select("trial", F.col("found").alias("_found"), "answer_contains", "result_url_contains")
    rows = trials.join(wanted, "trial", "left")
    answered = F.col("answer_contains").isNull() | F.coalesce(F.exists("answer_contains", lambda x: F.contains(F.lower("answer"), F.lower(x))), F.lit(False))
    placed = F.col("result_url_contains").isNull() | F.coalesce(F.contains(F.lower("result_url"), F.lower("result_url_contains")), F.lit(False))
    verdict = F.when(F.col("_found").isNull(), "SKIP").when(F.col("error").isNotNull(), "ERROR").when((F.col("found") == F.col("_found")) & answered & placed, "PASS").otherwise("FAIL")
    return rows.withColumn("verdict", verdict).drop("_found", "answer_contains", "result_url_contains")


def pass_rates(scored: DataFrame) -> DataFrame:
    """trial, runs, pass_rate."""
    return scored.filter("verdict <> 'SKIP'").groupBy("trial").agg(F.count("*").alias("runs"), F.avg((F.col("verdict") == "PASS").cast("double")).alias("pass_rate"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """trial, pass_rate_before, pass_rate_after, change of two runs; trials of one run alone keep a null on the other side."""
    a, b = (r.select("trial", F.col("pass_rate").alias(f"pass_rate_{n}")) for r, n in ((before, "before"), (after, "after")))
    return a.join(b, "trial", "full_outer").withColumn("change", F.col("pass_rate_after") - F.col("pass_rate_before"))
