"""robots.txt as a dimension table by host, and the policy that it sets."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGENT = "Pagelens"


def policy(status: Column, error: Column) -> Column:
    """unrestricted, parse, or the reason why a host must not be crawled."""
    return (
        F.when(error == "timeout", "blocked:timeout").when(error.isNotNull(), "blocked:unreachable").when((status >= 400) & (status < 500) & (status != 429), "unrestricted")
        .when(status == 200, "parse").when(status.isNull(), "blocked:unreachable").otherwise(F.concat(F.lit("blocked:http_"), status.cast("string")))
    )


def policy_of(status: int | None, error: str | None) -> str:
    """:func:`policy` for one file."""
    if error is not None or status is None:
        return "blocked:timeout" if error == "timeout" else "blocked:unreachable"
    if 400 <= status < 500 and status != 429:
        return "unrestricted"
    return "parse" if status == 200 else f"blocked:http_{status}"


def parse(body: str, agent: str = AGENT) -> tuple[RobotFileParser | None, float]:
    """The rules of a file and its delay for the agent, else for all; no rules if the file cannot be read."""
    try:
        rules = RobotFileParser()
        rules.parse(body.splitlines())
        own, every = rules.crawl_delay(agent), rules.crawl_delay("*")
        return rules, float(own if own is not None else every or 0)
    except (ValueError, UnicodeError):
        return None, 0.0


def dimension(robots: DataFrame) -> DataFrame:
    """host, policy, body from rows host, status, body, error: one row a host, the first by status for repeats."""
    one = robots.groupBy("host").agg(F.min_by(F.struct("status", "body", "error"), F.struct(F.coalesce("status", F.lit(999)), F.coalesce("body", F.lit("")))).alias("r"))
    return one.select("host", policy(F.col("r.status"), F.col("r.error")).alias("policy"), F.col("r.body").alias("body"))


def check(urls: DataFrame, robots: DataFrame, default_delay: float = 1.0, agent: str = AGENT) -> DataFrame:
    """Add allowed, delay and policy to rows with url and host; hosts without an entry are not to be crawled."""
    joined = urls.join(dimension(robots), "host", "left").withColumn("policy", F.coalesce("policy", F.lit("blocked:unreachable")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.drop("body").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            allowed, delays, said = [], [], []
            for url, host, rule, body in zip(*(batch.column(c).to_pylist() for c in ("url", "host", "policy", "body")), strict=True):
                if rule != "parse":
                    allowed.append(rule == "unrestricted")
                    delays.append(default_delay)
                    said.append(rule)
                    continue
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = parse(body or "", agent)
                rules, delay = known[host]
                ok = rules is not None and rules.can_fetch(agent, url)
                allowed.append(ok)
                delays.append(max(delay, default_delay) if delay > 0 else default_delay)
                said.append("blocked:unparsable" if rules is None else "allowed" if ok else "disallowed")
            kept = [pa.array(said, pa.string()) if n == "policy" else batch.column(n) for n in batch.schema.names if n != "body"]
            names = [n for n in batch.schema.names if n != "body"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(allowed, pa.bool_()), pa.array(delays, pa.float64())], names=[*names, "allowed", "delay"])

    return joined.mapInArrow(run, kinds + ", allowed boolean, delay double")
