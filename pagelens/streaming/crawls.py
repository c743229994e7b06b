"""Crawls over streams: rows of requests, snapshots and replies arrive; a crawl's events leave when it is complete.

State is kept by crawl_id: the rows seen so far. A row of kind ``go`` (or the timeout) runs the crawl once over them.
State is bounded by the rows of one crawl and is dropped with its events.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.plans.crawl import EVENT_SCHEMA, replay_group


def crawl_stream(rows: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """Events of crawls from a stream of crawl_id, kind (request, page, reply, go), norm_url, attempt, body.

    With a timeout, a crawl whose rows have stopped for so long runs without a row of kind ``go``.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = [pickle.loads(state.get[0])] if state.exists else []
        ended = state.hasTimedOut
        for frame in frames:
            held.append(frame[["kind", "norm_url", "attempt", "body"]])
            ended = ended or bool((frame["kind"] == "go").any())
        every = pd.concat(held, ignore_index=True) if held else pd.DataFrame(columns=["kind", "norm_url", "attempt", "body"])
        if ended:
            state.remove()
            out = replay_group(key[0], every[every["kind"] != "go"])
            if len(out):
                yield out
        else:
            state.update((pickle.dumps(every),))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)

    return rows.groupBy("crawl_id").applyInPandasWithState(step, EVENT_SCHEMA, "rows binary", "append", "NoTimeout" if timeout_ms is None else "ProcessingTimeTimeout")


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events of each type by window of event time (column ts), late rows dropped after the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
