"""Review events as streams. Each function also runs on a batch of the same events, with equal results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def valid(events: DataFrame, decisions: tuple[str, ...], placeholders: tuple[str, ...] = ("", "unknown", "test")) -> DataFrame:
    """Events with a known decision, a real reviewer and a key."""
    reviewer = F.lower(F.trim(F.col("reviewer").cast("string")))
    return events.where(F.col("decision").isin(*decisions) & ~F.coalesce(reviewer, F.lit("")).isin(*placeholders) & F.col("item").isNotNull())


def once(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each event_id once, within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def per_window(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(begins, decision, n, value) by window of event time; rows later than the watermark are left out of a stream."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    by = rows.groupBy(F.window("ts", width).alias("w"), "decision").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return by.select(F.col("w.start").alias("begins"), "decision", "n", "value")


def running_verdicts(events: DataFrame) -> DataFrame:
    """(item, n, first, verdict) after each batch that touches an item: how many events it has had, the first decision by time,
    then event_id, and `mixed` where decisions differ. An event without a decision counts but decides nothing. State is the
    aggregates of an item, combined before they reach it."""
    told = F.when(F.col("decision").isNotNull(), F.struct("ts", "event_id"))
    by = events.groupBy("item").agg(F.count("*").alias("n"), F.min_by("decision", told).alias("first"), F.min("decision").alias("lo"), F.max("decision").alias("hi"))
    return by.select("item", "n", "first", F.when(F.col("lo") != F.col("hi"), "mixed").otherwise(F.col("first")).alias("verdict"))


def leases(beats: DataFrame, patience_s: int = 60) -> DataFrame:
    """(item, worker, state) from heartbeats (item, worker, ts): `held` when a worker takes an item or keeps it, `expired` when
    none comes for `patience_s` of event time. Needs a watermark on ts; a beat of another worker is ignored while held."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (worker, _) = state.get
            state.remove()
            yield pd.DataFrame({"item": [key[0]], "worker": [worker], "state": ["expired"]})
            return
        worker, till = state.get if state.exists else (None, 0)
        for pdf in batches:
            for ts, who in pdf.sort_values(["ts", "worker"])[["ts", "worker"]].itertuples(index=False):
                ms = int(ts.value // 10**6)
                if worker is None or ms > till or who == worker:
                    worker, till = who, ms + patience_s * 1000
        state.update((worker, till))
        state.setTimeoutTimestamp(max(till, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"item": [key[0]], "worker": [worker], "state": ["held"]})

    return beats.groupBy("item").applyInPandasWithState(step, "item long, worker string, state string", "worker string, till long", "append", GroupStateTimeout.EventTimeTimeout)
