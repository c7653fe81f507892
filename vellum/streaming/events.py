"""Event-time windows, sessions, latest states and replayed episodes; the same code serves batch and streams.

On streams, give ``watermark`` so that state is dropped; batch reads ignore it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _late(events: DataFrame, at: str, watermark: str | None) -> DataFrame:
    if not (watermark and events.isStreaming):
        return events
    # Watermarks need an instant; a timestamp without zone is read in the session's.
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, watermark)


def windowed(events: DataFrame, at: str, width: str, keys: Sequence[str], value: str, watermark: str | None = None) -> DataFrame:
    """(start, keys, n, total) per tumbling window."""
    g = _late(events, at, watermark).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return g.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, key: str, watermark: str | None = None) -> DataFrame:
    """(key, start, n) per run of events less than ``gap`` apart."""
    g = _late(events, at, watermark).groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n"))
    return g.select(key, F.col("session_window.start").alias("start"), "n")


def latest(events: DataFrame, key: str, order: Sequence[str], take: Sequence[str]) -> DataFrame:
    """The last row per key: one aggregate, mergeable on the map side and in streams."""
    m = events.groupBy(key).agg(F.max_by(F.struct(*take), F.struct(*order)).alias("m"))
    return m.select(key, *[F.col("m")[c].alias(c) for c in take])


def replayed(events: DataFrame) -> DataFrame:
    """(user_id, steps, errors, total, last_event): the final state of every user's episode, as one mergeable aggregate."""
    return events.groupBy("user_id").agg(F.count("*").alias("steps"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.sum("value"), 4).alias("total"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"))


def _steps(events: DataFrame) -> Window:
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def running_episodes(events: DataFrame, end: str, most: int) -> DataFrame:
    """Every step of every episode until it ends (event ``end``, or ``most`` steps): step, errors so far, does it end here."""
    w = _steps(events)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    s = events.select("event_id", "user_id", "ts", "event_type").withColumn("step", F.row_number().over(w)).withColumn("errors", F.count_if(F.col("event_type") == "error").over(upto)).withColumn("_ends", F.count_if(F.col("event_type") == end).over(before))
    return s.where((F.col("_ends") == 0) & (F.col("step") <= most)).withColumn("terminated", (F.col("event_type") == end) | (F.col("step") == most)).drop("_ends")


def replayed_matches(events: DataFrame, match: str, after: str, cap: int) -> DataFrame:
    """Steps of type ``match`` that the replayed episode reaches after an ``after``, at most ``cap`` per user (the cap is the feature)."""
    w = _steps(events)
    s = events.select("event_id", "user_id", "ts", "event_type").withColumn("step", F.row_number().over(w)).withColumn("_b", F.count_if(F.col("event_type") == after).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    hit = s.where((F.col("event_type") == match) & (F.col("_b") > 0)).withColumn("_n", F.row_number().over(Window.partitionBy("user_id").orderBy("step")))
    return hit.where(F.col("_n") <= cap).drop("_b", "_n")


def resumable(rows: DataFrame, keys: Sequence[str], at: str | None = None, delay: str = "1 hour") -> DataFrame:
    """First row per key of an append stream; with an event time, state older than ``delay`` is dropped."""
    if rows.isStreaming and at:
        return _late(rows, at, delay).dropDuplicatesWithinWatermark(list(keys))
    return rows.dropDuplicates(list(keys))


EPISODE = "user_id long, steps long, errors long, last_event string"


def episodes(events: DataFrame) -> DataFrame:
    """Running episode state per user on a stream (custom state in pandas): one row per user and trigger."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        steps, errors, last = state.get if state.exists else (0, 0, "")
        for b in batches:
            b = b.sort_values(["ts", "event_id"])
            steps, errors = steps + len(b), errors + int((b["event_type"] == "error").sum())
            last = b["event_type"].iloc[-1] if len(b) else last
        state.update((steps, errors, last))
        yield pd.DataFrame({"user_id": [key[0]], "steps": [steps], "errors": [errors], "last_event": [last]})

    return events.groupBy("user_id").applyInPandasWithState(step, EPISODE, "steps long, errors long, last_event string", "update", "NoTimeout")


def monitor(stream: DataFrame, sink, every: str = "10 seconds", checkpoint: str | None = None):
    """Poll a stream: ``sink(batch, number)`` per trigger, restartable from ``checkpoint``."""
    w = stream.writeStream.foreachBatch(sink).trigger(processingTime=every)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
