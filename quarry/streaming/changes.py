"""Structured Streaming: applying change events to a table, and a circuit breaker over job records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.operations import last_events


def apply_changes(current: DataFrame, events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The table after the last event of each key: ``deleted`` and ``purged`` take the row away, others put it there.

    Events older than the row's own, by ``order``, change nothing, so that
    applying a batch again does no harm.
    """
    last = last_events(events, key, order)
    stamped = current.withColumn("_own", F.struct(*order)).select(key, "_own", F.struct(*[c for c in current.columns if c != key]).alias("_row"))
    new = last.withColumn("_new", F.struct(*order)).select(key, "_new", "op", F.struct(*[c for c in current.columns if c != key]).alias("_change"))
    both = stamped.join(new, key, "full")
    newer = F.col("_new").isNotNull() & (F.col("_own").isNull() | (F.col("_new") > F.col("_own")))
    row = F.when(newer, F.when(~F.col("op").isin("deleted", "purged"), F.col("_change"))).otherwise(F.col("_row"))
    return both.select(key, row.alias("_out")).where("_out is not null").select(key, "_out.*")


def change_stream(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, watermark: str = "1 hour") -> StreamingQuery:
    """Run ``apply`` on each micro-batch of a change stream (ts, ...) until what is there is done; repeated events come once."""
    once = events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
    return once.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failure_windows(jobs: DataFrame, window: str, slide: str, threshold: int, watermark: str = "10 minutes") -> DataFrame:
    """(provider, start, failures) of sliding windows in which a provider failed more often than the threshold."""
    failed = jobs.where("status = 'failed'").withWatermark("ts", watermark)
    counts = failed.groupBy("provider", F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("failures"))
    return counts.where(F.col("failures") > threshold).select("provider", F.col("w.start").alias("start"), "failures")
