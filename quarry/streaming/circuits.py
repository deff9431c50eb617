"""A circuit breaker over a stream of job records: the state of a provider is the failures still in its window."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "job_id long, provider string, failures long, open boolean"


class Breaker(StatefulProcessor):
    """Failures of one provider within the window, and when its circuit opened last; a timer clears what has run out."""

    def __init__(self, window: int, threshold: int, pause: int) -> None:
        self.window, self.threshold, self.pause = window, threshold, pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failed = handle.getListState("failed", "at long")
        self.opened = handle.getValueState("opened", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = [at for (at,) in self.failed.get()] if self.failed.exists() else []
        opened = self.opened.get()[0] if self.opened.exists() else None
        new = sorted((t, i, s) for pdf in rows for t, i, s in zip(pdf["at"], pdf["job_id"], pdf["status"]))
        out = []
        for at, same in groupby(new, key=lambda r: r[0]):  # records of one moment see each other
            same = list(same)
            failures = [at] * sum(s == "failed" for _, _, s in same)
            times = [t for t in times if at - t <= self.window] + failures
            if failures and len(times) > self.threshold:
                opened = at
            is_open = opened is not None and at - opened < self.pause
            out += [(i, key[0], len(times), is_open) for _, i, _ in same]
        if times:
            self.failed.put([(t,) for t in times])
        else:
            self.failed.clear()
        if opened is not None:
            self.opened.update((opened,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((new[-1][0] + max(self.window, self.pause)) // 1000 + 1)
        yield pd.DataFrame(out, columns=["job_id", "provider", "failures", "open"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.failed.clear()
        self.opened.clear()
        return iter([])

    def close(self) -> None:
        pass


def breaker_stream(jobs: DataFrame, window_s: int, threshold: int, pause_s: int, watermark: str = "10 minutes") -> DataFrame:
    """(job_id, provider, failures, open) of a stream of jobs (job_id, provider, status, ts), as ``operations.breaker`` gives them for a table.

    Records must come in the order of their time, but for those of one batch.
    A provider that falls silent for longer than the window and the pause
    leaves no state. Needs the RocksDB state store; records of no provider are
    one provider.
    """
    rows = jobs.withWatermark("ts", watermark)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = rows.select("ts", "job_id", F.coalesce("provider", F.lit("")).alias("provider"), "status", at.alias("at"))
    own = Breaker(window_s * 1_000_000, threshold, pause_s * 1_000_000)
    found = rows.groupBy("provider").transformWithStateInPandas(own, OUT, "Append", "EventTime")
    return found.withColumn("provider", F.nullif("provider", F.lit("")))
