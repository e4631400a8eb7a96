"""Structured Streaming forms: crawl budget of access logs, and the request throttle."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from crawlloom.operators.logs import budget, parsed


def log_lines(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)


def running_budget(lines: DataFrame) -> DataFrame:
    """``budget`` as a stream in update mode: state is one row a path, and as last_seen is a
    maximum, late lines change nothing."""
    return budget(parsed(lines))


def windowed_hits(lines: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, bot, hits) in append mode: a window is final once the watermark has passed it,
    so state is bounded by ``late``; lines later than that are dropped."""
    hits = parsed(lines).withWatermark("ts", late)
    return hits.groupBy(F.window("ts", window), "bot").agg(F.count("*").alias("hits"))


THROTTLE = "host string, event_id long, delay double"


def throttled(events: DataFrame, least: float = 0.5, most: float = 30.0, up: float = 1.0, down: float = 0.25, slow_ms: float = 3000.0) -> DataFrame:
    """Delay after each answer of a host, from events (host, event_id, status_code, ms): two
    steps up for 429 and 5xx, one for slow answers, else down; clamped. The state is a number
    a host; events of a batch are taken in order of event_id."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        delay = state.get[0] if state.exists else least
        rows = pd.concat(list(batches)).sort_values("event_id")
        out = []
        for e, s, ms in zip(rows["event_id"], rows["status_code"], rows["ms"]):
            delay += 2 * up if s == 429 or s >= 500 else up if ms > slow_ms else -down
            delay = min(most, max(least, delay))
            out.append((key[0], e, delay))
        state.update((delay,))
        yield pd.DataFrame(out, columns=["host", "event_id", "delay"])

    return events.groupBy("host").applyInPandasWithState(step, THROTTLE, "delay double", "append", "NoTimeout")


class Progress(StreamingQueryListener):
    """Progress snapshots of streams: {query, batch, rows, rows_per_second, status} to ``tell``,
    at most one in ``every`` seconds while a query runs; its end is always told."""

    def __init__(self, tell: Callable[[dict], None], every: float = 0.25, clock: Callable[[], float] = time.monotonic) -> None:
        self.tell, self.every, self.clock = tell, every, clock
        self.last: dict[str, float] = {}

    def onQueryStarted(self, event) -> None:
        self.tell({"query": str(event.id), "batch": -1, "rows": 0, "rows_per_second": 0.0, "status": "started"})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        now = self.clock()
        if now - self.last.get(str(p.id), -self.every) < self.every:
            return
        self.last[str(p.id)] = now
        self.tell({"query": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": round(p.processedRowsPerSecond or 0.0, 2), "status": "running"})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.last.pop(str(event.id), None)
        self.tell({"query": str(event.id), "batch": -1, "rows": 0, "rows_per_second": 0.0, "status": "failed" if event.exception else "finished"})
