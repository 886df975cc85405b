"""Streams of items: micro-batches closed by count or time, resumable translation, progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# The batcher's defaults.
MAX_ITEMS, MAX_WAIT_MS = 8, 10


class CountOrTime(StatefulProcessor):
    """Collects the items of a key; a batch closes at max_items, or max_wait_ms after its first item."""

    def __init__(self, max_items: int = MAX_ITEMS, max_wait_ms: int = MAX_WAIT_MS):
        self.max_items, self.max_wait_ms = max_items, max_wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "item string")
        self.number = handle.getValueState("number", "n bigint")

    def _close(self, key, items: list[str], why: str) -> pd.DataFrame:
        n = self.number.get()[0] if self.number.exists() else 0
        self.number.update((n + 1,))
        return pd.DataFrame({"key": [key[0]], "batch": [n], "items": [items], "why": [why]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = [x[0] for x in self.items.get()] if self.items.exists() else []
        started = bool(waiting)
        for part in rows:
            for item in part["item"].tolist():
                waiting.append(item)
                if len(waiting) == self.max_items:
                    yield self._close(key, waiting, "count")
                    waiting, started = [], False
        self.items.clear()
        if waiting:
            self.items.put([(x,) for x in waiting])
            if not started:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.max_wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = [x[0] for x in self.items.get()] if self.items.exists() else []
        if waiting:
            self.items.clear()
            yield self._close(key, waiting, "time")

    def close(self) -> None:
        pass


def micro_batches(items: DataFrame, max_items: int = MAX_ITEMS, max_wait_ms: int = MAX_WAIT_MS) -> DataFrame:
    """Streaming (key, item) as batches (key, batch, items, why); needs a state store that keeps several states."""
    return items.groupBy("key").transformWithStateInPandas(CountOrTime(max_items, max_wait_ms), "key string, batch bigint, items array<string>, why string", "append", "ProcessingTime")


def batches_by_count(items: DataFrame, max_items: int = MAX_ITEMS, key: str = "key", order: str = "id") -> DataFrame:
    """The same by count alone over a finished table: key, batch, items."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    grouped = items.withColumn("batch", F.floor(n / max_items).cast("long")).groupBy(key, "batch").agg(F.array_sort(F.collect_list(F.struct(order, "item"))).alias("s"))
    return grouped.select(key, "batch", F.transform("s", lambda s: s["item"]).alias("items"))


def read_rate_limited(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream that takes so many files at a time: back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_resumable(stream: DataFrame, checkpoint: str, out: str, step: Callable[[DataFrame], DataFrame]):
    """Each micro-batch goes through step into a folder of its own number: a batch that is repeated after a crash replaces its folder."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Rows so far and rows a second of running queries; ``stopped`` holds the reasons of ends."""

    def __init__(self):
        self.rows, self.speed, self.stopped = 0, 0.0, []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows += event.progress.numInputRows
        self.speed = event.progress.processedRowsPerSecond

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.stopped.append(event.exception)

    def eta_seconds(self, total: int) -> float | None:
        return (total - self.rows) / self.speed if self.speed else None


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Beyond the line pipeline: events by type and window of event time, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
