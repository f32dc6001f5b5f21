"""Structured Streaming: manifest changes, windowed metrics, expiry of indexes.

Batch and stream share their transformations, so that a replay of a stream gives the batch's result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrylight.config import DEFAULT
from quarrylight.operators.dependencies import orphaned_repos, removed
from quarrylight.plans.store import latest
from quarrylight.sources.manifests import read_manifests

FILE_EVENT = "path string, event_type string, ts timestamp, content string"


def file_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The change feed: JSON files of events that appear in a folder, a bounded number a trigger."""
    return spark.readStream.schema(FILE_EVENT).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def settled(events: DataFrame) -> DataFrame:
    """The last event of each path in a batch: what came before has been overtaken."""
    return latest(events, ["path"], "ts")


def apply_changes(state: DataFrame, events: DataFrame) -> DataFrame:
    """state (path, content) after the events. A removed path keeps its content until another event brings new content
    or the removal is confirmed by a ``gone`` event, as editors unlink a file before they rename the new one to it."""
    last = settled(events)
    changed = last.where("event_type in ('add', 'change') and content is not null").select("path", "content")
    gone = last.where("event_type = 'gone'").select("path")
    kept = state.join(changed.select("path").unionByName(gone), "path", "left_anti")
    return kept.unionByName(changed)


def scan_difference(before: DataFrame, after: DataFrame, repos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dependencies that two states of the manifests differ by, and the repositories that nothing refers to any more."""
    old, new = read_manifests(before), read_manifests(after)
    gone = removed(old.where("error is null"), new.where("error is null"))
    return gone, orphaned_repos(gone, new, repos)


class ManifestWatcher:
    """Keeps the manifests' state in versions under a folder and calls back with what each batch removed."""

    def __init__(self, spark: SparkSession, folder: str, repos: DataFrame, on_removed: Callable[[DataFrame, DataFrame], None]):
        self.spark, self.folder, self.repos, self.on_removed = spark, folder, repos, on_removed

    def state(self, version: int) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], "path string, content string")
        return self.spark.read.schema("path string, content string").parquet(f"{self.folder}/v={version}")

    def batch(self, events: DataFrame, number: int) -> None:
        before = self.state(number - 1)
        # Overwriting makes a batch that is run again give the same version.
        apply_changes(before, events).write.mode("overwrite").parquet(f"{self.folder}/v={number}")
        self.on_removed(*scan_difference(before, self.state(number), self.repos))

    def start(self, events: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        writer = events.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def tumbling(samples: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", width: str = "30 seconds", late: str | None = None) -> DataFrame:
    """count, total, lowest and highest in tumbling windows; with ``late`` as watermark, for streams."""
    rows = samples.withWatermark(ts, late) if late else samples
    out = rows.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("lowest"), F.max(value).alias("highest"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "total", "lowest", "highest")


def running_percentiles(samples: DataFrame, key: str, value: str = "value", most: int = DEFAULT.metric_samples) -> DataFrame:
    """p50 and p95 of the last samples of each key, updated with every batch. The state of a key is at most ``most``
    numbers; samples of a key are taken in the order of their time in each batch."""

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, n = state.get if state.exists else ([], 0)
        frame = pd.concat(list(frames)).sort_values("ts", kind="stable")
        kept = [*kept, *frame["value"].tolist()][-most:]
        n += len(frame)
        state.update((kept, n))
        ordered = sorted(kept)
        at = lambda p: ordered[min(int(p * len(ordered)), len(ordered) - 1)]
        yield pd.DataFrame([(group[0], n, at(0.5), at(0.95))], columns=[key, "n", "p50", "p95"])

    rows = samples.select(F.col(key).cast("string").alias(key), "ts", F.col(value).cast("double").alias("value"))
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} string, n long, p50 double, p95 double", "kept array<double>, n long", "update", GroupStateTimeout.NoTimeout)


def expiring(status: DataFrame, now_ms: int, ttl_ms: int = DEFAULT.index_ttl_ms) -> DataFrame:
    """Statuses with whether they are still fresh at a time."""
    return status.withColumn("fresh", F.col("indexed_at_ms") > now_ms - ttl_ms)


class Breaker:
    """Keeps from calling what has failed, until a time has passed. The clock is an argument, in seconds."""

    def __init__(self, wait_s: float = 60.0):
        self.wait_s, self.failed_at = wait_s, None

    def call(self, now_s: float, work: Callable, fallback: Callable):
        if self.failed_at is not None and now_s - self.failed_at < self.wait_s:
            return fallback()
        try:
            result = work()
        except Exception:
            self.failed_at = now_s
            return fallback()
        self.failed_at = None
        return result
