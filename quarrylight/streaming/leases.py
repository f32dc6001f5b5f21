"""Leases and expiry by event time: state for each key that ends by a timer.

Both take a stream (or a table of the same rows). A key's state is one number, and goes when its time is over, so the state is as large
as the number of keys that are open. Results do not depend on how rows fall into batches: rows of a key are taken in the order of
their time, and a time that has run out before the next row came counts as run out then.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrylight.config import DEFAULT

GRANT = "repo string, granted_ms long, until_ms long"
EXPIRY = "repo string, indexed_ms long, expired_ms long"


def _rows(stream: DataFrame, key: str, ts: str, delay: str, *more) -> DataFrame:
    rows = stream.select(F.col(key).cast("string").alias("repo"), F.col(ts).cast("timestamp").alias("ts"), *more).where("repo is not null and ts is not null")
    return rows.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", delay)


def build_leases(requests: DataFrame, lease_ms: int, delay: str = "0 seconds", ts: str = "ts") -> DataFrame:
    """requests (repo, ts, event: ask or done) to the grants: who asks while no lease of the repository runs is granted one. A lease ends
    when its build is done, or, if the builder is lost, after ``lease_ms``. Of events of the same time, done comes first."""

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else None
        granted = []
        rows = pd.concat(list(frames)).sort_values(["ms", "event"], ascending=[True, False], kind="stable")
        for ms, event in zip(rows["ms"].tolist(), rows["event"].tolist(), strict=True):
            if event == "done":
                until = None
            elif until is None or ms >= until:
                until = ms + lease_ms
                granted.append((group[0], ms, until))
        if until is None or until <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
        else:
            state.update((until,))
            state.setTimeoutTimestamp(until)
        if granted:
            yield pd.DataFrame(granted, columns=["repo", "granted_ms", "until_ms"])

    rows = _rows(requests, "repo", ts, delay, "event").where("event in ('ask', 'done')")
    return rows.groupBy("repo").applyInPandasWithState(update, GRANT, "until long", "append", GroupStateTimeout.EventTimeTimeout)


def index_expiries(builds: DataFrame, ttl_ms: int = DEFAULT.index_ttl_ms, delay: str = "0 seconds", repo: str = "repo", ts: str = "ts") -> DataFrame:
    """builds (repo, ts) of indexes to the times at which an index ran out, each once: no build came within ``ttl_ms``."""

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append((group[0], last, last + ttl_ms))
            last = None
        else:
            for ms in sorted(pd.concat(list(frames))["ms"].tolist()):
                if last is not None and ms > last + ttl_ms:
                    out.append((group[0], last, last + ttl_ms))
                last = ms if last is None else max(last, ms)
            if last + ttl_ms < state.getCurrentWatermarkMs():
                out.append((group[0], last, last + ttl_ms))
                last = None
        if last is None:
            if state.exists:
                state.remove()
        else:
            state.update((last,))
            # A timer goes off once the watermark is beyond it.
            state.setTimeoutTimestamp(last + ttl_ms)
        if out:
            yield pd.DataFrame(out, columns=["repo", "indexed_ms", "expired_ms"])

    return _rows(builds, repo, ts, delay).groupBy("repo").applyInPandasWithState(update, EXPIRY, "last long", "append", GroupStateTimeout.EventTimeTimeout)
