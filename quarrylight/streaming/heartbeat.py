"""Signs of life of streaming queries: a row for each batch, kept in a bounded list."""

from __future__ import annotations

from collections import deque

from pyspark.sql.streaming import StreamingQueryListener


class Heartbeat(StreamingQueryListener):
    """To be added to ``spark.streams``; ``beats`` holds the last batches as (query, batch, rows, milliseconds)."""

    def __init__(self, most: int = 1000):
        self.beats: deque = deque(maxlen=most)
        self.ended: deque = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.beats.append((p.name or str(p.id), p.batchId, p.numInputRows, p.durationMs.get("triggerExecution", 0)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append((str(event.id), event.exception))
