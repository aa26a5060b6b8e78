"""Events for many listeners: a bounded ring with replay for live ones, a log folder for the rest."""

from __future__ import annotations

import queue
import threading
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RING, SLOTS = 10_000, 256
POLL, PAGE, HEARTBEAT = "700 milliseconds", 500, 20
SCHEMA = "id bigint, session_id string, level string, message string, table_name string, processed_rows bigint, total_rows bigint"


class Hub:
    """One run's live events. A listener that falls ``SLOTS`` behind is dropped; it can come back with its last id."""

    def __init__(self, ring: int = RING, slots: int = SLOTS):
        self.ring, self.slots, self.lock = deque(maxlen=ring), slots, threading.Lock()
        self.listeners: list[queue.Queue] = []
        self.finished = False

    def publish(self, event: dict) -> None:
        with self.lock:
            self.ring.append(event)
            for q in list(self.listeners):
                try:
                    q.put_nowait(event)
                except queue.Full:
                    self.listeners.remove(q)
                    q.closed = True

    def subscribe(self, from_id: int = 0) -> tuple[list[dict], queue.Queue]:
        """Events from ``from_id`` on, inclusive, and a queue of what comes next; None in it ends the stream."""
        with self.lock:
            q: queue.Queue = queue.Queue(self.slots + 1)
            q.closed = self.finished
            if self.finished:
                q.put(None)
            else:
                q.maxsize = self.slots
                self.listeners.append(q)
            return [e for e in self.ring if e["id"] >= from_id], q

    def finish(self) -> None:
        with self.lock:
            self.finished = True
            for q in self.listeners:
                q.maxsize = 0
                q.put(None)
                q.closed = True
            self.listeners.clear()


class Runs:
    """At most one run of a session at a time."""

    def __init__(self):
        self.lock, self.active = threading.Lock(), {}

    def begin(self, session: str) -> Hub:
        with self.lock:
            if (old := self.active.get(session)) and not old.finished:
                raise RuntimeError(f"session {session} is running already")
            hub = self.active[session] = Hub()
            return hub


def tail_stream(spark: SparkSession, path: str) -> DataFrame:
    """The event log as a stream; each id once, however often a file is written again."""
    return spark.readStream.schema(SCHEMA).parquet(path).filter(F.col("id") >= 0).dropDuplicates(["id"])


def follow(spark: SparkSession, path: str, write, checkpoint: str, once: bool = True):
    """``write(frame, batch_id)`` for what is new: every 700 ms, or once for what is there."""
    w = tail_stream(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    q = (w.trigger(availableNow=True) if once else w.trigger(processingTime=POLL)).start()
    if once:
        q.awaitTermination()
    return q
