"""The watcher's own state: its single-writer lock and heartbeat, its progress, and its status beside the dirty files."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from orrery.sources.fs import Folder, Log
from orrery.sources.store import liveness

#: A heartbeat older than this is that of a writer that is gone.
STALE_MS = 30_000


def now_ms() -> int:
    return time.time_ns() // 1_000_000


class WriterLock:
    """One writer at a time. The lock is a numbered log of heartbeats: who publishes the next number holds it."""

    def __init__(self, spark: SparkSession, root: str, owner: str, stale_ms: int = STALE_MS):
        self._log, self.owner, self.stale_ms = Log(Folder(spark, root), "lock"), owner, stale_ms

    def acquire(self, at: int | None = None) -> bool:
        """Take the lock if it is free, one's own, or its heartbeat stale. Of two takers at once one gets it."""
        at = now_ms() if at is None else at
        last = self._log.last()
        if last and last[1]["owner"] not in (self.owner, None) and at - last[1]["heartbeat_ms"] <= self.stale_ms:
            return False
        return self._log.put(last[0] + 1 if last else 1, {"owner": self.owner, "heartbeat_ms": at, "exited": False})

    def heartbeat(self, at: int | None = None) -> bool:
        """Renew the lock; False if it has been taken over."""
        last = self._log.last()
        return bool(last) and last[1]["owner"] == self.owner and self.acquire(at)

    def release(self, at: int | None = None) -> None:
        last = self._log.last()
        if last and last[1]["owner"] == self.owner:
            self._log.put(last[0] + 1, {"owner": None, "heartbeat_ms": now_ms() if at is None else at, "exited": True})

    def state(self) -> dict | None:
        last = self._log.last()
        return last[1] if last else None


def record_progress(spark: SparkSession, root: str, state: dict, at: int | None = None) -> int:
    """Make `state` the current progress and add it to the log; returns its number."""
    log = Log(Folder(spark, root), "progress")
    at = now_ms() if at is None else at
    n = (log.last() or (0, {}))[0] + 1
    while not log.put(n, state | {"at_ms": at}):
        n += 1
    Folder(spark, f"{root}/progress_log").create(f"{n:012d}.json", json.dumps(state | {"at_ms": at, "n": n}, sort_keys=True) + "\n")
    return n


def progress(spark: SparkSession, root: str) -> dict | None:
    last = Log(Folder(spark, root), "progress").last()
    return last[1] if last else None


def progress_tail(spark: SparkSession, root: str, most: int = 20) -> DataFrame:
    """(n, at_ms, phase, done, total): the last entries of the progress log, in order."""
    schema = "n long, at_ms long, phase string, done long, total long"
    if not Folder(spark, f"{root}/progress_log").names():
        return spark.createDataFrame([], schema)
    last = spark.read.schema(schema).json(f"{root}/progress_log").orderBy(F.desc("n")).limit(most)
    return last.orderBy("n")


def watch_status(spark: SparkSession, root: str, dirty: DataFrame | None, at: int | None = None) -> DataFrame:
    """One row: the watcher's liveness, how old its heartbeat is, and the dirty files by status."""
    at = now_ms() if at is None else at
    lock = WriterLock(spark, root, "").state() or {}
    age = at - lock["heartbeat_ms"] if lock else None
    one = spark.createDataFrame([(lock.get("owner"), age, bool(lock.get("exited")))], "owner string, heartbeat_age_ms long, exited boolean")
    one = one.withColumn("watcher", liveness(F.col("heartbeat_age_ms"), F.col("exited"), STALE_MS))
    statuses = ("pending", "indexing", "dead_letter")
    if dirty is None:
        return one.select("watcher", "owner", "heartbeat_age_ms", *[F.lit(0).cast("long").alias(s) for s in statuses])
    n = dirty.agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])
    return one.crossJoin(n).select("watcher", "owner", "heartbeat_age_ms", *statuses)  # one row each


def with_dirty(files: DataFrame, dirty: DataFrame) -> DataFrame:
    """Files (project_id, path, status, ...) whose status is `stale` where an event on them is pending or being indexed."""
    waiting = dirty.where("status IN ('pending', 'indexing')").select("project_id", "path").distinct().withColumn("_dirty", F.lit(True))
    j = files.join(waiting, ["project_id", "path"], "left")
    fresh = F.col("status").isin("deleted", "skipped")
    return j.withColumn("status", F.when(F.col("_dirty") & ~F.coalesce(fresh, F.lit(False)), "stale").otherwise(F.col("status"))).select(*files.columns)


class StatusPush(StreamingQueryListener):
    """Hands the status of streams to a receiver: `push(dict)` is called when one starts, advances, idles or ends."""

    def __init__(self, push):
        self._push = push

    def onQueryStarted(self, event):
        self._push({"phase": "started", "name": event.name, "id": str(event.id)})

    def onQueryProgress(self, event):
        p = event.progress
        self._push({"phase": "running", "name": p.name, "id": str(p.id), "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event):
        self._push({"phase": "idle", "id": str(event.id)})

    def onQueryTerminated(self, event):
        self._push({"phase": "failed" if event.exception else "ended", "id": str(event.id), "error": event.exception})
