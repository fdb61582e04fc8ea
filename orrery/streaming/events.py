"""File events as a stream: journal source, coalescing, dirty state, retries, event-time windows.

Every transformation here is a function of DataFrames that holds for batches and streams alike; `run_available` drives a
stream of what is there now into a state table, batch by batch and each batch once.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.session import ensure_checkpoint_dir
from orrery.sources.fs import Folder

JOURNAL = "event string, file_path string, observed_at_ms long, _bad string"
KINDS = ("add", "change", "unlink", "addDir", "unlinkDir")


def journal(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Journal lines, malformed ones and unknown events dropped, paths with forward slashes."""
    r = (spark.readStream if stream else spark.read).schema(JOURNAL).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    j = r.json(path).where(F.col("_bad").isNull() & F.col("event").isin(*KINDS) & F.col("file_path").isNotNull() & F.col("observed_at_ms").isNotNull())
    return j.select("event", F.translate(F.trim("file_path"), "\\", "/").alias("file_path"), "observed_at_ms").where("file_path <> ''")


def replay_paths(j: DataFrame) -> DataFrame:
    return j.select("file_path").distinct().orderBy("file_path")


def append_journal(spark: SparkSession, folder: str, events: list[dict]) -> str:
    """Add events to a journal, which is a folder of files with one line per event; returns the new file's name. A reader sees all of them or none."""
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json"
    Folder(spark, folder).create(name, "".join(json.dumps(e, sort_keys=True) + "\n" for e in events))
    return name


def truncate_journal(spark: SparkSession, folder: str) -> int:
    """Remove the files that a journal holds now; returns how many."""
    f = Folder(spark, folder)
    names = f.names()
    for n in names:
        f.delete(n)
    return len(names)


def coalesce_events(events: DataFrame, group: list[str], path: str, keep: int = 1000, burst: int = 100) -> DataFrame:
    """(group, path, events, burst, dropped): events counted per path, the first `keep` paths by name, and whether that was a burst."""
    n = events.groupBy(*group, path).agg(F.count(F.lit(1)).alias("events"))
    w = Window.partitionBy(*group)
    total = n.groupBy(*group).agg(F.count(F.lit(1)).alias("paths"))
    first = n.withColumn("_r", F.row_number().over(w.orderBy(path))).where(F.col("_r") <= keep).drop("_r")
    j = first.join(total, group)
    dropped = F.greatest(F.col("paths") - keep, F.lit(0))
    return j.select(*group, path, "events", ((F.col("paths") >= burst) | (dropped > 0)).alias("burst"), dropped.alias("dropped"))


def dirty_state(events: DataFrame, path: str, at: str) -> DataFrame:
    """(path, first_seen, last_seen, events): what is known of each dirty path."""
    return events.groupBy(path).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("events"))


def merge_state(old: DataFrame, new: DataFrame, path: str) -> DataFrame:
    return old.unionByName(new).groupBy(path).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("events").alias("events"))


def quiet_batch(state: DataFrame, path: str, now: Column, quiet: str = "1 day", most: int = 1000) -> DataFrame:
    """The first paths by name that have been quiet for a while."""
    return state.where(F.col("last_seen") < now - F.expr(f"INTERVAL {quiet}")).orderBy(path).limit(most)


def retry_counts(outcomes: DataFrame, path: str, at: str, failed: Column) -> DataFrame:
    """(path, ok, attempts): whether a path succeeded, and its failures since the last success."""
    good = outcomes.where(~failed).groupBy(path).agg(F.max(at).alias("_ok"))
    j = outcomes.join(good, path, "left")
    since = failed & (F.col("_ok").isNull() | (F.col(at) > F.col("_ok")))
    return j.groupBy(path).agg(F.max(F.col("_ok").isNotNull()).alias("ok"), F.count_if(since).alias("attempts"))


def merge_retries(old: DataFrame, new: DataFrame, path: str) -> DataFrame:
    """Counts of a later batch on top of earlier ones: a success starts the count anew."""
    o = old.select(path, F.col("ok").alias("_o"), F.col("attempts").alias("_a"))
    j = o.join(new, path, "full")
    attempts = F.when(F.col("ok"), F.col("attempts")).otherwise(F.coalesce("_a", F.lit(0)) + F.coalesce("attempts", F.lit(0)))
    return j.select(path, (F.coalesce("ok", F.lit(False)) | F.coalesce("_o", F.lit(False))).alias("ok"), attempts.alias("attempts"))


def retry_state(counts: DataFrame, path: str, most: int = 5, base_ms: int = 750, cap_ms: int = 30_000) -> DataFrame:
    """(path, attempts, status, delay_ms) of failing paths: dead after `most`, else with the delay of the next try."""
    n = counts.where("attempts > 0").select(path, F.col("attempts").cast("int").alias("attempts"))
    delay = F.least(F.lit(float(cap_ms)), base_ms * F.pow(F.lit(2.0), F.least(F.col("attempts") - 1, F.lit(30)))).cast("long")
    dead = F.col("attempts") >= most
    return n.select(path, "attempts", F.when(dead, "dead_letter").otherwise("pending").alias("status"), F.when(~dead, delay).alias("delay_ms"))


def tumbling(events: DataFrame, at: str, size: str, late: str | None = None, *keys: str) -> DataFrame:
    e = events.withWatermark(at, late) if late else events
    return e.groupBy(F.window(at, size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), *keys, "events", "value")


def sliding(events: DataFrame, at: str, size: str, step: str, late: str | None = None) -> DataFrame:
    e = events.withWatermark(at, late) if late else events
    return e.groupBy(F.window(at, size, step).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), "events")


def sessions(events: DataFrame, at: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    e = events.withWatermark(at, late) if late else events
    return e.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def run_available(stream: DataFrame, fold, merge, name: str, root: str | None = None) -> DataFrame:
    """Drive a stream through what is there now; `fold` turns a batch into state rows, `merge` joins them to the old ones.

    The state lies under `root`, a folder per batch, and goes on from the last finished one when the stream is started again
    with the same root. A batch that is delivered again after a failure overwrites its own folder, so that it counts
    once. Without a root the run stands alone, in the shared checkpoint folder.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = root or f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{name}-{uuid.uuid4().hex}"
    states = Folder(spark, f"{base}/state")

    def finished(before: int | None = None) -> list[int]:
        return sorted(int(n) for n in states.names() if n.isdigit() and (before is None or int(n) < before) and states.exists(f"{n}/_SUCCESS"))

    def step(batch: DataFrame, batch_id: int) -> None:
        new, past = fold(batch), finished(batch_id)
        out = merge(spark.read.parquet(f"{base}/state/{past[-1]}"), new) if past else new
        out.write.mode("overwrite").parquet(f"{base}/state/{batch_id}")
        for old in past[:-2]:
            states.delete(str(old))

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    done = finished()
    return spark.read.parquet(f"{base}/state/{done[-1]}") if done else fold(spark.createDataFrame([], stream.schema))


def restarting(start, failed, attempts: int = 5, base_s: float = 0.75, cap_s: float = 30.0):
    """Run `start()` until it succeeds, waiting twice as long after each failure, up to the cap; the last error is raised.

    `failed(n, error)` is told of every failure.
    """
    for n in range(1, attempts + 1):
        try:
            return start()
        except Exception as e:
            failed(n, e)
            if n == attempts:
                raise
            time.sleep(min(cap_s, base_s * 2 ** (n - 1)))
    return None
