"""The event stream: coalescing, dirty state, retries and event-time windows, over the events table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.session import table
from orrery.sources import extract as E
from orrery.sources import tables as T
from orrery.functions.paths import language_of
from orrery.streaming import events as V


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def a18_coalesced_events(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and path (the user), at most 100 paths a day kept."""
    e = _events(spark, d).select(F.to_date("ts").cast("string").alias("day"), F.lpad(F.col("user_id").cast("string"), 8, "0").alias("path"))
    return V.coalesce_events(e, ["day"], "path", keep=100, burst=90)


def a18_event_bursts(spark: SparkSession, d: str) -> DataFrame:
    """The same within the feature's own limits: the first 1,000 paths of a day are kept, and 100 are a burst."""
    e = _events(spark, d).select(F.to_date("ts").cast("string").alias("day"), F.lpad(F.col("user_id").cast("string"), 8, "0").alias("path"))
    return V.coalesce_events(e, ["day"], "path")


def r03_tumbling(spark: SparkSession, d: str) -> DataFrame:
    t = V.tumbling(_events(spark, d), "ts", "1 hour", None, "event_type")
    return t.select("start", "event_type", "events", F.round("value", 4).alias("value"))


def r03_sliding(spark: SparkSession, d: str) -> DataFrame:
    return V.sliding(_events(spark, d), "ts", "2 hours", "30 minutes")


def r02_sessions(spark: SparkSession, d: str) -> DataFrame:
    return V.sessions(_events(spark, d), "ts", "6 hours", "user_id")


def r04_dirty_state(spark: SparkSession, d: str) -> DataFrame:
    return V.dirty_state(_events(spark, d), "user_id", "ts")


def r04_dirty_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same state by a stream over the table's file, batch by batch."""
    s = spark.readStream.schema(_events(spark, d).schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/[e]vents.parquet")  # a glob, since a stream over one plain file is refused
    return V.run_available(s, lambda b: V.dirty_state(b, "user_id", "ts"), lambda a, b: V.merge_state(a, b, "user_id"), "dirty").select("user_id", "first_seen", "last_seen", "events")


def r05_quiet_batch(spark: SparkSession, d: str) -> DataFrame:
    now = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    return V.quiet_batch(V.dirty_state(_events(spark, d), "user_id", "ts"), "user_id", now, "12 hours", 1000)


def r06_retries(spark: SparkSession, d: str) -> DataFrame:
    """Errors as failures, purchases as successes."""
    o = _events(spark, d).where("event_type IN ('error', 'purchase')")
    return V.retry_state(V.retry_counts(o, "user_id", "ts", F.col("event_type") == "error"), "user_id")


def r06_retry_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same by a stream."""
    s = spark.readStream.schema(_events(spark, d).schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/[e]vents.parquet")
    s = s.where("event_type IN ('error', 'purchase')")
    counts = V.run_available(s, lambda b: V.retry_counts(b, "user_id", "ts", F.col("event_type") == "error"), lambda a, b: V.merge_retries(a, b, "user_id"), "retries")
    return V.retry_state(counts, "user_id")


def r01_props(spark: SparkSession, d: str) -> DataFrame:
    """The open bag of an event, read by key."""
    e = _events(spark, d).select(F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"), "value")
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("events"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return T.texts(spark, d).withColumn("language", language_of(F.col("path")))


def e01_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols extracted from all texts."""
    return E.extract_symbols(_sources(spark, d))


def e02_references(spark: SparkSession, d: str) -> DataFrame:
    """Imports and calls of all texts, counted by target."""
    return E.extract_references(_sources(spark, d)).groupBy("project_id", "kind", "target").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {k: v for k, v in list(globals().items()) if re.match(r"[are]\d\d_", k)}

_DIRTY = "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS events FROM events GROUP BY 1"
_RETRY = "WITH ok AS (SELECT user_id, max(ts) AS ok FROM events WHERE event_type = 'purchase' GROUP BY 1), n AS (SELECT e.user_id, count(*)::INT AS attempts FROM events e LEFT JOIN ok USING (user_id) WHERE e.event_type = 'error' AND (ok.ok IS NULL OR e.ts > ok.ok) GROUP BY 1) SELECT user_id, attempts, CASE WHEN attempts >= 5 THEN 'dead_letter' ELSE 'pending' END AS status, CASE WHEN attempts < 5 THEN least(30000, 750 * pow(2, attempts - 1))::BIGINT END AS delay_ms FROM n"
ORACLE = {
    "a18_coalesced_events": "WITH n AS (SELECT strftime(ts, '%Y-%m-%d') AS day, lpad(user_id::VARCHAR, 8, '0') AS path, count(*) AS events FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY path) AS r, count(*) OVER (PARTITION BY day) AS paths FROM n) SELECT day, path, events, paths >= 90 OR paths > 100 AS burst, greatest(paths - 100, 0) AS dropped FROM r WHERE r <= 100",
    "a18_event_bursts": "WITH n AS (SELECT strftime(ts, '%Y-%m-%d') AS day, lpad(user_id::VARCHAR, 8, '0') AS path, count(*) AS events FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY path) AS r, count(*) OVER (PARTITION BY day) AS paths FROM n) SELECT day, path, events, paths >= 100 OR paths > 1000 AS burst, greatest(paths - 1000, 0) AS dropped FROM r WHERE r <= 1000",
    "r03_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "r03_sliding": "SELECT start, count(*) AS events FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS start FROM events, range(4) t(k)) GROUP BY 1",
    "r02_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS events FROM s GROUP BY user_id, k",
    "r04_dirty_state": _DIRTY,
    "r04_dirty_stream": _DIRTY,
    "r05_quiet_batch": f"SELECT * FROM ({_DIRTY}) WHERE last_seen < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 12 HOUR ORDER BY user_id LIMIT 1000",
    "r06_retries": _RETRY,
    "r06_retry_stream": _RETRY,
    "r01_props": "SELECT json_extract(props, '$.k')::INT AS k, count(*) AS events FROM events GROUP BY 1",
}
