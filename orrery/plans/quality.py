"""Evaluation and topology queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.operators import evaluation as Q
from orrery.plans.streams import _sources
from orrery.session import table
from orrery.sources import tables as T
from orrery.sources.tables import with_
from orrery.sources.topology import link_calls, routes, topology_facts


def a21_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Do chunks of equal content hash to their first id? Each chunk is a query, its file the list by line, the chunk of its own symbol the judgement."""
    c = T.chunks(spark, d, "project_id", "file_path", "kind", "start_line")
    lists = c.select(F.concat_ws("|", "project_id", "file_path").alias("query"), F.col("id").alias("item"), F.row_number().over(Window.partitionBy("project_id", "file_path").orderBy("start_line", "id")).alias("rank"))
    want = c.where("kind = 'function'").select(F.concat_ws("|", "project_id", "file_path").alias("query"), F.col("id").alias("item"))
    s = Q.summary(Q.ranks(lists, want), 3)
    return s.select("queries", *[F.round(x, 6).alias(x) for x in ("hit_rate", "mrr", "recall")])


def a22_gate(spark: SparkSession, d: str) -> DataFrame:
    g = Q.gate(a21_evaluation(spark, d), {"hit_rate": (">=", 0.9), "mrr": (">=", 0.5), "queries": (">=", 1)})
    return g.select("metric", "passed")


def e08_topology(spark: SparkSession, d: str) -> DataFrame:
    """Routes, calls, events and data access in all script texts, counted."""
    return topology_facts(_sources(spark, d)).groupBy("project_id", "fact", "target").agg(F.count(F.lit(1)).alias("n"))


def e08_linked_calls(spark: SparkSession, d: str) -> DataFrame:
    s = _sources(spark, d)
    f = topology_facts(s)
    return link_calls(f, routes(f, s))


def w15_graph_export(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot of at most 400 symbols of a language, as JSON, with the edges among them."""
    n = T.symbols(spark, d).where("language = 'python' AND kind <> 'file'").select("project_id", "id", "name", "kind", "file_path").orderBy("project_id", "id").limit(400)
    e = T.edges(spark, d).select("project_id", "edge_seq", "source_id", "target_id", "kind")
    for side in ("source_id", "target_id"):
        e = e.join(n.select("project_id", F.col("id").alias(side)), ["project_id", side], "left_semi")
    nodes = n.select(F.lit("node").alias("type"), F.to_json(F.struct("id", "name", "kind", "file_path")).alias("json"))
    return nodes.union(e.select(F.lit("edge"), F.to_json(F.struct("edge_seq", "kind"))))


def w12_progress_tail(spark: SparkSession, d: str) -> DataFrame:
    """The tail of the progress log of a run over the tables: a current state and one entry per phase, in order."""
    import uuid

    from orrery.session import ensure_checkpoint_dir
    from orrery.streaming.watcher import progress, progress_tail, record_progress

    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/progress-{uuid.uuid4().hex}"
    files = T.files(spark, d)
    done = [("scan", files.count()), ("skip", table(spark, d, "skipped_files").distinct().count()), ("symbols", T.symbols(spark, d, "kind").count()), ("edges", T.edges(spark, d).count())]
    for i, (phase, n) in enumerate(done):
        record_progress(spark, root, {"phase": phase, "done": n, "total": n}, at=i)
    return progress_tail(spark, root, 3).withColumn("current", F.col("n") == F.lit(progress(spark, root)["at_ms"] + 1)).select("n", "phase", "done", "current")


def a17_project_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Files of each project, and how often its index was warned of."""
    f = T.files(spark, d).groupBy("project_id").agg(F.count(F.lit(1)).alias("files"))
    w = table(spark, d, "analysis_warnings").distinct().groupBy("project_id").agg(F.sum("occurrences").alias("warnings"))
    return f.join(w, "project_id", "left").fillna(0, ["warnings"])


QUERIES = {k: v for k, v in list(globals().items()) if re.match(r"[anew]\d\d_", k)}
_EVAL = "q AS (SELECT project_id || '|' || file_path AS query, id, kind, row_number() OVER (PARTITION BY project_id, file_path ORDER BY start_line, id) AS r FROM chk), s AS (SELECT query, min(r) AS first, avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0 END) AS recall FROM q WHERE kind = 'function' GROUP BY 1), f AS (SELECT count(*) AS queries, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(avg(1.0 / first), 6) AS mrr, round(avg(recall), 6) AS recall FROM s)"
ORACLE = {
    "a21_evaluation": with_("chk") + f", {_EVAL} SELECT queries, hit_rate::DOUBLE AS hit_rate, mrr::DOUBLE AS mrr, recall::DOUBLE AS recall FROM f",
    "a22_gate": with_("chk") + f", {_EVAL} SELECT 'hit_rate' AS metric, hit_rate >= 0.9 AS passed FROM f UNION ALL SELECT 'mrr', mrr >= 0.5 FROM f UNION ALL SELECT 'queries', queries >= 1 FROM f",
    "w12_progress_tail": with_("fil", "sym", "edg") + " SELECT n, phase, done, n = 4 AS current FROM (SELECT 2::BIGINT AS n, 'skip' AS phase, count(*) AS done FROM (SELECT DISTINCT * FROM skipped_files) UNION ALL SELECT 3, 'symbols', count(*) FROM sym UNION ALL SELECT 4, 'edges', count(*) FROM edg)",
    "w15_graph_export": with_("sym", "edg") + """, n AS (SELECT project_id, id, name, kind, file_path FROM sym WHERE language = 'python' AND kind <> 'file' ORDER BY project_id, id LIMIT 400)
SELECT 'node' AS type, '{' || concat_ws(',', '"id":' || to_json(id)::VARCHAR, '"name":' || to_json(name)::VARCHAR, '"kind":' || to_json(kind)::VARCHAR, '"file_path":' || to_json(file_path)::VARCHAR) || '}' AS json FROM n
UNION ALL SELECT 'edge', '{' || concat_ws(',', '"edge_seq":' || edge_seq, '"kind":' || to_json(kind)::VARCHAR) || '}' FROM edg e WHERE EXISTS (SELECT 1 FROM n WHERE n.project_id = e.project_id AND n.id = e.source_id) AND EXISTS (SELECT 1 FROM n WHERE n.project_id = e.project_id AND n.id = e.target_id)""",
    "a17_project_warnings": with_("fil") + " SELECT f.project_id, files, coalesce(warnings, 0) AS warnings FROM (SELECT project_id, count(*) AS files FROM fil GROUP BY 1) f LEFT JOIN (SELECT project_id, sum(occurrences)::BIGINT AS warnings FROM (SELECT DISTINCT * FROM analysis_warnings) GROUP BY 1) w USING (project_id)",
}
