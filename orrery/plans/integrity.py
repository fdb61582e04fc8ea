"""Queries on referential integrity (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.current import living
from orrery.operators.orphans import orphan_report, orphan_rows, unpivot_refs
from orrery.session import table

FIELDS = ["source_id", "target_id"]


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return living(table(spark, d, "symbols")).select(F.col("project_id").alias("scope"), F.col("id").alias("ref_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """(edge_seq, ref_field) of every reference in edges without a living symbol of its project."""
    refs = unpivot_refs(table(spark, d, "edges"), "project_id", FIELDS, ["edge_seq"])
    return orphan_rows(refs, _parents(spark, d)).select("edge_seq", "ref_field")


def p2_orphan_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, field and month; identical deliveries under another edge_seq are counted as delivered."""
    refs = unpivot_refs(table(spark, d, "edges"), "project_id", FIELDS, ["indexed_at"])
    history = (
        table(spark, d, "symbols")
        .groupBy(F.col("project_id").alias("scope"), F.col("id").alias("ref_id"))
        .agg(F.min("indexed_at").alias("first_seen_at"))
    )
    return orphan_report(refs, _parents(spark, d), history, "edges", "indexed_at")


QUERIES = {"p2_found": p2_found, "p2_orphan_report": p2_orphan_report}

_LIVE = """
WITH state AS (
  SELECT project_id, id, max(generation) AS g FROM symbols GROUP BY ALL
), live AS (
  SELECT s.project_id, s.id FROM symbols s JOIN state t
    ON s.project_id = t.project_id AND s.id = t.id AND s.generation = t.g
  GROUP BY ALL HAVING bool_and(s.deleted_at IS NULL)
), refs AS (
  SELECT edge_seq, project_id, 'source_id' AS ref_field, source_id AS ref_id, indexed_at FROM edges WHERE source_id IS NOT NULL
  UNION ALL
  SELECT edge_seq, project_id, 'target_id', target_id, indexed_at FROM edges WHERE target_id IS NOT NULL
)
"""

ORACLE = {
    "p2_found": _LIVE
    + """
SELECT DISTINCT edge_seq, ref_field FROM refs r
WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.project_id = r.project_id AND l.id = r.ref_id)
""",
    "p2_orphan_report": _LIVE
    + """
, hist AS (SELECT project_id, id, min(indexed_at) AS first_seen_at FROM symbols GROUP BY ALL)
SELECT 'edges' AS table_name, r.ref_field, date_trunc('month', r.indexed_at) AS period,
  count(*) AS refs,
  count(*) FILTER (WHERE h.id IS NULL) AS never_seen,
  count(*) FILTER (WHERE h.id IS NOT NULL AND l.id IS NULL) AS deleted,
  count(*) FILTER (WHERE l.id IS NOT NULL AND h.first_seen_at > r.indexed_at) AS arrived_later,
  count(*) FILTER (WHERE l.id IS NOT NULL AND h.first_seen_at <= r.indexed_at) AS resolved
FROM refs r
LEFT JOIN hist h ON h.project_id = r.project_id AND h.id = r.ref_id
LEFT JOIN live l ON l.project_id = r.project_id AND l.id = r.ref_id
GROUP BY ALL
""",
}
