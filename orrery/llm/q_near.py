"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.metric_join import classes, expand, groups, pooled, similar_pairs
from orrery.session import cut, table

THRESHOLD = 0.7
CALLEES = 8


def _records(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbol_structures").select("symbol_id", "body_fingerprint", "signature_tokens", "callees")
    s = s.where(F.size(pooled(F.col("callees"))) >= CALLEES)
    return s.select(F.col("symbol_id").alias("id"), pooled(F.col("callees"), F.col("signature_tokens"), F.array("body_fingerprint")).alias("vals"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """(symbol_id_a, symbol_id_b) of all pairs within the threshold."""
    reps, members = classes(_records(spark, d))
    return expand(similar_pairs(reps, THRESHOLD), members).select(F.col("id_a").alias("symbol_id_a"), F.col("id_b").alias("symbol_id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """(symbol_id, class_id, links) of every symbol that takes part."""
    reps, members = classes(_records(spark, d))
    return groups(cut(similar_pairs(reps, THRESHOLD)), members).withColumnRenamed("id", "symbol_id")


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
ORACLE = {
    "p3_found": """
WITH s AS (
  SELECT symbol_id, min(list_distinct(list_filter(list_concat(callees, coalesce(signature_tokens, []), [body_fingerprint]), lambda x: x IS NOT NULL))) AS v
  FROM symbol_structures WHERE len(list_distinct(callees)) >= 8 GROUP BY symbol_id
), p AS (
  SELECT a.symbol_id AS symbol_id_a, b.symbol_id AS symbol_id_b, len(list_intersect(a.v, b.v)) AS n, len(a.v) + len(b.v) AS m
  FROM s a JOIN s b ON a.symbol_id < b.symbol_id AND len(a.v) >= 0.69 * len(b.v) AND len(b.v) >= 0.69 * len(a.v)
)
SELECT symbol_id_a, symbol_id_b FROM p WHERE 10 * n >= 7 * (m - n)
""",
}
ORACLE["p3_groups"] = ORACLE["p3_found"].replace("WITH s AS", "WITH RECURSIVE s AS", 1).replace(
    "SELECT symbol_id_a, symbol_id_b FROM p WHERE 10 * n >= 7 * (m - n)",
    """, l AS (SELECT symbol_id_a AS v, symbol_id_b AS u FROM p WHERE 10 * n >= 7 * (m - n) UNION ALL SELECT symbol_id_b, symbol_id_a FROM p WHERE 10 * n >= 7 * (m - n)),
r AS (SELECT symbol_id AS v, symbol_id AS u FROM s UNION SELECT r.v, l.u FROM r JOIN l ON l.v = r.u)
SELECT c.symbol_id, c.class_id, coalesce(k.links, 0) AS links FROM (SELECT v AS symbol_id, min(u) AS class_id FROM r GROUP BY 1) c LEFT JOIN (SELECT v, count(*) AS links FROM l GROUP BY 1) k ON k.v = c.symbol_id""",
)
