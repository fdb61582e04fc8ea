"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.neighbours import nearest
from orrery.session import table


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """(id, neighbour, similarity) of every current chunk."""
    chunks = table(spark, d, "semantic_chunks").select("id", "generation", "embedding")
    return nearest(chunks, version="generation")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b, where at least one is a neighbour of the other."""
    return p1_neighbours(spark, d).select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours}
_NEAR = """
WITH cur AS (
  SELECT id, max(embedding) AS e FROM (
    SELECT id, embedding, generation, max(generation) OVER (PARTITION BY id) AS g FROM semantic_chunks
  ) WHERE generation = g GROUP BY id
), ok AS (
  SELECT id, e::DOUBLE[64] AS v FROM cur
  WHERE e IS NOT NULL AND len(e) = 64 AND len(list_filter(e, lambda x: x <> 0)) > 0
), s AS (
  SELECT a.id AS a, b.id AS b, round(array_cosine_similarity(a.v, b.v), 4) AS sim
  FROM ok a JOIN ok b ON a.id <> b.id
), n AS (
  SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM s WHERE sim >= 0.86
)
"""
ORACLE = {
    "p1_found": _NEAR + "SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM n WHERE r <= 5",
    "p1_neighbours": _NEAR + "SELECT a AS id, b AS neighbour, sim AS similarity FROM n WHERE r <= 5",
}
