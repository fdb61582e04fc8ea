"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm.leakage import leaks
from orrery.session import table


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Items and the documents that hold a passage of 13 words of them, one edited word allowed."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, item_id) of the leaks that hold 13 or more consecutive words unchanged."""
    return p8_leaks(spark, d).where("run >= 13").select("doc_id", "item_id")


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks}
_WORDS = r"list_filter(regexp_extract_all({}, '[\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
ORACLE = {
    "p8_found": f"""
WITH i AS (SELECT DISTINCT item_id, list_transform({_WORDS.format("text")}, lambda x: lower(x)) AS w FROM eval_items),
ig AS (SELECT DISTINCT item_id, array_to_string(w[p:p+12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS p FROM i)),
d AS (SELECT doc_id, list_transform({_WORDS.format("text")}, lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[p:p+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
""",
}
