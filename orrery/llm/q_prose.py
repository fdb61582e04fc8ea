"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.prose import quality
from orrery.session import table


def p9_quality(spark: SparkSession, d: str) -> DataFrame:
    """Statistics and the nearest structural profile of every document."""
    return quality(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id) of the documents more than half of whose characters are in no prose block."""
    return p9_quality(spark, d).where("prose_share < 0.5").select("doc_id").distinct()


def p9_counts(spark: SparkSession, d: str) -> DataFrame:
    """The plain counts among the statistics."""
    q = p9_quality(spark, d)
    return q.select("doc_id", "chars", "words", F.round("mean_word_length", 6).alias("mean_word_length"), "lines", "punctuated_lines", F.round("punctuated_share", 6).alias("punctuated_share"))


QUERIES = {"p9_found": p9_found, "p9_quality": p9_quality, "p9_counts": p9_counts}
ORACLE = {
    "p9_counts": r"""
WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s+$', '')), lambda x: x <> '') AS ls,
    list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: regexp_matches(x, '^[^\p{Nd}]')) AS ws
  FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, length(text)::BIGINT AS chars, len(ws)::BIGINT AS words, list_sum(list_transform(ws, lambda x: length(x))) AS letters, len(ls)::BIGINT AS lines, len(list_filter(ls, lambda x: regexp_matches(x, '[.!?:;…]$')))::BIGINT AS punctuated_lines FROM l)
SELECT doc_id, chars, words, round(letters / nullif(words, 0), 6) AS mean_word_length, lines, punctuated_lines, round(punctuated_lines / nullif(lines, 0), 6) AS punctuated_share FROM n
"""
}
