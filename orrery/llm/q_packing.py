"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.packing import RANKS, pack, token_counts
from orrery.session import table

CAPACITY = 2048


def p7_containers(spark: SparkSession, d: str, ranks_path: str = RANKS) -> DataFrame:
    """Container, place and length of every document, in tokens."""
    return pack(token_counts(table(spark, d, "documents"), ranks_path), CAPACITY)


def p7_fill(spark: SparkSession, d: str, ranks_path: str = RANKS) -> DataFrame:
    """Per bucket: containers, tokens, and the share of room used by its batches alone and after they were topped up."""
    c = p7_containers(spark, d, ranks_path).groupBy("bucket").agg(F.max("container").alias("last"), F.min("container").alias("first"), F.sum("length").alias("tokens"), F.sum(F.when(F.col("topped"), 0).otherwise(F.col("length"))).alias("own"))
    n = F.col("last") - F.col("first") + 1  # a bucket's containers are numbered in one run
    return c.select("bucket", n.alias("containers"), "tokens", (F.col("own") / (n * CAPACITY)).alias("batched"), (F.col("tokens") / (n * CAPACITY)).alias("filled"))


def p7_invariants(spark: SparkSession, d: str, ranks_path: str = RANKS) -> DataFrame:
    """One row: documents placed, and how many break a rule: tokens not placed just once, rooms overlapping or left open between items, containers too full, texts split that would fit."""
    counts = token_counts(table(spark, d, "documents"), ranks_path)
    c = pack(counts, CAPACITY)
    placed = c.groupBy("doc_id").agg(F.sum("length").alias("n"), F.count(F.lit(1)).alias("parts"), F.max("part").alias("last"))
    docs = counts.where("tokens > 0").join(placed, "doc_id", "full").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(~F.col("n").eqNullSafe(F.col("tokens")) | (F.col("parts") != F.col("last") + 1)).alias("misplaced"),
        F.count_if((F.col("tokens") <= CAPACITY) & (F.col("parts") > 1)).alias("split"),
    )
    # a container's places are 0 and the sums of what lies before: then the sum of places fits the lengths in order
    rooms = c.groupBy("container").agg(F.sum("length").alias("used"), F.array_sort(F.collect_list(F.struct("place", "length"))).alias("x"))  # at most CAPACITY items
    gaps = F.exists(F.zip_with("x", F.slice("x", 2, CAPACITY), lambda a, b: b.isNotNull() & (a["place"] + a["length"] != b["place"])), lambda g: g)
    held = rooms.agg(F.count_if(F.col("used") > CAPACITY).alias("overfull"), F.count_if(gaps | (F.col("x")[0]["place"] != 0)).alias("gaps"))
    return docs.crossJoin(held).select("documents", "misplaced", "split", "overfull", "gaps")  # one row each


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill, "p7_invariants": p7_invariants}
ORACLE = {"p7_invariants": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS misplaced, 0::BIGINT AS split, 0::BIGINT AS overfull, 0::BIGINT AS gaps FROM documents WHERE text <> ''"}
