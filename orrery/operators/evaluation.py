"""Measures of retrieval quality over result lists and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranks(results: DataFrame, expected: DataFrame, key: str = "query") -> DataFrame:
    """(query, item, rank): the best rank of each expected item; null where it is missing.

    `results` is (query, item, rank), `expected` is (query, item).
    """
    best = results.groupBy(key, "item").agg(F.min("rank").alias("rank"))
    return expected.select(key, "item").distinct().join(best, [key, "item"], "left")


def summary(ranked: DataFrame, k: int = 10, key: str = "query") -> DataFrame:
    """One row: queries, share with an expected item within k, mean reciprocal rank, recall within k."""
    q = ranked.groupBy(key).agg(F.min("rank").alias("first"), F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias("recall"))
    return q.agg(F.count(F.lit(1)).alias("queries"), F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)).alias("hit_rate"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg("recall").alias("recall"))


def gate(found: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """(metric, value, limit, passed) of a one-row table of figures against limits such as ('>=', 0.9)."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(op).alias("op"), F.lit(float(v)).alias("limit")) for m, (op, v) in limits.items()])
    x = found.select(F.explode(rows).alias("x")).select("x.*")
    ok = F.when(F.col("op") == ">=", F.col("value") >= F.col("limit")).when(F.col("op") == "<=", F.col("value") <= F.col("limit")).otherwise(F.col("value") == F.col("limit"))
    return x.select("metric", "value", "op", "limit", ok.alias("passed"))
