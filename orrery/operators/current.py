"""Current state of versioned rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], version: str, columns: list[str]) -> DataFrame:
    """For each key, `columns` of the row with the highest `version`.

    One hash aggregation with map-side combine, so that a hot key costs one row per map task rather than a
    sorted window. Ties in `version` go to the greatest tuple of `columns` (nulls lowest), which makes repeated
    rows harmless and the result independent of row order. A null version ranks below every other.
    """
    best = F.max(F.struct(F.col(version), *[F.col(c) for c in columns])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in columns])


def living(symbols: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Keys whose row of the highest generation is not deleted.

    On a tie in generation a deletion wins, since a tombstone is written after the row it closes.
    """
    keys = keys or ["project_id", "id"]
    state: Column = F.max(F.struct("generation", F.col("deleted_at").isNotNull().alias("_gone"))).alias("_s")
    return symbols.groupBy(*keys).agg(state).where(~F.col("_s._gone")).select(*keys)
