"""References to records that do not exist.

Distinct non-null foreign keys are anti-joined against the parent keys, and only the orphans that remain are
joined back to the referring rows. Aggregation precedes every exchange: a key that a third of the rows share is
one row by the time it is shuffled for the anti-join. Joining back, the orphan side is unique by key, so that
adaptive execution can split a hot key of the referring side without changing the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot_refs(child: DataFrame, scope: str, fields: list[str], keep: list[str]) -> DataFrame:
    """(scope, ref_field, ref_id, *keep): one row for each non-null reference. Empty strings are references."""
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in fields])
    return (
        child.select(F.col(scope).alias("scope"), *[F.col(k) for k in keep], F.explode(pairs).alias("_r"))
        .select("scope", F.col("_r.f").alias("ref_field"), F.col("_r.v").alias("ref_id"), *keep)
        .where(F.col("ref_id").isNotNull())
    )


def orphan_keys(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct (scope, ref_id) of `refs` that `parents`(scope, ref_id) lacks. A null scope matches nothing, hence is an orphan."""
    return refs.select("scope", "ref_id").distinct().join(parents, ["scope", "ref_id"], "left_anti")


def orphan_rows(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of `refs` whose key is an orphan, distinct.

    Null references are none; empty tables give an empty result (no parents: every reference is an orphan);
    repeated rows count once; further columns of the parents are ignored.
    """
    keys = orphan_keys(refs, parents).select(F.col("scope").alias("_s"), F.col("ref_id").alias("_k"))
    return refs.join(keys, F.col("scope").eqNullSafe(F.col("_s")) & (F.col("ref_id") == F.col("_k")), "inner").drop("_s", "_k").distinct()


def orphan_report(refs: DataFrame, parents: DataFrame, history: DataFrame, table_name: str, at: str, period: str = "month") -> DataFrame:
    """Counts per table, field and period of `at`, with the kinds of missing parent told apart.

    `history` is (scope, ref_id, first_seen_at): every key that the parent table ever had, and when it was first
    seen. A reference is `never_seen` if its key isn't there at all, `deleted` if it is there but not living,
    `arrived_later` if it is living but was first seen after the reference was written, and `resolved` otherwise (a null
    time or first sight is no later one). The distinct keys are anti-joined against the parents; the references, counted by key
    and period before they are exchanged, meet only the orphans among the keys and those that arrived after their first
    reference. All other references are counted without being joined.
    """
    when = F.date_trunc(period, F.col(at)).alias("period")
    keys = refs.groupBy("scope", "ref_id").agg(F.min(at).alias("_from"))
    live = parents.select("scope", "ref_id").distinct()
    seen = history.groupBy("scope", "ref_id").agg(F.min("first_seen_at").alias("_seen"), F.lit(True).alias("_known"))
    missing = keys.join(live, ["scope", "ref_id"], "left_anti").join(seen, ["scope", "ref_id"], "left")
    missing = missing.select(F.col("scope").alias("_s"), F.col("ref_id").alias("_k"), F.when(F.col("_known"), "deleted").otherwise("never_seen").alias("_kind"))
    late = keys.join(live, ["scope", "ref_id"]).join(seen, ["scope", "ref_id"]).where(F.col("_seen") > F.col("_from"))
    late = late.select(F.col("scope").alias("_s"), F.col("ref_id").alias("_k"), "_seen")
    same = F.col("scope").eqNullSafe(F.col("_s")) & (F.col("ref_id") == F.col("_k"))

    counted = refs.groupBy("scope", "ref_field", "ref_id", when).agg(F.count(F.lit(1)).alias("_n"))
    gone = counted.join(missing, same).groupBy("ref_field", "period", "_kind").agg(F.sum("_n").alias("_n"))
    early = refs.join(late, same).where(F.col("_seen") > F.col(at)).groupBy("ref_field", when).agg(F.count(F.lit(1)).alias("_n"))
    total = refs.groupBy("ref_field", when).agg(F.count(F.lit(1)).alias("_n"))
    rows = total.select("ref_field", "period", F.lit("refs").alias("_kind"), "_n").unionByName(gone).unionByName(early.select("ref_field", "period", F.lit("arrived_later").alias("_kind"), "_n"))
    of = lambda k: F.sum(F.when(F.col("_kind") == k, F.col("_n")).otherwise(0))
    return rows.groupBy(F.lit(table_name).alias("table_name"), "ref_field", "period").agg(
        of("refs").alias("refs"), of("never_seen").alias("never_seen"), of("deleted").alias("deleted"), of("arrived_later").alias("arrived_later"),
        (of("refs") - of("never_seen") - of("deleted") - of("arrived_later")).alias("resolved"),
    )
