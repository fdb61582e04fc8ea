"""Orphan references: nulls, ties, repeats, empty tables, extra columns."""

import datetime as dt

from pyspark.sql import functions as F

from orrery.operators.current import latest, living
from orrery.operators.orphans import orphan_report, orphan_rows, unpivot_refs

T = dt.datetime


def _edges(spark, rows):
    return spark.createDataFrame(rows, "edge_seq long, project_id string, source_id string, target_id string, at timestamp, scope string")


def test_orphans_found_and_counted(spark):
    sym = spark.createDataFrame(
        [("p", "a", 1, None, T(2024, 1, 1)), ("p", "a", 2, None, T(2024, 3, 1)), ("p", "d", 1, None, T(2024, 1, 1)), ("p", "d", 2, T(2024, 2, 1), T(2024, 1, 2)), ("q", "x", 1, None, T(2024, 1, 1)), ("p", "late", 1, None, T(2024, 6, 1))],
        "project_id string, id string, generation long, deleted_at timestamp, indexed_at timestamp",
    )
    edges = _edges(spark, [
        (1, "p", "a", "d", T(2024, 2, 1), "clash"), (1, "p", "a", "d", T(2024, 2, 1), "clash"), (2, "p", None, "x", T(2024, 2, 1), None),
        (3, "p", "", "late", T(2024, 2, 1), None), (4, "q", "x", None, T(2024, 2, 1), None), (5, None, "a", "a", T(2024, 2, 1), None),
    ])
    live = living(sym).select(F.col("project_id").alias("scope"), F.col("id").alias("ref_id"))
    got = {(r[0], r[1]) for r in orphan_rows(unpivot_refs(edges, "project_id", ["source_id", "target_id"], ["edge_seq"]), live).select("edge_seq", "ref_field").collect()}
    assert got == {(1, "target_id"), (2, "target_id"), (3, "source_id"), (5, "source_id"), (5, "target_id")}
    history = sym.groupBy(F.col("project_id").alias("scope"), F.col("id").alias("ref_id")).agg(F.min("indexed_at").alias("first_seen_at"))
    rep = {r["ref_field"]: r.asDict() for r in orphan_report(unpivot_refs(edges, "project_id", ["source_id", "target_id"], ["at"]), live, history, "edges", "at").collect()}
    assert rep["target_id"]["deleted"] == 2 and rep["target_id"]["arrived_later"] == 1 and rep["target_id"]["never_seen"] == 2
    assert rep["source_id"]["resolved"] == 3 and rep["source_id"]["never_seen"] == 2


def test_empty_tables(spark):
    edges = _edges(spark, [])
    live = spark.createDataFrame([], "scope string, ref_id string")
    assert orphan_rows(unpivot_refs(edges, "project_id", ["source_id"], ["edge_seq"]), live).count() == 0
    one = _edges(spark, [(1, "p", "a", None, None, None)])
    assert orphan_rows(unpivot_refs(one, "project_id", ["source_id"], ["edge_seq"]), live).count() == 1


def test_latest_is_order_free(spark):
    d = spark.createDataFrame([("k", 1, "x"), ("k", 2, None), ("k", 2, "y"), ("k", None, "z"), (None, 1, "n")], "k string, v long, c string")
    assert {(r["k"], r["c"]) for r in latest(d, ["k"], "v", ["c"]).collect()} == {("k", "y"), (None, "n")}
