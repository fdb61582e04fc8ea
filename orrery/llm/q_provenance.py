"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm.provenance import classify_files, hints
from orrery.session import cut, table


def p6_files(spark: SparkSession, d: str) -> DataFrame:
    """The class of every source file."""
    return classify_files(table(spark, d, "fixture_files"), table(spark, d, "projects"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """(repo, path) of the well-formed files that were not written by hand for their project."""
    return p6_files(spark, d).where("reason IS NOT NULL AND well_formed").select("repo", "path")


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """Files by class, beside the hints of the index."""
    return hints(cut(p6_files(spark, d)), table(spark, d, "files"), table(spark, d, "skipped_files"))


QUERIES = {"p6_found": p6_found, "p6_files": p6_files, "p6_classes": p6_classes}
ORACLE: dict = {}
