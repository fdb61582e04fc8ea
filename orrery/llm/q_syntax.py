"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm.syntax import check_files, rates
from orrery.session import cut, table


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    """The finding on every file of a supported language."""
    return check_files(table(spark, d, "fixture_files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """(repo, path) of the files that break the grammar of their extension's language."""
    return p4_files(spark, d).where("NOT well_formed").select("repo", "path")


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates per project and language, beside what the index knew."""
    return rates(cut(p4_files(spark, d)), table(spark, d, "files"), table(spark, d, "analysis_warnings"))


QUERIES = {"p4_found": p4_found, "p4_files": p4_files, "p4_rates": p4_rates}
ORACLE: dict = {}
