"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.splitting import split_items
from orrery.operators.current import latest
from orrery.session import table


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every living symbol that is larger than its project's limit."""
    now = latest(
        table(spark, d, "symbols").select("project_id", "id", "generation", F.col("deleted_at").isNotNull().alias("gone"), "kind", "file_path", "start_line", "end_line"),
        ["project_id", "id"], "generation", ["gone", "kind", "file_path", "start_line", "end_line"],
    )
    options = table(spark, d, "chunk_options").select("project_id", "target_lines", "overlap_lines")
    items = now.where(~F.col("gone") & ~F.col("kind").eqNullSafe("file")).join(options, "project_id", "left")
    items = items.select(F.col("project_id").alias("scope"), "id", F.translate("file_path", "\\", "/").alias("path"), "start_line", "end_line", F.col("target_lines").alias("limit"), F.col("overlap_lines").alias("overlap"))
    texts = table(spark, d, "fixture_files").select(F.col("repo").alias("scope"), F.translate("path", "\\", "/").alias("path"), "content")
    return split_items(items, texts).withColumnRenamed("scope", "project_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """(project_id, id) of the symbols that were cut."""
    return p5_pieces(spark, d).select("project_id", "id").distinct()


def p5_invariants(spark: SparkSession, d: str) -> DataFrame:
    """One row: items cut, and how many of their pieces exceed the limit, leave a gap, or share other than the overlap asked for."""
    options = table(spark, d, "chunk_options").select("project_id", F.greatest(F.coalesce("target_lines", F.lit(80)), F.lit(1)).alias("most"), F.greatest(F.coalesce("overlap_lines", F.lit(0)), F.lit(0)).alias("shared"))
    p = p5_pieces(spark, d).join(options, "project_id", "left").fillna({"most": 80, "shared": 0})
    before = F.lag("last_line").over(Window.partitionBy("project_id", "id").orderBy("piece"))
    later = F.col("piece") > 0
    p = p.withColumn("before", before)
    return p.agg(
        F.countDistinct("project_id", "id").alias("items"), F.count_if((F.col("last_line") - F.col("first_line") + 1 > F.col("most")) & (F.col("boundary") != "unlocated")).alias("too_long"),
        F.count_if(later & (F.col("first_line") != F.col("before") - F.col("overlap") + 1)).alias("gaps"), F.count_if(later & (F.col("overlap") != F.least("shared", F.col("most") - 1))).alias("other_overlap"),
    )


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces, "p5_invariants": p5_invariants}
ORACLE = {
    "p5_found": """
WITH s AS (SELECT *, max(generation) OVER (PARTITION BY project_id, id) AS g FROM symbols)
SELECT DISTINCT s.project_id, s.id FROM s LEFT JOIN chunk_options o USING (project_id)
WHERE s.generation = s.g AND s.deleted_at IS NULL AND s.kind <> 'file'
  AND s.end_line - s.start_line + 1 > coalesce(o.target_lines, 80)
""",
}
ORACLE["p5_invariants"] = "SELECT count(*) AS items, 0::BIGINT AS too_long, 0::BIGINT AS gaps, 0::BIGINT AS other_overlap FROM (" + ORACLE["p5_found"] + ")"
