"""The engine's relations over the stored tables: current, living, without repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.paths import slashes
from orrery.operators.current import latest
from orrery.session import table

SYMBOL_COLUMNS = ["file_path", "name", "kind", "language", "start_line", "end_line", "signature", "exported"]
FILE_COLUMNS = ["language", "size_bytes", "content_hash", "modified_at_ms", "indexed_at_ms", "status", "role", "absolute_path"]
CHUNK_COLUMNS = ["project_id", "file_path", "language", "kind", "symbol_name", "start_line", "end_line", "content", "content_hash"]
EDGE_COLUMNS = ["project_id", "source_id", "target_id", "kind", "source_file", "target_file", "target_name", "framework", "resolution", "line", "file_path"]


def symbols(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Living symbols, each in its state of the highest generation; with the columns named, or all."""
    s = table(spark, d, "symbols").withColumn("gone", F.col("deleted_at").isNotNull())
    return latest(s, ["project_id", "id"], "generation", ["gone", *(columns or SYMBOL_COLUMNS)]).where("NOT gone").drop("gone")


def files(spark: SparkSession, d: str) -> DataFrame:
    """Files in their state of the highest generation, paths with forward slashes."""
    f = table(spark, d, "files").withColumn("path", slashes(F.col("path")))
    return latest(f, ["project_id", "path"], "generation", FILE_COLUMNS)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges once each; the same edge delivered again keeps its first edge_seq."""
    return table(spark, d, "edges").groupBy(*EDGE_COLUMNS).agg(F.min("edge_seq").alias("edge_seq"))


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Chunks in their state of the highest generation. Name the columns that are needed: the state is one aggregate, through which unused ones can't be pruned."""
    return latest(table(spark, d, "semantic_chunks"), ["id"], "generation", list(columns) or CHUNK_COLUMNS)


def texts(spark: SparkSession, d: str) -> DataFrame:
    """(project_id, path, content), one text per path."""
    t = table(spark, d, "fixture_files").select(F.col("repo").alias("project_id"), slashes(F.col("path")).alias("path"), "content")
    return t.groupBy("project_id", "path").agg(F.max("content").alias("content"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks: id, path, language, content."""
    t = table(spark, d, "documents")
    return t.select("doc_id", F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("file_path"), F.col("lang").alias("language"), F.col("text").alias("content"))


def _latest_sql(source: str, keys: list[str], version: str, columns: list[str]) -> str:
    order = ", ".join(f"{c} DESC NULLS LAST" for c in [version, *columns])
    return f"SELECT {', '.join([*keys, *columns])} FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {order}) AS _r FROM {source}) WHERE _r = 1"


#: The same relations as SQL, for the tests.
SQL = {
    "sym": f"sym AS (SELECT * EXCLUDE (gone) FROM ({_latest_sql('(SELECT *, deleted_at IS NOT NULL AS gone FROM symbols)', ['project_id', 'id'], 'generation', ['gone', *SYMBOL_COLUMNS])}) WHERE NOT gone)",
    "fil": f"fil AS ({_latest_sql('(SELECT * REPLACE (replace(path, chr(92), chr(47)) AS path) FROM files)', ['project_id', 'path'], 'generation', FILE_COLUMNS)})",
    "edg": f"edg AS (SELECT {', '.join(EDGE_COLUMNS)}, min(edge_seq) AS edge_seq FROM edges GROUP BY ALL)",
    "chk": f"chk AS ({_latest_sql('semantic_chunks', ['id'], 'generation', CHUNK_COLUMNS)})",
    "vec": f"vec AS ({_latest_sql('semantic_chunks', ['id'], 'generation', [*CHUNK_COLUMNS, 'embedding'])})",
    "txt": "txt AS (SELECT repo AS project_id, replace(path, chr(92), chr(47)) AS path, max(content) AS content FROM fixture_files GROUP BY ALL)",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
