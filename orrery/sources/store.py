"""The versioned store: immutable files of each table, and numbered manifests that say which are current.

A commit writes new files beside the old ones and then publishes the next manifest by a rename to a name that no file has
had, so that readers see either all of it or nothing, a writer that dies leaves no trace but unused files, and of two
writers at once the second is refused. Tables of files' rows are kept in buckets by project and file: a commit
rewrites the buckets of touched files and refers to the others as they are. Files that none of the last few manifests
names are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrery.sources.fs import Folder, Log

#: The column that holds the file of a row, by table.
FILE_COLUMN = {"files": "path", "symbols": "file_path", "edges": "source_file", "chunks": "file_path", "semantic_chunks": "file_path"}
#: Buckets of a table of files' rows; a parameter of the store, fixed once it is written.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has published the same generation."""


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, keep: int = 5):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.folder = Folder(spark, self.root)
        self._log = Log(self.folder, "manifests", keep)

    def manifest(self) -> dict:
        """The current manifest; a table's parts are lists of folders by bucket, `all` for a table without buckets."""
        last = self._log.last()
        return last[1] if last else {"generation": 0, "tables": {}, "semantic": {}, "buckets": self.buckets}

    def _publish(self, m: dict) -> None:
        if not self._log.put(m["generation"], m):
            raise Conflict(f"generation {m['generation']} is there already")
        used = {"/".join(p.split("/")[:2]) for n in self._log.numbers() for t in self._log.get(n)["tables"].values() for ps in t["parts"].values() for p in ps}
        for table in m["tables"]:
            for generation in self.folder.names(table):
                number = int(generation.split("=")[1])
                if f"{table}/{generation}" not in used and number < m["generation"]:
                    self.folder.delete(f"{table}/{generation}")

    def _frame(self, entry: dict, parts: list[str]) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in parts])

    def read(self, table: str) -> DataFrame | None:
        entry = self.manifest()["tables"].get(table)
        return self._frame(entry, [p for ps in entry["parts"].values() for p in ps]) if entry else None

    def write(self, tables: dict[str, DataFrame], replaced: dict[str, set[int] | None] | None = None, **semantic) -> int:
        """Write the given tables and publish them together. Returns the generation.

        `replaced` names the buckets that a table's rows stand for (None: all of them); its other buckets stay as they
        are. Tables not named there are written whole and without buckets.
        """
        m = self.manifest()
        g = m["generation"] + 1
        for name, df in tables.items():
            at = f"{name}/generation={g}"
            if replaced is None or name not in replaced:
                df.write.mode("overwrite").parquet(f"{self.root}/{at}")
                m["tables"][name] = {"schema": df.schema.jsonValue(), "parts": {"all": [at]}}
                continue
            keyed = df.withColumn("_bucket", self._bucket("project_id", FILE_COLUMN[name], m["buckets"]))
            keyed.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/{at}")
            made = {n.split("=")[1]: f"{at}/{n}" for n in self._bucket_folders(at)}
            gone = replaced[name]
            old = m["tables"].get(name, {"parts": {}})["parts"]
            parts = {} if gone is None else {b: ps for b, ps in old.items() if b == "all" or int(b) not in gone}
            for b, p in made.items():
                parts[b] = [*parts.get(b, []), p]
            m["tables"][name] = {"schema": df.schema.jsonValue(), "parts": parts}
        m["generation"] = g
        m["semantic"] |= semantic
        self._publish(m)
        return g

    def _bucket_folders(self, at: str) -> list[str]:
        p = self.folder._path(at)
        return sorted(s.getPath().getName() for s in self.folder._fs.listStatus(p) if s.getPath().getName().startswith("_bucket="))

    @staticmethod
    def _bucket(project: str, file: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(project, file), F.lit(buckets)).cast("int")

    # index -----------------------------------------------------------------------------------------------------
    def upsert(self, new: dict[str, DataFrame], touched: DataFrame, full: bool = False, **semantic) -> int:
        """Replace the rows of touched files (project_id, path) by the new ones in every table; with `full`, of the projects touched."""
        m = self.manifest()
        hit = None if full else {r[0] for r in touched.select(self._bucket("project_id", "path", m["buckets"])).distinct().collect()}  # at most one per bucket
        out, replaced = {}, {}
        for name, rows in new.items():
            entry = m["tables"].get(name)
            replaced[name] = hit
            if entry is None:
                out[name], replaced[name] = rows, None
                continue
            if hit is not None and "all" in entry["parts"]:
                replaced[name] = None
            parts = [p for b, ps in entry["parts"].items() for p in ps if replaced[name] is None or int(b) in hit]
            on = touched.select("project_id").distinct() if full else touched.select("project_id", F.col("path").alias(FILE_COLUMN[name])).distinct()
            out[name] = self._frame(entry, parts).join(on, on.columns, "left_anti").unionByName(rows, allowMissingColumns=True)
        return self.write(out, replaced, **semantic)

    def upsert_projects(self, rows: DataFrame) -> int:
        """Projects by id; the time of creation stays that of the first write."""
        old = self.read("projects")
        if old is None:
            return self.write({"projects": rows})
        first = old.select("project_id", F.col("created_at_ms").alias("_first"))
        kept = old.join(rows.select("project_id"), "project_id", "left_anti")
        merged = rows.join(first, "project_id", "left").withColumn("created_at_ms", F.coalesce("_first", "created_at_ms")).drop("_first")
        return self.write({"projects": kept.unionByName(merged, allowMissingColumns=True)})

    def reset(self, project_id: str) -> int:
        """Drop a project from every table."""
        return self.write({t: self.read(t).where(F.col("project_id") != project_id) for t in self.manifest()["tables"]})

    # dirty files -------------------------------------------------------------------------------------------------
    def record_events(self, counted: DataFrame) -> int:
        """Add (project_id, path, first_ms, last_ms, events) to the dirty files: pending, earliest first, latest last, counts summed."""
        new = counted.withColumn("status", F.lit("pending")).withColumn("reason", F.lit(None).cast("string"))
        old = self.read("dirty_files")
        return self.write({"dirty_files": new if old is None else merge_dirty(old, new)})

    def mark(self, paths: DataFrame, status: str, reason: str | None = None) -> int:
        hit = paths.select("project_id", "path").distinct().withColumn("_hit", F.lit(True))
        d = self.read("dirty_files").join(hit, ["project_id", "path"], "left")
        d = d.withColumns({"status": F.when(F.col("_hit"), status).otherwise(F.col("status")), "reason": F.when(F.col("_hit"), F.lit(reason)).otherwise(F.col("reason"))}).drop("_hit")
        return self.write({"dirty_files": d})

    def clear(self, paths: DataFrame) -> int:
        return self.write({"dirty_files": self.read("dirty_files").join(paths.select("project_id", "path"), ["project_id", "path"], "left_anti")})

    # vectors -----------------------------------------------------------------------------------------------------
    def sync_vectors(self, chunks: DataFrame, touched: DataFrame, embed, full: bool = False, **profile) -> dict:
        """Delete and insert the vectors of touched files; texts whose hash has a vector keep it, only the others are embedded.

        A changed profile (model, width) rebuilds all. A failing embedding leaves the old vectors and is recorded.
        """
        m = self.manifest()["semantic"]
        old = None if full or any(m.get(k) != v for k, v in profile.items()) else self.read("semantic_chunks")
        try:
            new = last_by_id(with_vectors(chunks, old, embed))
            if old is None:
                self.write({"semantic_chunks": new}, {"semantic_chunks": None}, fresh=True, error=None, **profile)
            else:
                self.upsert({"semantic_chunks": new}, touched, fresh=True, error=None, **profile)
        except Exception as e:  # the index stays usable without vectors
            self.write({}, fresh=False, error=str(e)[:300])
        return self.manifest()["semantic"]


def last_by_id(rows: DataFrame) -> DataFrame:
    """One row per id, the greatest by content hash of repeated ones; rows without an id stay."""
    if "id" not in rows.columns:
        return rows
    one = rows.where("id IS NOT NULL").dropDuplicates(["id", "content_hash"])
    keep = one.groupBy("id").agg(F.max("content_hash").alias("_h"))
    kept = one.join(keep, "id").where(F.col("content_hash").eqNullSafe(F.col("_h"))).drop("_h")
    return kept.select(*rows.columns).unionByName(rows.where("id IS NULL"))


def merge_dirty(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = F.max_by(F.struct("status", "reason"), "_new").alias("s")
    return both.groupBy("project_id", "path").agg(F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.sum("events").alias("events"), last).select("project_id", "path", "first_ms", "last_ms", "events", "s.status", "s.reason")


def with_vectors(chunks: DataFrame, old: DataFrame | None, embed) -> DataFrame:
    """Chunks with `embedding`: from an old row of the same content hash where there is one, else from `embed(list of texts)`, each hash once."""
    text = F.concat_ws("\n", "file_path", "symbol_name", "language", "content")
    need = chunks.select("content_hash", text.alias("text")).where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("text").alias("text"))
    known = None
    if old is not None:
        known = old.where("embedding IS NOT NULL").groupBy("content_hash").agg(F.max("embedding").alias("embedding"))
        need = need.join(known.select("content_hash"), "content_hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 64):
                part = pdf.iloc[lo : lo + 64]
                yield pd.DataFrame({"content_hash": part["content_hash"], "embedding": retrying(embed, list(part["text"]))})

    made = need.mapInPandas(run, "content_hash string, embedding array<float>")
    return chunks.join(made if known is None else known.unionByName(made), "content_hash", "left")


def retrying(embed, texts: list[str], attempts: int = 3) -> list[list[float]]:
    """Call a provider, again after transient failures; its vectors must be finite and as many as the texts."""
    import math
    import time

    for n in range(attempts):
        try:
            out = embed(texts)
            break
        except ConnectionError:
            if n + 1 == attempts:
                raise
            time.sleep(0.05 * 2**n)
    if len(out) != len(texts) or any(not math.isfinite(x) for v in out for x in v):
        raise ValueError("the provider returned other than one finite vector per text")
    return [[float(x) for x in v] for v in out]


def liveness(heartbeat_age_ms: Column, exited: Column, limit_ms: int = 30_000) -> Column:
    """State of a watcher by its last heartbeat: running, stale, dead or not_running."""
    return F.when(heartbeat_age_ms.isNull(), "not_running").when(exited, "dead").when(heartbeat_age_ms > limit_ms, "stale").otherwise("running")


def explain_failure(error: Exception | str) -> str:
    """What kind of failure an embedding provider's error is: rate_limit, auth, timeout, network, bad_response or unknown."""
    import re

    text = f"{type(error).__name__}: {error}".lower() if isinstance(error, Exception) else str(error).lower()
    kinds = {
        "rate_limit": r"\b429\b|rate.?limit|too many requests", "auth": r"\b40[13]\b|unauthori|forbidden|api.?key", "timeout": r"timed? ?out|timeout|deadline",
        "network": r"connection|refused|unreachable|resolve|dns|reset by peer", "bad_response": r"finite|dimension|vector|json|\b5\d\d\b",
    }
    return next((k for k, p in kinds.items() if re.search(p, text)), "unknown")
