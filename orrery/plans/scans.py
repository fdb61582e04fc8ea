"""Scans, classification and predicates over the relations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import paths as P
from orrery.sources import tables as T
from orrery.sources.tables import with_

#: An ignore file as a project might have it; a parameter of the query.
IGNORE_FILE = """
# caches and output
dist/
*.min.js
lib/*/fixture
packages/**/src
!packages/**/src/*.py
*.generated.*
mocks
"""
#: The name searched for, and the target of the impact queries.
NAME = "harbor"
TARGET = "src/ledger"


def s01_repo_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its size, hash, language, role and the reason it would be skipped for."""
    t = T.texts(spark, d)
    size = F.octet_length("content").cast("long")
    return t.select("project_id", "path", size.alias("size_bytes"), F.sha2("content", 256).alias("content_hash"), P.language_of(F.col("path")).alias("language"), P.role_of(F.col("path")).alias("role"), P.skip_reason(F.col("path"), size, 20_000).alias("skip_reason"))


def s02_targeted_scan(spark: SparkSession, d: str) -> DataFrame:
    """The texts of a list of paths (the files the index calls stale) outside ignored directories."""
    wanted = T.files(spark, d).where("status = 'stale'").select("project_id", "path")
    t = T.texts(spark, d).join(wanted, ["project_id", "path"], "left_semi")
    return t.where(P.ignored_directory(F.col("path")).isNull()).select("project_id", "path", F.length("content").cast("long").alias("n_chars"))


def s03_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Paths that would be indexed; contents aren't read."""
    f = T.files(spark, d)
    keep = P.skip_reason(F.col("path"), F.coalesce("size_bytes", F.lit(0))).isNull() & (P.language_of(F.col("path")) != "unknown")
    return f.where(keep).select("project_id", "path", "size_bytes")


def s04_ignore_file(spark: SparkSession, d: str) -> DataFrame:
    """Files by the last matching rule of an ignore file."""
    f = T.files(spark, d)
    return f.select("project_id", "path", P.ignored_by(F.col("path"), P.ignore_rules(IGNORE_FILE)).alias("ignored"))


def s05_ignored_directories(spark: SparkSession, d: str) -> DataFrame:
    f = T.files(spark, d).select(P.ignored_directory(F.col("path")).alias("directory"))
    return f.where("directory IS NOT NULL").groupBy("directory").agg(F.count(F.lit(1)).alias("files"))


def s06_skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    f = T.files(spark, d).select("project_id", P.skip_reason(F.col("path"), F.coalesce("size_bytes", F.lit(0))).alias("reason"))
    return f.where("reason IS NOT NULL").groupBy("project_id", "reason").agg(F.count(F.lit(1)).alias("files"))


def s07_roles(spark: SparkSession, d: str) -> DataFrame:
    """Role by path against the role on record."""
    f = T.files(spark, d).select(P.role_of(F.col("path")).alias("by_path"), F.col("role").alias("on_record"))
    return f.groupBy("by_path", "on_record").agg(F.count(F.lit(1)).alias("files"))


def s08_languages(spark: SparkSession, d: str) -> DataFrame:
    f = T.files(spark, d).select("project_id", P.language_of(F.col("path")).alias("language"), "size_bytes")
    return f.groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


def s09_edges_of_kind(spark: SparkSession, d: str) -> DataFrame:
    """Edges scoped by project and kind."""
    return T.edges(spark, d).where(F.col("kind").isin("tested_by", "calls_api", "routes_to")).select("project_id", "kind", "edge_seq", "source_id", "target_id")


def _stale(spark: SparkSession, d: str) -> DataFrame:
    return T.files(spark, d).where("status IN ('stale', 'deleted')").select("project_id", "path")


def s10_rows_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of a list of files."""
    s = T.symbols(spark, d)
    return s.join(_stale(spark, d).withColumnRenamed("path", "file_path"), ["project_id", "file_path"], "left_semi").select("project_id", "id", "file_path", "name")


def s11_edges_touching(spark: SparkSession, d: str) -> DataFrame:
    """Edges that touch a listed file with any of their paths: each path is one row, so that it is an equi-join."""
    e = T.edges(spark, d)
    sides = e.select("edge_seq", "project_id", F.explode(F.array_distinct(F.array_compact(F.array("source_file", "target_file", "file_path")))).alias("path"))
    hit = sides.join(_stale(spark, d), ["project_id", "path"], "left_semi").select("edge_seq").distinct()
    return e.join(hit, "edge_seq", "left_semi").select("edge_seq", "project_id", "kind", "source_file", "target_file")


def s12_scoped_edges(spark: SparkSession, d: str) -> DataFrame:
    """As before, for some kinds only; an empty scope gives nothing."""
    return s11_edges_touching(spark, d).where(F.col("kind").isin("imports", "exports", "tested_by"))


def s13_projects_by_root(spark: SparkSession, d: str) -> DataFrame:
    """The newest project of each root, letter case aside."""
    p = spark.read.parquet(f"{d}/projects.parquet")
    best = F.max_by(F.struct("project_id", "display_name"), F.struct(F.coalesce("last_indexed_at_ms", F.lit(-1)), "project_id"))
    return p.groupBy(F.lower("canonical_root").alias("root")).agg(best.alias("b")).select("root", "b.project_id", "b.display_name")


def s19_changed_in_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Post-image paths of every text that is a unified diff."""
    t = T.texts(spark, d).where(F.col("content").startswith("diff --git"))
    return t.select("project_id", F.explode(changed_paths(F.col("content"))).alias("changed")).distinct()


def changed_paths(diff):
    """Distinct post-image paths of a unified diff, in order; deleted files, whose post-image is /dev/null, are left out."""
    plus = F.regexp_extract_all(diff, F.lit(r"(?m)^\+\+\+ (?:b/)?([^\t\r\n]+)"), F.lit(1))
    renamed = F.regexp_extract_all(diff, F.lit(r"(?m)^rename to ([^\r\n]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.concat(plus, renamed), lambda x: x != "/dev/null")))


def pred01_find_symbol(spark: SparkSession, d: str) -> DataFrame:
    """Symbols whose name holds a word, letter case aside."""
    s = T.symbols(spark, d)
    return s.where(F.contains(F.lower("name"), F.lit(NAME))).select("project_id", "id", "name", "kind", "file_path")


def pred03_impact_targets(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that a free-text target means: by name, or by path."""
    s = T.symbols(spark, d)
    by_name = F.contains(F.lower("name"), F.lit(TARGET.lower()))
    return s.where(by_name | F.contains("file_path", F.lit(TARGET))).select("project_id", "id", "file_path", "name")


def pred06_trace_edges(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["calls", "calls_api", "routes_to", "handles_webhook", "handles_event", "tested_by", "uses_middleware", "reads_from", "writes_to"]
    return T.edges(spark, d).where(F.col("kind").isin(kinds)).groupBy("project_id", "kind").agg(F.count(F.lit(1)).alias("edges"))


def pred09_evidence_classes(spark: SparkSession, d: str) -> DataFrame:
    f = T.files(spark, d).select("project_id", P.evidence_class(F.col("path")).alias("evidence"), P.is_test(F.col("path")).alias("is_test"))
    return f.groupBy("project_id", "evidence", "is_test").agg(F.count(F.lit(1)).alias("files"))


def pred11_fresh_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges none of whose ends lies in a stale file; an unknown end passes."""
    stale = _stale(spark, d)
    e = T.edges(spark, d)
    for side in ("source_file", "target_file"):
        e = e.join(stale.select("project_id", F.col("path").alias(side)), ["project_id", side], "left_anti")
    return e.groupBy("project_id").agg(F.count(F.lit(1)).alias("fresh_edges"))


def pred14_unresolved_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls that lead nowhere: no such symbol, not resolved, no target file."""
    e = T.edges(spark, d).where("kind = 'calls'")
    s = T.symbols(spark, d).select("project_id", F.col("id").alias("target_id"))
    lost = e.where("coalesce(resolution, '') NOT IN ('resolved', 'resolved_lsp') AND target_file IS NULL").join(s, ["project_id", "target_id"], "left_anti")
    return lost.select("project_id", "edge_seq", "target_name")


def pred16_routes_by_path(spark: SparkSession, d: str) -> DataFrame:
    f = T.files(spark, d).select("project_id", "path", P.next_route(F.col("path")).alias("route"))
    return f.where("route IS NOT NULL")


def pred17_api_routes(spark: SparkSession, d: str) -> DataFrame:
    t = T.texts(spark, d)
    return t.select("project_id", "path", F.explode(P.api_routes(F.col("content"))).alias("route"))


def pred18_import_sources(spark: SparkSession, d: str) -> DataFrame:
    t = T.texts(spark, d)
    return t.select("project_id", "path", F.explode(P.import_sources(F.col("content"))).alias("source"))


QUERIES = {k: v for k, v in list(globals().items()) if re.match(r"(s|pred)\d\d_", k)}


def _case_role(p: str) -> str:
    roles = " ".join(f"WHEN list_contains([{', '.join(repr(x) for x in ds)}], x) THEN '{r}'" for r, ds in P.DIRECTORY_ROLES.items())
    dirs = f"list_filter(list_transform(string_split({p}, '/')[:-2], lambda x: CASE {roles} END), lambda x: x IS NOT NULL)"
    rx = lambda pat: f"regexp_matches({p}, '{pat}')"
    return (
        f"CASE WHEN len({dirs}) > 0 THEN {dirs}[1] WHEN {rx(P._MINIFIED)} THEN 'minified' WHEN {rx(P._GENERATED)} THEN 'generated' WHEN {rx(P._TEST_ROLE)} THEN 'test' "
        f"WHEN {rx(r'(?i).(md|mdx)$'.replace('.', chr(92) + '.', 1))} THEN 'docs' WHEN {rx(P._CONFIG_NAME)} OR {rx(P._CONFIG_EXT)} THEN 'config' ELSE 'source' END"
    )


def _case_skip(p: str, size: str, most: int) -> str:
    role = _case_role(p)
    return f"CASE WHEN regexp_matches({p}, '{P._SENSITIVE}') THEN 'sensitive file policy' WHEN ({role}) IN ('generated', 'minified', 'build', 'vendor') THEN ({role}) || ' file policy' WHEN {size} > {most} THEN 'file exceeds {most} bytes' END"


def _case_language(p: str) -> str:
    whens = " ".join(f"WHEN '{e}' THEN '{x}'" for e, x in P.LANGUAGES.items())
    return f"CASE lower(regexp_extract({p}, '\\.([^.]*)$', 1)) {whens} ELSE 'unknown' END"


def _case_ignore(p: str) -> str:
    rules = P.ignore_rules(IGNORE_FILE)
    return "CASE " + " ".join(f"WHEN regexp_matches({p}, '{r.pattern}') THEN {str(not r.negated).lower()}" for r in reversed(rules)) + " ELSE false END"


_STALE = "stale AS (SELECT project_id, path FROM fil WHERE status IN ('stale', 'deleted'))"
_IGN = ", ".join(repr(x) for x in P.IGNORED_DIRECTORIES)
_EVID = f"CASE WHEN regexp_matches(lower(path), '{P._TEST_PATH}') THEN 'test' WHEN regexp_matches(lower(path), '{P._FIXTURE_PATH}') THEN 'fixture' WHEN regexp_matches(lower(path), '{P._DOCS_PATH}') THEN 'docs' ELSE 'implementation' END"
_TOUCH = "touch AS (SELECT DISTINCT e.edge_seq, e.project_id, e.kind, e.source_file, e.target_file FROM edg e JOIN stale s ON e.project_id = s.project_id AND (e.source_file = s.path OR e.target_file = s.path OR e.file_path = s.path))"

ORACLE = {
    "s01_repo_scan": with_("txt") + f" SELECT project_id, path, strlen(content)::BIGINT AS size_bytes, sha256(content) AS content_hash, {_case_language('path')} AS language, {_case_role('path')} AS role, {_case_skip('path', 'strlen(content)', 20000)} AS skip_reason FROM txt",
    "s02_targeted_scan": with_("txt", "fil") + f" SELECT t.project_id, t.path, length(t.content)::BIGINT AS n_chars FROM txt t JOIN fil f USING (project_id, path) WHERE f.status = 'stale' AND NOT list_has_any(string_split(path, '/')[:-2], [{_IGN}])",
    "s03_inventory": with_("fil") + f" SELECT project_id, path, size_bytes FROM fil WHERE ({_case_skip('path', 'coalesce(size_bytes, 0)', 512000)}) IS NULL AND ({_case_language('path')}) <> 'unknown'",
    "s04_ignore_file": with_("fil") + f" SELECT project_id, path, {_case_ignore('path')} AS ignored FROM fil",
    "s05_ignored_directories": with_("fil") + f" SELECT d AS directory, count(*) AS files FROM (SELECT list_filter(string_split(path, '/')[:-2], lambda x: x IN ({_IGN}))[1] AS d FROM fil) WHERE d IS NOT NULL GROUP BY 1",
    "s06_skip_reasons": with_("fil") + f" SELECT project_id, reason, count(*) AS files FROM (SELECT project_id, {_case_skip('path', 'coalesce(size_bytes, 0)', 512000)} AS reason FROM fil) WHERE reason IS NOT NULL GROUP BY ALL",
    "s07_roles": with_("fil") + f" SELECT {_case_role('path')} AS by_path, role AS on_record, count(*) AS files FROM fil GROUP BY ALL",
    "s08_languages": with_("fil") + f" SELECT project_id, lang AS language, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM (SELECT project_id, size_bytes, {_case_language('path')} AS lang FROM fil) GROUP BY ALL",
    "s09_edges_of_kind": with_("edg") + " SELECT project_id, kind, edge_seq, source_id, target_id FROM edg WHERE kind IN ('tested_by', 'calls_api', 'routes_to')",
    "s10_rows_of_files": with_("sym", "fil") + f", {_STALE} SELECT s.project_id, s.id, s.file_path, s.name FROM sym s SEMI JOIN stale t ON s.project_id = t.project_id AND s.file_path = t.path",
    "s11_edges_touching": with_("edg", "fil") + f", {_STALE}, {_TOUCH} SELECT * FROM touch",
    "s12_scoped_edges": with_("edg", "fil") + f", {_STALE}, {_TOUCH} SELECT * FROM touch WHERE kind IN ('imports', 'exports', 'tested_by')",
    "s13_projects_by_root": "SELECT root, project_id, display_name FROM (SELECT lower(canonical_root) AS root, project_id, display_name, row_number() OVER (PARTITION BY lower(canonical_root) ORDER BY coalesce(last_indexed_at_ms, -1) DESC, project_id DESC) AS r FROM projects) WHERE r = 1",
    "s19_changed_in_diffs": with_("txt") + r" SELECT DISTINCT project_id, unnest(list_filter(list_concat(regexp_extract_all(content, '(?m)^\+\+\+ (?:b/)?([^\t\r\n]+)', 1), regexp_extract_all(content, '(?m)^rename to ([^\r\n]+)', 1)), lambda x: x <> '/dev/null')) AS changed FROM txt WHERE starts_with(content, 'diff --git')",
    "pred01_find_symbol": with_("sym") + f" SELECT project_id, id, name, kind, file_path FROM sym WHERE contains(lower(name), '{NAME}')",
    "pred03_impact_targets": with_("sym") + f" SELECT project_id, id, file_path, name FROM sym WHERE contains(lower(name), '{TARGET}') OR contains(file_path, '{TARGET}')",
    "pred06_trace_edges": with_("edg") + " SELECT project_id, kind, count(*) AS edges FROM edg WHERE kind IN ('calls', 'calls_api', 'routes_to', 'handles_webhook', 'handles_event', 'tested_by', 'uses_middleware', 'reads_from', 'writes_to') GROUP BY ALL",
    "pred09_evidence_classes": with_("fil") + f" SELECT project_id, {_EVID} AS evidence, regexp_matches(lower(path), '{P._TEST_PATH}') AS is_test, count(*) AS files FROM fil GROUP BY ALL",
    "pred11_fresh_edges": with_("edg", "fil") + f", {_STALE} SELECT e.project_id, count(*) AS fresh_edges FROM edg e WHERE NOT EXISTS (SELECT 1 FROM stale s WHERE s.project_id = e.project_id AND s.path = e.source_file) AND NOT EXISTS (SELECT 1 FROM stale s WHERE s.project_id = e.project_id AND s.path = e.target_file) GROUP BY ALL",
    "pred14_unresolved_calls": with_("edg", "sym") + " SELECT project_id, edge_seq, target_name FROM edg e WHERE kind = 'calls' AND coalesce(resolution, '') NOT IN ('resolved', 'resolved_lsp') AND target_file IS NULL AND NOT EXISTS (SELECT 1 FROM sym s WHERE s.project_id = e.project_id AND s.id = e.target_id)",
    "pred16_routes_by_path": with_("fil") + r""", b AS (SELECT project_id, path, coalesce(nullif(regexp_extract(path, '(?:^|/)app/(.*?)/?(?:route|page)\.[jt]sx?$', 1), ''), nullif(regexp_extract(path, '(?:^|/)pages/(.*)\.[jt]sx?$', 1), '')) AS body FROM fil)
SELECT project_id, path, '/' || array_to_string(list_transform(list_filter(string_split(body, '/'), lambda x: x <> '' AND x <> 'index' AND NOT regexp_matches(x, '^\(.*\)$')), lambda x: regexp_replace(x, '^\[(?:\.\.\.)?(.+?)\]$', ':\1')), '/') AS route FROM b WHERE body IS NOT NULL""",
    "pred17_api_routes": with_("txt") + r""" SELECT DISTINCT project_id, path, unnest(list_concat(list_filter(regexp_extract_all(content, '["''`](/api/[A-Za-z0-9_./:\[\]()*-]+)["''`]', 1), lambda r: NOT contains(r, '*')),
  list_transform(list_concat(regexp_extract_all(content, '\b(?:api|apiClient)\.([A-Za-z0-9_-]+)\b', 1), regexp_extract_all(content, '\b([A-Za-z][A-Za-z0-9_-]*)Api\.', 1)), lambda x: '/api/' || x))) AS route FROM txt""",
    "pred18_import_sources": with_("txt") + r""" SELECT project_id, path, unnest(list_distinct(regexp_extract_all(content, '(?:from\s+|import\s*\(?\s*|require\s*\(\s*)["''](\.[^"'']*)["'']', 1))) AS source FROM txt""",
}
