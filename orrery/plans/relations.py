"""Joins, aggregates and set operations over the relations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.paths import _TEST_PATH, import_sources
from orrery.operators import relations as R
from orrery.session import table
from orrery.sources import tables as T
from orrery.sources.tables import with_


def j02_edge_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return R.endpoints(T.edges(spark, d), T.symbols(spark, d, "file_path", "name")).select("edge_seq", "kind", "source_symbol", "target_symbol", "source_file", "target_file")


def _scan(spark: SparkSession, d: str) -> DataFrame:
    return T.texts(spark, d).select("project_id", "path", F.sha2("content", 256).alias("content_hash"))


def j04_freshness(spark: SparkSession, d: str) -> DataFrame:
    """The index against the tree."""
    return R.freshness(T.files(spark, d), _scan(spark, d))


def j05_changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Change detection of a scan: files that are new or whose hash differs from the index's, and files that are gone from the tree."""
    seen = _scan(spark, d)
    known = T.files(spark, d).select("project_id", "path", F.col("content_hash").alias("known"), F.lit(True).alias("there"))
    j = seen.join(known, ["project_id", "path"], "left")
    changed = j.where(F.col("there").isNull() | ~F.col("content_hash").eqNullSafe(F.col("known"))).select("project_id", "path", F.when(F.col("there"), "changed").otherwise("new").alias("change"))
    gone = known.select("project_id", "path").join(seen, ["project_id", "path"], "left_anti").select("project_id", "path", F.lit("deleted").alias("change"))
    return changed.unionByName(gone)


def u06_symbol_changes(spark: SparkSession, d: str) -> DataFrame:
    """What changed between the index of generation 20 and now: symbols added, removed, or with another signature or place."""
    before = table(spark, d, "symbols").where("generation <= 20").withColumn("gone", F.col("deleted_at").isNotNull())
    before = T.latest(before, ["project_id", "id"], "generation", ["gone", *T.SYMBOL_COLUMNS]).where("NOT gone")
    h = lambda df, n: df.select("project_id", "id", F.hash("signature", "start_line", "end_line").alias(n), F.coalesce("signature", F.lit("")).alias(n + "s"), F.coalesce("start_line", F.lit(-1)).alias(n + "l"), F.coalesce("end_line", F.lit(-1)).alias(n + "e"))
    j = h(before, "a").join(h(T.symbols(spark, d), "b"), ["project_id", "id"], "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when((F.col("as") != F.col("bs")) | (F.col("al") != F.col("bl")) | (F.col("ae") != F.col("be")), "changed").otherwise("same")
    return j.groupBy("project_id", change.alias("change")).agg(F.count(F.lit(1)).alias("symbols"))


def j08_import_resolution(spark: SparkSession, d: str) -> DataFrame:
    t = T.texts(spark, d)
    return R.resolve_imports(t.select("project_id", "path", F.explode(import_sources(F.col("content"))).alias("source")), t)


def j09_symbol_resolution(spark: SparkSession, d: str) -> DataFrame:
    e = T.edges(spark, d)
    return R.resolve_calls(e.where("kind = 'calls'"), e.where("kind = 'imports'"), T.symbols(spark, d))


def j10_test_edges(spark: SparkSession, d: str) -> DataFrame:
    return R.test_edges(T.edges(spark, d).where("kind = 'imports'"), T.symbols(spark, d))


def j11_narrowest_symbol(spark: SparkSession, d: str) -> DataFrame:
    return R.narrowest(T.edges(spark, d).where("source_file IS NOT NULL"), T.symbols(spark, d, "file_path", "kind", "start_line", "end_line"))


def j13_callees(spark: SparkSession, d: str) -> DataFrame:
    c = R.callees(T.edges(spark, d).where("kind = 'calls'"), T.symbols(spark, d, "file_path", "start_line", "end_line"))
    return c.groupBy("project_id", "id").agg(F.count(F.lit(1)).alias("callees"), F.min("callee").alias("first_callee"))


def j14_chunk_of_symbol(spark: SparkSession, d: str) -> DataFrame:
    return R.chunk_of_symbol(T.symbols(spark, d), T.chunks(spark, d, "project_id", "file_path", "symbol_name", "start_line", "end_line"))


def j15_route_match(spark: SparkSession, d: str) -> DataFrame:
    """Paths as requests, against routes with named segments and exact ones."""
    f = T.files(spark, d).select("path", "status")
    seg = F.split("path", "/")
    named = f.select(F.concat(F.lit("/"), F.element_at(seg, 1), F.array_join(F.transform(F.slice(seg, 2, 99), lambda x, i: F.concat(F.lit("/:p"), i.cast("string"))), "")).alias("route"))
    exact = f.where("status = 'stale'").select(F.concat(F.lit("/"), "path").alias("route"))
    return R.match_routes(f.select(F.concat(F.lit("/"), "path").alias("request")), named.union(exact))


def j17_middleware(spark: SparkSession, d: str) -> DataFrame:
    """Every file with a route beside its project's one guard."""
    guard = T.symbols(spark, d).where("lower(name) LIKE '%guard%' AND kind <> 'file'").groupBy("project_id").agg(F.min("id").alias("guard_id"))
    routed = T.edges(spark, d).where("kind = 'routes_to' AND source_file IS NOT NULL").select("project_id", "source_file").distinct()
    return routed.join(guard, "project_id")


def j18_duplicate_signals(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbol_structures").select("symbol_id", "body_fingerprint", "signature_tokens", "imports", "callees", "generation")
    return R.duplicate_signals(T.latest(s, ["symbol_id"], "generation", ["body_fingerprint", "signature_tokens", "imports", "callees"]))


def j21_induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """Edges between exported functions of TypeScript files."""
    nodes = T.symbols(spark, d).where("language = 'typescript' AND kind = 'function' AND exported").select("project_id", "id")
    e = T.edges(spark, d).select("edge_seq", "project_id", "source_id", "target_id", "kind")
    for side in ("source_id", "target_id"):
        e = e.join(nodes.withColumnRenamed("id", side), ["project_id", side], "left_semi")
    return e


def j22_route_calls(spark: SparkSession, d: str) -> DataFrame:
    """Proven calls out of files with routes lead on to services."""
    e = T.edges(spark, d)
    routed = e.where("kind = 'routes_to' AND source_file IS NOT NULL").select("project_id", "source_file").distinct()
    calls = e.where(F.col("resolution").isin(*R.RESOLVED) & (F.col("kind") == "calls")).join(routed, ["project_id", "source_file"], "left_semi")
    return calls.select("project_id", "source_file", "target_id").distinct()


def u03_merged_scan(spark: SparkSession, d: str) -> DataFrame:
    """The index with the scanned paths replaced by the scan."""
    old = T.files(spark, d).select("project_id", "path", "content_hash")
    new = _scan(spark, d)
    kept = old.join(new.select("project_id", "path"), ["project_id", "path"], "left_anti")
    return kept.withColumn("origin", F.lit("index")).union(new.withColumn("origin", F.lit("scan")))


def u06_snapshot_difference(spark: SparkSession, d: str) -> DataFrame:
    return T.files(spark, d).select("project_id", "path").exceptAll(_scan(spark, d).select("project_id", "path"))


def g11_invalidated(spark: SparkSession, d: str) -> DataFrame:
    """Files to be analysed again: changed ones, and those whose edges lead into a changed or deleted one."""
    state = j04_freshness(spark, d)
    touched = state.where("state <> 'fresh'").select("project_id", "path")
    into = T.edges(spark, d).where("source_file IS NOT NULL").select("project_id", F.col("source_file").alias("path"), F.col("target_file"))
    dependents = into.join(touched.select("project_id", F.col("path").alias("target_file")), ["project_id", "target_file"], "left_semi").select("project_id", "path")
    return touched.union(dependents).distinct()


def a01_index_status(spark: SparkSession, d: str) -> DataFrame:
    """Counts per project, each table aggregated before they meet."""
    n = lambda df, name: df.groupBy("project_id").agg(F.count(F.lit(1)).alias(name))
    state = j04_freshness(spark, d).groupBy("project_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("fresh", "stale", "pending", "deleted")])
    out = table(spark, d, "projects").select("project_id", "index_generation", "semantic_fresh")
    for df in (n(T.files(spark, d), "files"), n(T.symbols(spark, d, "kind"), "symbols"), n(T.edges(spark, d), "edges"), n(T.chunks(spark, d, "project_id"), "chunks"), n(table(spark, d, "skipped_files").select("project_id", "file_path").distinct(), "skipped"), state):
        out = out.join(df, "project_id", "left")
    counts = ["files", "symbols", "edges", "chunks", "skipped", "fresh", "stale", "pending", "deleted"]
    return out.fillna(0, counts)


def a02_symbols_per_language(spark: SparkSession, d: str) -> DataFrame:
    return T.symbols(spark, d).groupBy("language", "kind").agg(F.count(F.lit(1)).alias("symbols"), F.count_if("exported").alias("exported"))


def a13_callers_and_tests(spark: SparkSession, d: str) -> DataFrame:
    e = T.edges(spark, d)
    callers = e.where("kind = 'calls'").groupBy("project_id", F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    tests = e.where("kind = 'tested_by'").groupBy("project_id", F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("tests"))
    s = T.symbols(spark, d).where("kind <> 'file'").select("project_id", "id")
    return s.join(callers, ["project_id", "id"], "left").join(tests, ["project_id", "id"], "left").fillna(0, ["callers", "tests"])


def a14_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbol_structures").where("body_fingerprint IS NOT NULL").select("symbol_id", "project_id", "body_fingerprint").distinct()
    g = s.groupBy("body_fingerprint").agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("project_id").alias("projects"), F.min("symbol_id").alias("first_symbol"))
    return g.where("symbols > 1")


def a17_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Warnings of a kind and message as one, with at most eight samples."""
    w = table(spark, d, "analysis_warnings").distinct()
    base = w.groupBy("kind", "message").agg(F.sum("occurrences").alias("occurrences"))
    s = w.where("samples IS NOT NULL").select("kind", "message", F.explode("samples").alias("s")).where("s IS NOT NULL").distinct()
    from pyspark.sql import Window

    first = s.withColumn("r", F.row_number().over(Window.partitionBy("kind", "message").orderBy("s"))).where("r <= 8")
    first = first.groupBy("kind", "message").agg(F.array_join(F.array_sort(F.collect_list("s")), ";").alias("samples"))
    return base.join(first, ["kind", "message"], "left")


def a23_incident_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The three strongest kinds of edge at each file."""
    e = j02_edge_endpoints(spark, d)
    both = e.select(F.col("source_file").alias("file"), "kind").union(e.select("target_file", "kind")).where("file IS NOT NULL").distinct()
    top = F.slice(F.array_sort(F.collect_list(F.struct((-strength(F.col("kind"))).alias("s"), "kind"))), 1, 3)  # at most one entry per kind
    return both.groupBy("file").agg(F.array_join(F.transform(top, lambda x: x["kind"]), ",").alias("kinds"))


def strength(kind):
    """How much an edge tells about nearness (fixed values)."""
    return (
        F.when(kind.isin("calls", "calls_api", "routes_to", "handles_event", "handles_webhook"), 1.0).when(kind == "uses_middleware", 0.9)
        .when(kind.isin("imports", "exports", "tested_by"), 0.8).when(kind.isin("reads_from", "writes_to", "references"), 0.6).when(kind == "contains", 0.25).otherwise(0.2)
    )


def a24_repeated_edges(spark: SparkSession, d: str) -> DataFrame:
    """How often edges were delivered more than once."""
    g = table(spark, d, "edges").groupBy(*T.EDGE_COLUMNS).agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("project_id", "kind").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.col("n") - 1).alias("repeats"))


QUERIES = {k: v for k, v in list(globals().items()) if re.match(r"[jaug]\d\d_", k)}

_STRENGTH = "CASE WHEN kind IN ('calls', 'calls_api', 'routes_to', 'handles_event', 'handles_webhook') THEN 1.0 WHEN kind = 'uses_middleware' THEN 0.9 WHEN kind IN ('imports', 'exports', 'tested_by') THEN 0.8 WHEN kind IN ('reads_from', 'writes_to', 'references') THEN 0.6 WHEN kind = 'contains' THEN 0.25 ELSE 0.2 END"
_ENDS = "ends AS (SELECT e.edge_seq, e.project_id, e.kind, s.name AS source_symbol, t.name AS target_symbol, coalesce(s.file_path, e.source_file) AS source_file, coalesce(t.file_path, e.target_file) AS target_file FROM edg e LEFT JOIN sym s ON s.project_id = e.project_id AND s.id = e.source_id LEFT JOIN sym t ON t.project_id = e.project_id AND t.id = e.target_id)"
_STATE = "state AS (SELECT coalesce(f.project_id, t.project_id) AS project_id, coalesce(f.path, t.path) AS path, CASE WHEN f.path IS NULL THEN 'pending' WHEN t.path IS NULL THEN 'deleted' WHEN f.content_hash IS NOT DISTINCT FROM sha256(t.content) THEN 'fresh' ELSE 'stale' END AS state FROM fil f FULL JOIN txt t ON f.project_id = t.project_id AND f.path = t.path)"


def _jac(c: str) -> str:
    n = f"len(list_intersect(s.{c}, o.{c}))"
    return f"CASE WHEN len(s.{c}) + len(o.{c}) > 0 THEN {n} / (len(s.{c}) + len(o.{c}) - {n}) ELSE 0.0 END"


ORACLE = {
    "j02_edge_endpoints": with_("edg", "sym") + f", {_ENDS} SELECT * EXCLUDE (project_id) FROM ends",
    "j04_freshness": with_("fil", "txt") + f", {_STATE} SELECT * FROM state",
    "j05_changed_files": with_("txt", "fil") + " SELECT t.project_id, t.path, CASE WHEN f.path IS NULL THEN 'new' ELSE 'changed' END AS change FROM txt t LEFT JOIN fil f USING (project_id, path) WHERE f.path IS NULL OR f.content_hash IS DISTINCT FROM sha256(t.content) UNION ALL SELECT project_id, path, 'deleted' FROM fil f WHERE NOT EXISTS (SELECT 1 FROM txt t WHERE t.project_id = f.project_id AND t.path = f.path)",
    "u06_symbol_changes": with_("sym") + ", " + T.SQL["sym"].replace("sym AS", "bef AS").replace("FROM symbols)", "FROM symbols WHERE generation <= 20)") + " SELECT coalesce(a.project_id, b.project_id) AS project_id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN coalesce(a.signature, '') <> coalesce(b.signature, '') OR coalesce(a.start_line, -1) <> coalesce(b.start_line, -1) OR coalesce(a.end_line, -1) <> coalesce(b.end_line, -1) THEN 'changed' ELSE 'same' END AS change, count(*) AS symbols FROM bef a FULL JOIN sym b ON a.project_id = b.project_id AND a.id = b.id GROUP BY ALL",
    "j08_import_resolution": with_("txt") + r""", src AS (SELECT project_id, path, unnest(list_distinct(regexp_extract_all(content, '(?:from\s+|import\s*\(?\s*|require\s*\(\s*)["''](\.[^"'']*)["'']', 1))) AS source FROM txt),
c AS (SELECT *, regexp_replace(path, '[^/]*$', '') || regexp_replace(source, '^\./', '') AS p FROM src),
cand AS (SELECT project_id, path, source, unnest(list_concat([p], list_transform(['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs'], lambda e: regexp_replace(p, '\.(js|jsx|mjs|cjs)$', '') || e), list_transform(['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs'], lambda e: p || '/index' || e))) AS cand, unnest(range(13)) AS r FROM c)
SELECT c.project_id, c.path, c.source, arg_min(t.path, CASE WHEN t.path IS NOT NULL THEN r END) AS target FROM cand c LEFT JOIN txt t ON t.project_id = c.project_id AND t.path = c.cand GROUP BY ALL""",
    "j09_symbol_resolution": with_("edg", "sym") + """, b AS (SELECT project_id, source_file, target_file, max(edge_seq) AS bound_at FROM edg WHERE kind = 'imports' AND source_file IS NOT NULL AND target_file IS NOT NULL GROUP BY ALL),
k AS (SELECT project_id, file_path, name, min(id) AS id FROM sym WHERE exported AND kind <> 'file' GROUP BY ALL)
SELECT edge_seq, id AS resolved_id FROM (SELECT e.edge_seq, k.id, row_number() OVER (PARTITION BY e.edge_seq ORDER BY b.bound_at DESC, k.id DESC) AS r FROM edg e JOIN b ON b.project_id = e.project_id AND b.source_file = e.source_file JOIN k ON k.project_id = e.project_id AND k.file_path = b.target_file AND k.name = e.target_name WHERE e.kind = 'calls') WHERE r = 1""",
    "j10_test_edges": with_("edg", "sym") + f", f AS (SELECT project_id, file_path, min(id) AS id FROM sym WHERE kind = 'file' GROUP BY ALL) SELECT DISTINCT e.project_id, a.id AS source_id, b.id AS test_id FROM edg e JOIN f a ON a.project_id = e.project_id AND a.file_path = e.target_file JOIN f b ON b.project_id = e.project_id AND b.file_path = e.source_file WHERE e.kind = 'imports' AND regexp_matches(lower(e.source_file), '{_TEST_PATH}') AND NOT regexp_matches(lower(e.target_file), '{_TEST_PATH}')",
    "j11_narrowest_symbol": with_("edg", "sym") + " SELECT edge_seq, symbol_id, span FROM (SELECT e.edge_seq, s.id AS symbol_id, s.end_line - s.start_line AS span, row_number() OVER (PARTITION BY e.edge_seq ORDER BY s.end_line - s.start_line, s.id) AS r FROM edg e JOIN sym s ON s.project_id = e.project_id AND s.file_path = e.source_file AND e.line BETWEEN s.start_line AND s.end_line WHERE s.kind <> 'file') WHERE r = 1",
    "j13_callees": with_("edg", "sym") + " SELECT project_id, id, count(*) AS callees, min(callee) AS first_callee FROM (SELECT s.project_id, s.id, e.target_name AS callee FROM edg e JOIN sym s ON s.project_id = e.project_id AND s.id = e.source_id WHERE e.kind = 'calls' AND e.target_name IS NOT NULL UNION SELECT s.project_id, s.id, e.target_name FROM edg e JOIN sym s ON s.project_id = e.project_id AND s.file_path = e.source_file AND e.line BETWEEN s.start_line AND s.end_line WHERE e.kind = 'calls' AND e.target_name IS NOT NULL) GROUP BY ALL",
    "j14_chunk_of_symbol": with_("sym", "chk") + " SELECT project_id, id, chunk_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY project_id, id ORDER BY tier, cs, chunk_id) AS r FROM (SELECT s.project_id, s.id, c.id AS chunk_id, c.start_line AS cs, CASE WHEN c.symbol_name = s.name THEN 1 WHEN c.start_line <= s.start_line AND c.end_line >= s.end_line AND c.end_line >= s.start_line THEN 2 ELSE 3 END AS tier FROM sym s JOIN chk c ON c.project_id = s.project_id AND c.file_path = s.file_path WHERE s.kind <> 'file') WHERE tier IS NOT NULL) WHERE r = 1",
    "j15_route_match": with_("fil") + ", g AS (SELECT path, status, string_split(path, '/') AS s FROM fil), r AS (SELECT DISTINCT route, string_split(route, '/') AS rs FROM (SELECT '/' || s[1] || array_to_string(list_transform(range(len(s) - 1), lambda i: '/:p' || i::VARCHAR), '') AS route FROM g UNION ALL SELECT '/' || path FROM g WHERE status = 'stale')), q AS (SELECT DISTINCT '/' || path AS request, string_split('/' || path, '/') AS qs FROM g) SELECT request, route FROM (SELECT request, route, row_number() OVER (PARTITION BY request ORDER BY route <> request, route) AS k FROM q JOIN r ON len(q.qs) = len(r.rs) AND q.qs[2] = r.rs[2] AND len(list_filter(range(1, len(qs) + 1), lambda i: NOT (qs[i] = rs[i] OR starts_with(rs[i], ':')))) = 0) WHERE k = 1",
    "j17_middleware": with_("edg", "sym") + " SELECT DISTINCT e.project_id, e.source_file, g.guard_id FROM edg e JOIN (SELECT project_id, min(id) AS guard_id FROM sym WHERE lower(name) LIKE '%guard%' AND kind <> 'file' GROUP BY ALL) g ON g.project_id = e.project_id WHERE e.kind = 'routes_to' AND e.source_file IS NOT NULL",
    "j18_duplicate_signals": f"""WITH s AS (SELECT DISTINCT symbol_id, body_fingerprint, list_distinct(coalesce(signature_tokens, [])) AS sig, list_distinct(coalesce(imports, [])) AS imp, list_distinct(coalesce(callees, [])) AS cal FROM symbol_structures WHERE body_fingerprint IS NOT NULL),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY body_fingerprint ORDER BY symbol_id) AS r FROM s) WHERE r <= 65),
j AS (SELECT s.symbol_id, {_jac("sig")} AS sg, {_jac("imp")} AS im, {_jac("cal")} AS ca FROM s JOIN o ON s.body_fingerprint = o.body_fingerprint AND s.symbol_id <> o.symbol_id)
SELECT symbol_id, count(*) FILTER (WHERE ca >= 0.5) AS duplicates, round(max(sg), 3) AS signature_similarity, round(max(im), 3) AS import_overlap, round(max(ca), 3) AS callee_overlap FROM j GROUP BY ALL""",
    "j21_induced_subgraph": with_("edg", "sym") + ", n AS (SELECT project_id, id FROM sym WHERE language = 'typescript' AND kind = 'function' AND exported) SELECT edge_seq, e.project_id, source_id, target_id, kind FROM edg e WHERE EXISTS (SELECT 1 FROM n WHERE n.project_id = e.project_id AND n.id = e.source_id) AND EXISTS (SELECT 1 FROM n WHERE n.project_id = e.project_id AND n.id = e.target_id)",
    "j22_route_calls": with_("edg") + " SELECT DISTINCT project_id, source_file, target_id FROM edg e WHERE kind = 'calls' AND resolution IN ('resolved', 'resolved_lsp', 'exact', 'import') AND EXISTS (SELECT 1 FROM edg r WHERE r.kind = 'routes_to' AND r.project_id = e.project_id AND r.source_file = e.source_file)",
    "u03_merged_scan": with_("fil", "txt") + " SELECT project_id, path, content_hash, 'index' AS origin FROM fil f WHERE NOT EXISTS (SELECT 1 FROM txt t WHERE t.project_id = f.project_id AND t.path = f.path) UNION ALL SELECT project_id, path, sha256(content), 'scan' FROM txt",
    "u06_snapshot_difference": with_("fil", "txt") + " SELECT project_id, path FROM fil EXCEPT ALL SELECT project_id, path FROM txt",
    "g11_invalidated": with_("fil", "txt", "edg") + f", {_STATE}, t AS (SELECT project_id, path FROM state WHERE state <> 'fresh') SELECT project_id, path FROM t UNION SELECT e.project_id, e.source_file FROM edg e JOIN t ON t.project_id = e.project_id AND t.path = e.target_file WHERE e.source_file IS NOT NULL",
    "a01_index_status": with_("fil", "sym", "edg", "chk", "txt") + f", {_STATE}, st AS (SELECT project_id, count(*) FILTER (WHERE state = 'fresh') AS fresh, count(*) FILTER (WHERE state = 'stale') AS stale, count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state = 'deleted') AS deleted FROM state GROUP BY ALL) SELECT p.project_id, index_generation, semantic_fresh, " + ", ".join(f"coalesce({n}, 0) AS {n}" for n in ("files", "symbols", "edges", "chunks", "skipped", "fresh", "stale", "pending", "deleted")) + " FROM projects p" + "".join(f" LEFT JOIN (SELECT project_id, count(*) AS {n} FROM {t} GROUP BY ALL) USING (project_id)" for n, t in (("files", "fil"), ("symbols", "sym"), ("edges", "edg"), ("chunks", "chk"), ("skipped", "(SELECT DISTINCT project_id, file_path FROM skipped_files)"))) + " LEFT JOIN st USING (project_id)",
    "a02_symbols_per_language": with_("sym") + " SELECT language, kind, count(*) AS symbols, count(*) FILTER (WHERE exported) AS exported FROM sym GROUP BY ALL",
    "a13_callers_and_tests": with_("edg", "sym") + " SELECT s.project_id, s.id, coalesce(c.n, 0) AS callers, coalesce(t.n, 0) AS tests FROM sym s LEFT JOIN (SELECT project_id, target_id, count(*) AS n FROM edg WHERE kind = 'calls' GROUP BY ALL) c ON c.project_id = s.project_id AND c.target_id = s.id LEFT JOIN (SELECT project_id, source_id, count(*) AS n FROM edg WHERE kind = 'tested_by' GROUP BY ALL) t ON t.project_id = s.project_id AND t.source_id = s.id WHERE s.kind <> 'file'",
    "a14_duplicate_groups": "SELECT body_fingerprint, count(*) AS symbols, count(DISTINCT project_id) AS projects, min(symbol_id) AS first_symbol FROM (SELECT DISTINCT symbol_id, project_id, body_fingerprint FROM symbol_structures WHERE body_fingerprint IS NOT NULL) GROUP BY 1 HAVING count(*) > 1",
    "a17_warnings": "WITH w AS (SELECT DISTINCT * FROM analysis_warnings), s AS (SELECT DISTINCT kind, message, unnest(samples) AS s FROM w), f AS (SELECT kind, message, string_agg(s, ';' ORDER BY s) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY kind, message ORDER BY s) AS r FROM s WHERE s IS NOT NULL) WHERE r <= 8 GROUP BY ALL) SELECT b.kind, b.message, b.occurrences, f.samples FROM (SELECT kind, message, sum(occurrences)::BIGINT AS occurrences FROM w GROUP BY ALL) b LEFT JOIN f USING (kind, message)",
    "a23_incident_kinds": with_("edg", "sym") + f", {_ENDS} SELECT file, string_agg(kind, ',' ORDER BY s DESC, kind) AS kinds FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY s DESC, kind) AS r FROM (SELECT DISTINCT file, kind, {_STRENGTH} AS s FROM (SELECT source_file AS file, kind FROM ends UNION ALL SELECT target_file, kind FROM ends) WHERE file IS NOT NULL)) WHERE r <= 3 GROUP BY file",
    "a24_repeated_edges": "SELECT project_id, kind, count(*) AS edges, sum(n - 1)::BIGINT AS repeats FROM (SELECT " + ", ".join(T.EDGE_COLUMNS) + ", count(*) AS n FROM edges GROUP BY ALL) GROUP BY ALL",
}
