"""Targets, seeds, node references, definitions, merged nodes and reasons."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import text as X
from orrery.functions.paths import is_test, slashes
from orrery.operators import graph as G
from orrery.operators import relations as R
from orrery.operators.subgraph import role_rank
from orrery.plans.graphs import VERIFIED
from orrery.sources import tables as T
from orrery.sources.tables import with_

#: A question's words, looked up as names and paths.
SEED = "packet"


def parse_target(target: str) -> tuple[str | None, str]:
    """(path, name) of `path:name` or `path#name`; (None, target) of free text."""
    t = target.strip().replace("\\", "/")
    at = max(t.rfind(":"), t.rfind("#"))
    if 0 < at < len(t) - 1:
        path, name = t[:at], t[at + 1 :]
        if "/" in path or re.search(r"\.[A-Za-z0-9]+$", path):
            return path, name
    return None, t


def matches_target(path, name, target: str):
    """Whether a symbol is meant: by path (or its end) and exact name, or by part of its name or path."""
    p, n = parse_target(target)
    if p is not None:
        return ((path == p) | path.endswith("/" + p)) & (name == n)
    return F.contains(F.lower(name), F.lit(target.lower())) | F.contains(path, F.lit(n))


def pred02_qualified_targets(spark: SparkSession, d: str) -> DataFrame:
    """Every function as a `path:name` reference of its last two segments, and how many symbols that means."""
    s = T.symbols(spark, d).where("kind = 'function'").select("project_id", "id", "file_path", "name")
    tail = F.regexp_extract("file_path", r"([^/]+/[^/]+)$", 1)
    r = s.select("project_id", F.concat_ws(":", tail, "name").alias("ref"))
    return r.groupBy("project_id", "ref").agg(F.count(F.lit(1)).alias("symbols"))


def pred04_incoming(spark: SparkSession, d: str) -> DataFrame:
    """Edges into what a free-text target means, by symbol or by the name on the edge."""
    e, s = T.edges(spark, d), T.symbols(spark, d)
    m = s.where(matches_target(F.col("file_path"), F.col("name"), SEED)).select("project_id", F.col("id").alias("target_id"), F.lit(True).alias("y"))
    hit = e.join(m, ["project_id", "target_id"], "left").where(F.col("y") | F.contains(F.lower("target_name"), F.lit(SEED)))
    return hit.select("edge_seq", "project_id", "kind", "target_name")


def pred12_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Per project, the symbols a question starts from: exact names before partial ones, of these the best eight."""
    s = T.symbols(spark, d)
    exact = F.lower("name") == SEED
    part = F.contains(F.lower("name"), F.lit(SEED)) | F.contains(F.lower("file_path"), F.lit(SEED))
    c = s.where(exact | part).withColumn("exact", exact)
    any_exact = F.max("exact").over(Window.partitionBy("project_id"))
    r = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc(F.coalesce("exported", F.lit(False))), (F.col("kind") == "file"), "file_path", F.coalesce("start_line", F.lit(-1)), "id"))
    c = c.withColumn("_any", any_exact).where(F.col("exact") | ~F.col("_any")).withColumn("rank", r)
    return c.where(F.col("exact") | (F.col("rank") <= 8)).select("project_id", "id", "rank")


def pred13_node_references(spark: SparkSession, d: str) -> DataFrame:
    """`path:name` of each chunk, every other one with the last two segments of its path only, resolved to a symbol."""
    path = slashes(F.col("file_path"))
    tail = F.when(F.col("start_line") % 2 == 0, F.regexp_extract(path, r"([^/]+/[^/]+)$", 1)).otherwise(path)
    c = T.chunks(spark, d, "project_id", "file_path", "symbol_name", "start_line").select("project_id", F.col("id").alias("ref"), tail.alias("path"), F.col("symbol_name").alias("name"))
    return R.resolve_references(c, T.symbols(spark, d)).withColumnRenamed("ref", "chunk_id")


def j12_definitions(spark: SparkSession, d: str) -> DataFrame:
    """The symbol that a call with a known target file means: of its name there, the narrowest."""
    e = T.edges(spark, d).where("kind = 'calls' AND target_file IS NOT NULL AND target_name IS NOT NULL").select("project_id", "edge_seq", F.col("target_file").alias("file_path"), F.col("target_name").alias("name"))
    s = T.symbols(spark, d).where("kind <> 'file' AND end_line >= start_line").select("project_id", "file_path", "name", "id", (F.col("end_line") - F.col("start_line")).alias("span"))
    best = F.min(F.struct("span", "id")).alias("b")
    return e.join(s, ["project_id", "file_path", "name"]).groupBy("edge_seq").agg(best).select("edge_seq", F.col("b.id").alias("definition_id"))


def j16_term_matches(spark: SparkSession, d: str) -> DataFrame:
    """How many terms of a question each symbol's text holds, as whole tokens."""
    terms = ["lane", "mailbox", "policy"]
    s = T.symbols(spark, d).where("kind <> 'file'")
    n = X.count_true([X.contains_any_variant(X.searchable(F.col("name"), F.col("file_path")), t) for t in terms])
    return s.select("project_id", "id", n.alias("matched")).where("matched > 0")


def x12_hit_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why a chunk is a hit: the terms it holds, and whether its name, its path or its text does."""
    c = T.chunks(spark, d, "file_path", "symbol_name", "content")
    low = F.lower(F.concat_ws("\n", "file_path", "symbol_name", "content"))
    terms = ["harbor", "ledger", "session"]
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), t) for t in terms]))
    any_in = lambda col: X.count_true([F.contains(F.lower(col), F.lit(t)) for t in terms]) > 0
    kind = F.when(any_in("symbol_name"), "exact").when(any_in("file_path"), "fuzzy").otherwise("semantic")
    return c.select("id", F.array_join(found, ",").alias("terms"), kind.alias("match")).where("terms <> ''")


def g06_merged_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Ends of edges as nodes, each with its strongest role and surest edge."""
    v = G.verified(T.edges(spark, d), T.symbols(spark, d))
    k = F.col("kind")
    role = F.when(k == "tested_by", "test").when(k.isin("calls_api", "routes_to", "handles_webhook"), "route").when(k == "uses_middleware", "middleware").when(k.isin("reads_from", "writes_to"), "resource").when(k == "handles_event", "event").otherwise("callee")
    sure = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    ends = v.select("project_id", F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit("caller").alias("role"), sure.alias("sure")), F.struct(F.col("target_id").alias("id"), role.alias("role"), sure.alias("sure")))).alias("x"))
    strongest = F.min(F.struct(role_rank(F.col("x.role")).alias("o"), F.col("x.role").alias("role"))).alias("r")
    return ends.where("x.id IS NOT NULL").groupBy("project_id", "x.id").agg(strongest, F.max("x.sure").alias("sure"), F.count(F.lit(1)).alias("edges")).select("project_id", "id", "r.role", "sure", "edges")


def u05_distinct_paths(spark: SparkSession, d: str) -> DataFrame:
    """All paths that edges speak of, with how many projects know each."""
    e = T.edges(spark, d)
    p = e.select("project_id", F.explode(F.array_compact(F.array("source_file", "target_file", "file_path"))).alias("path")).distinct()
    return p.groupBy("path").agg(F.count(F.lit(1)).alias("projects"))


def u07_test_overlap(spark: SparkSession, d: str) -> DataFrame:
    """For each file with tests: the share of its importers that are tests."""
    e = T.edges(spark, d).where("kind = 'imports' AND source_file IS NOT NULL AND target_file IS NOT NULL").select("project_id", "target_file", "source_file").distinct()
    g = e.groupBy("project_id", "target_file").agg(F.count(F.lit(1)).alias("importers"), F.count_if(is_test(F.col("source_file"))).alias("tests"))
    return g.where("tests > 0").select("project_id", "target_file", "importers", "tests", F.round(F.col("tests") / F.col("importers"), 6).alias("share"))


def q08_explain_files(spark: SparkSession, d: str) -> DataFrame:
    """Per file: symbols, exported ones, edges in and out."""
    s = T.symbols(spark, d).where("kind <> 'file' AND file_path IS NOT NULL").groupBy("project_id", F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("symbols"), F.count_if("exported").alias("exported"))
    e = R.endpoints(T.edges(spark, d), T.symbols(spark, d))
    o = e.where("source_file IS NOT NULL").groupBy("project_id", F.col("source_file").alias("path")).agg(F.count(F.lit(1)).alias("edges_out"))
    i = e.where("target_file IS NOT NULL").groupBy("project_id", F.col("target_file").alias("path")).agg(F.count(F.lit(1)).alias("edges_in"))
    return s.join(o, ["project_id", "path"], "left").join(i, ["project_id", "path"], "left").fillna(0, ["edges_out", "edges_in"])


QUERIES = {k: v for k, v in list(globals().items()) if re.match(r"([jxguq]|pred)\d\d_", k)}

_ENDS = "ends AS (SELECT e.project_id, coalesce(s.file_path, e.source_file) AS sf, coalesce(t.file_path, e.target_file) AS tf FROM edg e LEFT JOIN sym s ON s.project_id = e.project_id AND s.id = e.source_id LEFT JOIN sym t ON t.project_id = e.project_id AND t.id = e.target_id)"
_TEST = r"(^|/)(__tests__|tests?)(/|$)|\.(test|spec)\.[jt]sx?$"
_SPLIT = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(r, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda p: p <> '')"


def _terms(terms: list[str]) -> str:
    return " + ".join("(" + " OR ".join(f"regexp_matches(t, '{X.term_pattern(v)}')" for v in X.variants([t])) + ")::INT" for t in terms)


ORACLE = {
    "pred02_qualified_targets": with_("sym") + r" SELECT project_id, concat_ws(':', regexp_extract(file_path, '([^/]+/[^/]+)$', 1), name) AS ref, count(*) AS symbols FROM sym WHERE kind = 'function' GROUP BY ALL",
    "pred04_incoming": with_("edg", "sym") + f" SELECT edge_seq, project_id, kind, target_name FROM edg e WHERE contains(lower(target_name), '{SEED}') OR EXISTS (SELECT 1 FROM sym s WHERE s.project_id = e.project_id AND s.id = e.target_id AND (contains(lower(s.name), '{SEED}') OR contains(s.file_path, '{SEED}')))",
    "pred12_seeds": with_("sym") + f", c AS (SELECT *, lower(name) = '{SEED}' AS exact FROM sym WHERE contains(lower(name), '{SEED}') OR contains(lower(file_path), '{SEED}')), a AS (SELECT *, bool_or(exact) OVER (PARTITION BY project_id) AS any_exact FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY coalesce(exported, false) DESC, kind = 'file', file_path NULLS FIRST, coalesce(start_line, -1), id) AS rank FROM a WHERE exact OR NOT any_exact) SELECT project_id, id, rank::INT AS rank FROM r WHERE exact OR rank <= 8",
    "pred13_node_references": with_("sym", "chk") + r""", c AS (SELECT project_id, id AS chunk_id, symbol_name AS name, CASE WHEN start_line % 2 = 0 THEN regexp_extract(replace(file_path, chr(92), '/'), '([^/]+/[^/]+)$', 1) ELSE replace(file_path, chr(92), '/') END AS path FROM chk),
j AS (SELECT c.chunk_id, s.id AS symbol_id, coalesce(s.start_line, 0) AS l, CASE WHEN s.file_path = c.path THEN 0 ELSE 2 END + CASE WHEN s.name = c.name THEN 1 WHEN s.kind = 'file' THEN 2 END AS tier
  FROM c JOIN sym s ON s.project_id = c.project_id AND (s.file_path = c.path OR ends_with(s.file_path, '/' || c.path)))
SELECT chunk_id, symbol_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY tier, l, symbol_id) AS r FROM j WHERE tier IS NOT NULL) WHERE r = 1""",
    "j12_definitions": with_("edg", "sym") + " SELECT edge_seq, definition_id FROM (SELECT e.edge_seq, s.id AS definition_id, row_number() OVER (PARTITION BY e.edge_seq ORDER BY s.end_line - s.start_line, s.id) AS r FROM edg e JOIN sym s ON s.project_id = e.project_id AND s.file_path = e.target_file AND s.name = e.target_name WHERE e.kind = 'calls' AND s.kind <> 'file' AND s.end_line >= s.start_line) WHERE r = 1",
    "j16_term_matches": with_("sym") + f", t AS (SELECT project_id, id, lower(r) || chr(10) || array_to_string({_SPLIT}, ' ') AS t FROM (SELECT project_id, id, concat_ws(chr(10), nullif(name, ''), nullif(file_path, '')) AS r FROM sym WHERE kind <> 'file')) SELECT * FROM (SELECT project_id, id, ({_terms(['lane', 'mailbox', 'policy'])}) AS matched FROM t) WHERE matched > 0",
    "x12_hit_reasons": with_("chk") + ", r AS (SELECT id, array_to_string(list_filter(['harbor', 'ledger', 'session'], lambda t: contains(lower(concat_ws(chr(10), file_path, symbol_name, content)), t)), ',') AS terms, CASE WHEN regexp_matches(lower(coalesce(symbol_name, '')), 'harbor|ledger|session') THEN 'exact' WHEN regexp_matches(lower(file_path), 'harbor|ledger|session') THEN 'fuzzy' ELSE 'semantic' END AS match FROM chk) SELECT * FROM r WHERE terms <> ''",
    "u05_distinct_paths": with_("edg") + " SELECT path, count(*) AS projects FROM (SELECT project_id, source_file AS path FROM edg UNION SELECT project_id, target_file FROM edg UNION SELECT project_id, file_path FROM edg) WHERE path IS NOT NULL GROUP BY path",
    "u07_test_overlap": with_("edg") + f" SELECT *, round(tests / importers, 6) AS share FROM (SELECT project_id, target_file, count(*) AS importers, count(*) FILTER (WHERE regexp_matches(lower(source_file), '{_TEST}')) AS tests FROM (SELECT DISTINCT project_id, target_file, source_file FROM edg WHERE kind = 'imports' AND source_file IS NOT NULL AND target_file IS NOT NULL) GROUP BY ALL) WHERE tests > 0",
    "q08_explain_files": with_("edg", "sym") + f", {_ENDS} SELECT s.project_id, s.path, s.symbols, s.exported, coalesce(o.n, 0) AS edges_out, coalesce(i.n, 0) AS edges_in FROM (SELECT project_id, file_path AS path, count(*) AS symbols, count(*) FILTER (WHERE exported) AS exported FROM sym WHERE kind <> 'file' AND file_path IS NOT NULL GROUP BY ALL) s LEFT JOIN (SELECT project_id, sf, count(*) AS n FROM ends GROUP BY ALL) o ON o.project_id = s.project_id AND o.sf = s.path LEFT JOIN (SELECT project_id, tf, count(*) AS n FROM ends GROUP BY ALL) i ON i.project_id = s.project_id AND i.tf = s.path",
}
ORACLE["g06_merged_nodes"] = (
    with_("edg", "sym")
    + f""", {VERIFIED}, n AS (SELECT project_id, source_id AS id, 'caller' AS role, confidence FROM ver UNION ALL SELECT project_id, target_id, CASE WHEN kind = 'tested_by' THEN 'test' WHEN kind IN ('calls_api', 'routes_to', 'handles_webhook') THEN 'route' WHEN kind = 'uses_middleware' THEN 'middleware' WHEN kind IN ('reads_from', 'writes_to') THEN 'resource' WHEN kind = 'handles_event' THEN 'event' ELSE 'callee' END, confidence FROM ver)
SELECT project_id, id, arg_min(role, (CASE role WHEN 'target' THEN '0' WHEN 'caller' THEN '1' WHEN 'route' THEN '2' WHEN 'callee' THEN '3' WHEN 'test' THEN '4' ELSE '5' END) || role) AS role, max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)::INT AS sure, count(*) AS edges FROM n WHERE id IS NOT NULL GROUP BY ALL"""
)
