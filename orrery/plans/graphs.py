"""Graph queries: distances, rerank, impact, tests, traces, verified subgraphs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import graph as G
from orrery.operators import subgraph as W
from orrery.plans.relations import _ENDS, _STRENGTH, strength
from orrery.plans.scans import TARGET
from orrery.sources import tables as T
from orrery.sources.tables import with_


def _graph(spark: SparkSession, d: str) -> DataFrame:
    return G.file_graph(T.edges(spark, d), T.symbols(spark, d, "file_path", "name"))


def g01_file_graph(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)


def g03_degrees(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return g.groupBy("project_id", "file").agg(F.count(F.lit(1)).alias("degree"), F.countDistinct("neighbour").alias("neighbours"))


def _distances(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return G.distances(g, g.groupBy("project_id").agg(F.min("file").alias("file")), strength)


def g02_distances(spark: SparkSession, d: str) -> DataFrame:
    """Up to three hops from the first file of each project."""
    return _distances(spark, d).select("project_id", "file", "hops", F.round("strength", 3).alias("strength"))


def g12_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk as a keyword hit of score 1, moved by its file's distance from the project's first file."""
    hits = T.chunks(spark, d, "project_id", "file_path", "language").select("project_id", "file_path", "language", F.lit("keyword").alias("source"), F.lit(1.0).alias("score")).distinct()
    r = G.rerank(hits, _distances(spark, d), False, "explain")
    return r.select("project_id", "file_path", "hops", F.round("adjustment", 6).alias("adjustment"), F.round("score", 6).alias("score"))


def a06_impact_pack(spark: SparkSession, d: str) -> DataFrame:
    return G.impact(TARGET, T.edges(spark, d), T.symbols(spark, d))[0]


def a07_impact_references(spark: SparkSession, d: str) -> DataFrame:
    return G.impact(TARGET, T.edges(spark, d), T.symbols(spark, d))[1]


def a08_impact_risk(spark: SparkSession, d: str) -> DataFrame:
    """Risk per project from how many files and references the target touches."""
    files, refs = G.impact(TARGET, T.edges(spark, d), T.symbols(spark, d))
    f = files.groupBy("project_id").agg(F.count(F.lit(1)).alias("files"))
    r = refs.groupBy("project_id").agg(F.count(F.lit(1)).alias("refs"))
    j = f.join(r, "project_id", "left").fillna(0, ["refs"])
    n = F.col("files") + F.col("refs")
    return j.select("project_id", "files", "refs", F.when(n > 12, "high").when(n > 4, "medium").otherwise("low").alias("risk"))


def g09_related_tests(spark: SparkSession, d: str) -> DataFrame:
    """Tests of each symbol by tested_by edges."""
    e = T.edges(spark, d).where("kind = 'tested_by'").select("project_id", F.col("source_id").alias("id"), "target_id")
    s = T.symbols(spark, d)
    t = s.select("project_id", F.col("id").alias("target_id"), F.col("file_path").alias("test_file"))
    return e.join(s.select("project_id", "id", "name"), ["project_id", "id"], "left_semi").join(t, ["project_id", "target_id"]).select("project_id", "id", "test_file").distinct()


def g10_trace_flow(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 edges out of what matches the target."""
    e = T.edges(spark, d).where(F.col("kind").isin("calls", "calls_api", "routes_to", "handles_webhook", "handles_event", "tested_by", "uses_middleware", "reads_from", "writes_to"))
    m = T.symbols(spark, d).where(F.contains(F.lower("name"), F.lit(TARGET)) | F.contains("file_path", F.lit(TARGET))).select("project_id", F.col("id").alias("source_id"), F.lit(True).alias("y"))
    hit = e.join(m, ["project_id", "source_id"], "left").where(F.col("y") | F.contains("source_file", F.lit(TARGET)))
    return hit.orderBy("edge_seq").limit(20).select("edge_seq", "project_id", "kind", "source_file", "target_name")


def a09_diff_review(spark: SparkSession, d: str) -> DataFrame:
    """Per project: stale files, files that depend on them, tests among those."""
    changed = T.files(spark, d).where("status = 'stale'").select("project_id", F.col("path").alias("neighbour"))
    g = _graph(spark, d).select("project_id", "file", "neighbour").distinct()
    hit = g.join(changed, ["project_id", "neighbour"], "left_semi").select("project_id", "file").distinct()
    from orrery.functions.paths import is_test

    n = changed.groupBy("project_id").agg(F.count(F.lit(1)).alias("changed"))
    i = hit.groupBy("project_id").agg(F.count(F.lit(1)).alias("impacted"), F.count_if(is_test(F.col("file"))).alias("tests"))
    j = n.join(i, "project_id", "left").fillna(0, ["impacted", "tests"])
    k = F.col("changed") + F.col("impacted")
    return j.withColumn("risk", F.when(k > 12, "high").when(k > 4, "medium").otherwise("low"))


#: How much a topology edge weighs, by its kind, else by how it was resolved.
TOPOLOGY_WEIGHTS = {"handles_webhook": 100, "calls_api": 90, "routes_to": 85, "uses_middleware": 84, "tested_by": 82, "writes_to": 78, "reads_from": 76, "handles_event": 74}
RESOLUTION_WEIGHTS = {"resolved_lsp": 80, "resolved": 75, "exact": 75}


def topology_edges(spark: SparkSession, d: str, most: int) -> DataFrame:
    """The weightiest topology edges of each project, with their rank."""
    from pyspark.sql import Window

    weight = lambda c, table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)
    e = T.edges(spark, d).where(F.col("kind").isin("calls", *TOPOLOGY_WEIGHTS) & F.col("source_file").isNotNull())
    e = e.withColumn("priority", F.coalesce(weight(F.col("kind"), TOPOLOGY_WEIGHTS), weight(F.col("resolution"), RESOLUTION_WEIGHTS), F.lit(20)))
    e = e.withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("priority"), "edge_seq"))).where(F.col("rank") <= most)
    return e.select("project_id", "edge_seq", "kind", "priority", "rank", "source_file", F.coalesce("target_name", "target_id").alias("to"))


def t04_topology_edges(spark: SparkSession, d: str) -> DataFrame:
    """The twelve weightiest topology edges of each project."""
    return topology_edges(spark, d, 12).drop("rank", "source_file")


def g05_verified_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges by what vouches for them and how sure they are."""
    v = G.verified(T.edges(spark, d), T.symbols(spark, d))
    return v.groupBy("kind", "vouched", "confidence", "cost").agg(F.count(F.lit(1)).alias("edges"))


def _walked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(walk, edges, symbols) around one function of each project."""
    from orrery.session import cut

    s = T.symbols(spark, d)
    seeds = s.where("kind = 'function' AND exported").groupBy("project_id").agg(F.min("id").alias("id"))
    e = W.walkable(T.edges(spark, d), s)
    return cut(W.walks(e, seeds)), e, s


def g04_subgraphs(spark: SparkSession, d: str) -> DataFrame:
    """The edges of the verified subgraph around one function of each project."""
    return W.subgraph_edges(*_walked(spark, d))


def t05_subgraph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of the subgraphs in order, with their roles and ways."""
    return W.subgraph_nodes(*_walked(spark, d)).withColumn("path", F.array_join("path", ","))


def g07_subgraph_paths(spark: SparkSession, d: str) -> DataFrame:
    """The longest ways of the subgraphs as labels."""
    return W.subgraph_paths(W.subgraph_nodes(*_walked(spark, d)))


def a10_explain_impact(spark: SparkSession, d: str) -> DataFrame:
    w = _walked(spark, d)
    return W.explain(W.signals(W.subgraph_nodes(*w), W.subgraph_edges(*w)))


def a11_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The six signals of each subgraph and the verdict."""
    w = _walked(spark, d)
    return W.signals(W.subgraph_nodes(*w), W.subgraph_edges(*w))


def a12_why_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of each subgraph with their roles, reasons and evidence."""
    w = _walked(spark, d)
    return W.why_files(W.subgraph_nodes(*w), W.subgraph_edges(*w))


def pred07_walkable_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that a subgraph walks, by kind, and whether the kind is flow."""
    e = W.walkable(T.edges(spark, d), T.symbols(spark, d))
    return e.groupBy("project_id", "kind").agg(F.count(F.lit(1)).alias("edges")).withColumn("flow", F.col("kind").isin(*W.FLOW_KINDS))


def pred19_edge_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What is noted of each edge, as JSON without nulls."""
    e = T.edges(spark, d).select("edge_seq", W.edge_metadata(F.col("framework"), F.col("resolution")).alias("metadata"))
    return e.where("metadata IS NOT NULL")


QUERIES = {k: v for k, v in list(globals().items()) if re.match(r"([agt]|pred)\d\d_", k)}

_G = f"{_ENDS}, gr AS (SELECT DISTINCT project_id, file, neighbour, kind FROM (SELECT project_id, source_file AS file, target_file AS neighbour, kind FROM ends UNION ALL SELECT project_id, target_file, source_file, kind FROM ends) WHERE file IS NOT NULL AND neighbour IS NOT NULL AND file <> neighbour)"
_HOP = "h{n} AS (SELECT g.project_id, g.neighbour AS file, {n} AS hops, max(greatest(h.strength, g.w)) AS strength FROM h{p} h JOIN gw g ON g.project_id = h.project_id AND g.file = h.file WHERE NOT EXISTS (SELECT 1 FROM ({seen}) x WHERE x.project_id = g.project_id AND x.file = g.neighbour) GROUP BY ALL)"


def _hops() -> str:
    out = [f"gw AS (SELECT project_id, file, neighbour, max({_STRENGTH}) AS w FROM gr GROUP BY ALL)", "h0 AS (SELECT project_id, file, 0 AS hops, max(w) AS strength FROM gw WHERE (project_id, file) IN (SELECT (project_id, min(file)) FROM gr GROUP BY project_id) GROUP BY ALL)"]
    for n in (1, 2, 3):
        out.append(_HOP.format(n=n, p=n - 1, seen=" UNION ALL ".join(f"SELECT project_id, file FROM h{k}" for k in range(n))))
    out.append("di AS (" + " UNION ALL ".join(f"SELECT * FROM h{k}" for k in range(4)) + ")")
    return ", ".join(out)


_TESTY = r"(^|/)(__tests__|tests?)(/|$)|\.(test|spec)\.[jt]sx?$"
_NONIMPL = rf"regexp_matches(lower(file_path), '{_TESTY}') OR regexp_matches(lower(file_path), '(^|/)(__fixtures__|fixtures?|playground|examples?|samples?|demo)(/|$)') OR regexp_matches(lower(file_path), '(^|/)(docs?|documentation)(/|$)|\.mdx?$')"
_IMPACT = f"""m AS (SELECT project_id, id, file_path, name FROM sym WHERE contains(lower(name), '{TARGET}') OR contains(file_path, '{TARGET}')),
ie AS (SELECT * FROM (SELECT e.project_id, e.kind, e.target_name, e.source_file AS ss, e.target_file AS st, coalesce(a.file_path, e.source_file) AS source_file, coalesce(b.file_path, e.target_file) AS target_file,
  EXISTS (SELECT 1 FROM m WHERE m.project_id = e.project_id AND m.id = e.target_id) OR coalesce(contains(lower(e.target_name), '{TARGET}'), false) AS into_,
  EXISTS (SELECT 1 FROM m WHERE m.project_id = e.project_id AND m.id = e.source_id) OR coalesce(e.source_file = '{TARGET}' OR e.source_file LIKE '%/{TARGET}', false) AS out_
  FROM edg e LEFT JOIN sym a ON a.project_id = e.project_id AND a.id = e.source_id LEFT JOIN sym b ON b.project_id = e.project_id AND b.id = e.target_id) WHERE into_ OR out_),
ri AS (SELECT *, CASE WHEN kind IN ('calls_api', 'routes_to') THEN 'route' WHEN kind = 'tested_by' THEN 'test' WHEN kind = 'uses_middleware' THEN 'middleware' ELSE 'caller' END AS r_in,
  CASE WHEN kind = 'tested_by' THEN 'test' WHEN kind = 'uses_middleware' THEN 'middleware' WHEN kind IN ('reads_from', 'writes_to') THEN 'resource_owner' WHEN kind = 'handles_event' THEN 'event_owner' WHEN kind IN ('calls_api', 'routes_to') THEN 'route' ELSE 'callee' END AS r_out FROM ie),
it AS (
  SELECT project_id, source_file AS file, r_in AS role, 'Incoming ' || kind || ' reference to target.' AS reason FROM ri WHERE into_
  UNION ALL SELECT project_id, target_file, 'target', 'Target side of incoming ' || kind || ' reference.' FROM ri WHERE into_
  UNION ALL SELECT project_id, ss, CASE r_in WHEN 'test' THEN 'target' ELSE r_in END, 'Incoming ' || kind || ' metadata reference.' FROM ri WHERE into_
  UNION ALL SELECT project_id, st, r_in, 'Incoming ' || kind || ' metadata reference.' FROM ri WHERE into_
  UNION ALL SELECT project_id, source_file, 'target', 'Source side of outgoing ' || kind || ' reference.' FROM ri WHERE out_
  UNION ALL SELECT project_id, target_file, r_out, 'Outgoing ' || kind || ' reference from target.' FROM ri WHERE out_
  UNION ALL SELECT project_id, ss, CASE r_out WHEN 'test' THEN 'target' ELSE r_out END, 'Outgoing ' || kind || ' metadata reference.' FROM ri WHERE out_
  UNION ALL SELECT project_id, st, r_out, 'Outgoing ' || kind || ' metadata reference.' FROM ri WHERE out_
  UNION ALL SELECT project_id, file_path, 'target', 'Matched target symbol ' || name || '.' FROM m),
pk AS (SELECT project_id, file, arg_min(role, (CASE WHEN role = 'target' THEN '0' WHEN role = 'test' THEN '1' WHEN role IN ('caller', 'callee', 'route') THEN '2' ELSE '3' END) || role) AS role, arg_min(reason, lpad(length(reason)::VARCHAR, 6, '0') || reason) AS reason FROM it WHERE file IS NOT NULL GROUP BY ALL),
rf AS (SELECT project_id, kind, source_file, target_file, target_name, count(*) AS edges FROM ie GROUP BY ALL)"""
_RISK = "CASE WHEN {0} > 12 THEN 'high' WHEN {0} > 4 THEN 'medium' ELSE 'low' END"

ORACLE = {
    "g01_file_graph": with_("edg", "sym") + f", {_G} SELECT * FROM gr",
    "g03_degrees": with_("edg", "sym") + f", {_G} SELECT project_id, file, count(*) AS degree, count(DISTINCT neighbour) AS neighbours FROM gr GROUP BY ALL",
    "g02_distances": with_("edg", "sym") + f", {_G}, {_hops()} SELECT project_id, file, hops, round(strength, 3)::DOUBLE AS strength FROM di",
    "g12_rerank": with_("edg", "sym", "chk") + f", {_G}, {_hops()}, h AS (SELECT DISTINCT project_id, file_path, language FROM chk), a AS (SELECT h.project_id, h.file_path, d.hops, regexp_matches(lower(file_path), '{_TESTY}') AS test, d.strength FROM h LEFT JOIN di d ON d.project_id = h.project_id AND d.file = h.file_path), b AS (SELECT *, CASE WHEN hops IS NOT NULL AND NOT test THEN (CASE hops WHEN 0 THEN 1.0 WHEN 1 THEN 0.82 WHEN 2 THEN 0.52 ELSE 0.24 END) * 1.6 + strength * 0.42 WHEN test THEN -0.15 ELSE -0.25 END + CASE WHEN test THEN -0.25 ELSE 0 END AS adj FROM a) SELECT project_id, file_path, hops, round(adj, 6)::DOUBLE AS adjustment, round(greatest(0, 1 + adj), 6)::DOUBLE AS score FROM b",
    "a06_impact_pack": with_("edg", "sym") + f", {_IMPACT} SELECT * FROM pk",
    "a07_impact_references": with_("edg", "sym") + f", {_IMPACT} SELECT * FROM rf",
    "a08_impact_risk": with_("edg", "sym") + f", {_IMPACT} SELECT project_id, files, refs, {_RISK.format('files + refs')} AS risk FROM (SELECT f.project_id, f.files, coalesce(r.refs, 0) AS refs FROM (SELECT project_id, count(*) AS files FROM pk GROUP BY 1) f LEFT JOIN (SELECT project_id, count(*) AS refs FROM rf GROUP BY 1) r USING (project_id))",
    "g09_related_tests": with_("edg", "sym") + " SELECT DISTINCT e.project_id, s.id, t.file_path AS test_file FROM edg e JOIN sym s ON s.project_id = e.project_id AND s.id = e.source_id JOIN sym t ON t.project_id = e.project_id AND t.id = e.target_id WHERE e.kind = 'tested_by'",
    "g10_trace_flow": with_("edg", "sym") + f" SELECT edge_seq, project_id, kind, source_file, target_name FROM edg e WHERE kind IN ('calls', 'calls_api', 'routes_to', 'handles_webhook', 'handles_event', 'tested_by', 'uses_middleware', 'reads_from', 'writes_to') AND (EXISTS (SELECT 1 FROM sym s WHERE s.project_id = e.project_id AND s.id = e.source_id AND (contains(lower(s.name), '{TARGET}') OR contains(s.file_path, '{TARGET}'))) OR contains(source_file, '{TARGET}')) ORDER BY edge_seq LIMIT 20",
    "a09_diff_review": with_("edg", "sym", "fil") + f", {_G}, c AS (SELECT project_id, path FROM fil WHERE status = 'stale'), h AS (SELECT DISTINCT g.project_id, g.file FROM gr g JOIN c ON c.project_id = g.project_id AND c.path = g.neighbour) SELECT project_id, changed, impacted, tests, {_RISK.format('changed + impacted')} AS risk FROM (SELECT n.project_id, n.changed, coalesce(i.impacted, 0) AS impacted, coalesce(i.tests, 0) AS tests FROM (SELECT project_id, count(*) AS changed FROM c GROUP BY 1) n LEFT JOIN (SELECT project_id, count(*) AS impacted, count(*) FILTER (WHERE regexp_matches(lower(file), '{_TESTY}')) AS tests FROM h GROUP BY 1) i USING (project_id))",
    "t04_topology_edges": with_("edg") + ' SELECT project_id, edge_seq, kind, priority, "to" FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY priority DESC, edge_seq) AS r FROM (SELECT project_id, edge_seq, kind, coalesce(target_name, target_id) AS "to", CASE kind WHEN \'handles_webhook\' THEN 100 WHEN \'calls_api\' THEN 90 WHEN \'routes_to\' THEN 85 WHEN \'uses_middleware\' THEN 84 WHEN \'tested_by\' THEN 82 WHEN \'writes_to\' THEN 78 WHEN \'reads_from\' THEN 76 WHEN \'handles_event\' THEN 74 ELSE CASE WHEN resolution = \'resolved_lsp\' THEN 80 WHEN resolution IN (\'resolved\', \'exact\') THEN 75 ELSE 20 END END AS priority FROM edg WHERE source_file IS NOT NULL AND kind IN (\'calls\', \'calls_api\', \'routes_to\', \'handles_webhook\', \'handles_event\', \'tested_by\', \'uses_middleware\', \'reads_from\', \'writes_to\'))) WHERE r <= 12',
}

_OK = "resolution IN ('resolved', 'resolved_lsp', 'exact', 'import')"
VERIFIED = f"""vk AS (SELECT e.*, EXISTS (SELECT 1 FROM sym s WHERE s.project_id = e.project_id AND s.id = e.target_id) AS known FROM edg e),
vv AS (SELECT *, CASE WHEN resolution = 'resolved_lsp' THEN 'lsp' WHEN resolution IN ('resolved', 'exact') THEN 'ast' WHEN resolution IN ('test_import', 'import') AND kind = 'tested_by' THEN 'test_import' WHEN resolution = 'resource_static' THEN 'resource_rule' WHEN resolution = 'event_static' THEN 'event_rule'
  WHEN resolution IN ('framework_static', 'framework_call_graph') OR framework IS NOT NULL THEN 'framework_rule' WHEN kind IN ('imports', 'exports', 'contains') THEN 'ast' ELSE 'heuristic' END AS vouched FROM vk),
vc AS (SELECT *, CASE WHEN vouched IN ('lsp', 'test_import', 'framework_rule') THEN 'high' WHEN vouched = 'ast' AND (known OR coalesce({_OK}, false)) THEN 'high' WHEN vouched IN ('resource_rule', 'event_rule') AND line IS NOT NULL THEN 'medium' WHEN target_name IS NOT NULL OR target_file IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence FROM vv),
ver AS (SELECT *, greatest(1, 120 - CASE kind WHEN 'calls_api' THEN 100 WHEN 'routes_to' THEN 95 WHEN 'tested_by' THEN 90 WHEN 'handles_webhook' THEN 88 WHEN 'uses_middleware' THEN 84 WHEN 'writes_to' THEN 78 WHEN 'reads_from' THEN 76 WHEN 'handles_event' THEN 74
  ELSE CASE WHEN resolution = 'resolved_lsp' THEN 72 WHEN resolution IN ('resolved', 'exact', 'import') THEN 70 WHEN kind = 'calls' THEN 60 WHEN kind = 'contains' THEN 55 ELSE 20 END END - CASE confidence WHEN 'high' THEN 25 WHEN 'medium' THEN 12 ELSE 0 END)::INT AS cost FROM vc)"""
ORACLE["g05_verified_edges"] = with_("edg", "sym") + f", {VERIFIED} SELECT kind, vouched, confidence, cost, count(*) AS edges FROM ver GROUP BY ALL"
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
ORACLE["pred07_walkable_edges"] = (
    with_("edg", "sym")
    + f", {VERIFIED} SELECT project_id, kind, count(*) AS edges, kind IN ({_IN(W.FLOW_KINDS)}) AS flow FROM ver WHERE kind IN ({_IN(W.SUBGRAPH_KINDS)}) AND source_id IS NOT NULL AND target_id IS NOT NULL AND NOT (kind = 'calls' AND NOT known AND NOT coalesce({_OK}, false) AND target_file IS NULL) GROUP BY ALL"
)
ORACLE["pred19_edge_metadata"] = (
    with_("edg")
    + """ SELECT edge_seq, '{' || concat_ws(',', CASE WHEN framework IS NOT NULL THEN '"framework":' || to_json(framework)::VARCHAR END, CASE WHEN resolution IS NOT NULL THEN '"resolution":' || to_json(resolution)::VARCHAR END) || '}' AS metadata FROM edg WHERE framework IS NOT NULL OR resolution IS NOT NULL"""
)
