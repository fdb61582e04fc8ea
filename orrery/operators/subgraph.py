"""The verified subgraph around a seed: a capped best-first walk, its nodes, edges and paths, and what they vouch for.

Joins cut each seed's neighbourhood to what the walk could ever select; the walk itself, whose result depends on the
order of visits, runs on that bounded neighbourhood; names, files and evidence are joined to the few rows it selects.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.graph import verified
from orrery.operators.relations import RESOLVED
from orrery.session import cut

#: Kinds of edges that a subgraph walks, and those of them that are flow.
SUBGRAPH_KINDS = ["calls", "calls_api", "routes_to", "tested_by", "uses_middleware", "handles_webhook", "handles_event", "reads_from", "writes_to", "references", "imports", "exports", "contains"]
FLOW_KINDS = ["calls", "calls_api", "routes_to", "handles_webhook", "handles_event", "uses_middleware", "reads_from", "writes_to"]
INBOUND_KINDS = ["calls", "calls_api", "routes_to"]
#: The role that an edge gives its target, the order of roles and of edge kinds, and the limits of the walk.
TARGET_ROLES = {
    "tested_by": "test", "calls_api": "route", "routes_to": "route", "handles_webhook": "route", "uses_middleware": "middleware", "reads_from": "resource", "writes_to": "resource", "handles_event": "event",
}
ROLE_ORDER = ["target", "caller", "route", "callee", "test"]
KIND_ORDER = ["calls_api", "routes_to", "calls", "tested_by"]
MOST_NODES, MOST_EDGES, MOST_HOPS, MOST_PATHS = 32, 48, 4, 12
#: Fixed wording: why a node is there, by its role; and why an edge is believed, by what vouches for it.
NODE_REASONS = {
    "target": "Primary target or target-side graph endpoint.", "caller": "Incoming caller discovered through graph traversal.", "test": "Related test discovered through tested_by edge.",
    "route": "Route/API endpoint discovered through framework topology.", "middleware": "Middleware discovered through framework topology.", "resource": "Data resource discovered through static resource topology.",
    "event": "Event owner discovered through static event topology.", "callee": "Outgoing dependency discovered through graph traversal.",
}
SEED_REASON = "Matched primary seed symbol."
EDGE_REASONS = {
    "lsp": "Resolved TypeScript Language Service edge with line evidence where available.", "test_import": "Test coverage edge derived from a resolved test import.",
    "framework_rule": "Framework topology rule produced this edge.", "resource_rule": "Static resource access rule produced this edge.", "event_rule": "Static event subscription rule produced this edge.",
    "heuristic": "Heuristic or unresolved graph edge; verify before editing.",
}

_SURE = {"high": 3, "medium": 2, "low": 1}
WALK = "project_id string, seed string, flow boolean, part string, place int, edge_seq long, hops int, node string, role string, end string, surety int, path array<string>, truncated boolean"


def _case(column: Column, table: dict, otherwise) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise(otherwise)


def role_rank(role: Column) -> Column:
    return _case(role, {r: i for i, r in enumerate(ROLE_ORDER)}, len(ROLE_ORDER))


def walkable(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Verified edges that a subgraph may walk: of its kinds, with both ends, and no call that leads nowhere."""
    v = verified(edges, symbols).where(F.col("kind").isin(*SUBGRAPH_KINDS) & F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    lost = (F.col("kind") == "calls") & ~F.col("known") & ~F.coalesce(F.col("resolution").isin(*RESOLVED), F.lit(False)) & F.col("target_file").isNull()
    return v.where(~lost)


def walks(edges: DataFrame, seeds: DataFrame, flow: bool = False, hops: int = MOST_HOPS, fan: int = MOST_NODES + 2 * MOST_EDGES) -> DataFrame:
    """WALK rows of the best-first walk from each seed (project_id, id) over `walkable` edges: those selected, and their nodes.

    Cheapest way first, at most 32 nodes and 48 edges; with `flow` edges are walked forward only. A seed without edges is a
    node alone; null seeds have no row, repeated ones count once. The neighbourhood per node is its `fan` cheapest edges, and
    per hop of a seed the `fan` cheapest nodes: the walk selects fewer than that of either.
    """
    cols = ["project_id", "edge_seq", "source_id", "target_id", "kind", "confidence", "cost"]
    v = edges.select(*cols)
    ways = v.select(*cols, F.col("source_id").alias("node"), F.col("target_id").alias("next"))
    if not flow:
        ways = ways.union(v.select(*cols, F.col("target_id"), F.col("source_id")))
    cheapest = F.row_number().over(Window.partitionBy("project_id", "node").orderBy("cost", "kind", "edge_seq"))
    ways = cut(ways.withColumn("r", cheapest).where(F.col("r") <= fan).drop("r"))
    front = seeds.where("id IS NOT NULL").select("project_id", F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("total")).distinct()
    rest = ["node", "next", *cols[1:]]
    got = front.select("project_id", "seed", *[F.lit(None).cast(dict(ways.dtypes)[c]).alias(c) for c in rest])
    for _ in range(hops):
        step = cut(front.join(ways, ["project_id", "node"]))
        got = got.union(step.select("project_id", "seed", *rest))
        reached = step.groupBy("project_id", "seed", F.col("next").alias("node")).agg(F.min(F.col("total") + F.col("cost")).alias("total"))
        near = F.row_number().over(Window.partitionBy("project_id", "seed").orderBy("total", "node"))
        front = reached.withColumn("r", near).where(F.col("r") <= fan).drop("r")
    return got.groupBy("project_id", "seed").applyInPandas(lambda pdf: walk(pdf, hops, flow), WALK)


def walk(pdf: pd.DataFrame, hops: int = MOST_HOPS, flow: bool = False) -> pd.DataFrame:
    """The walk from one seed over its neighbourhood (rows of node, next and an edge; a row without an edge stands for the seed)."""
    project, seed = pdf["project_id"].iloc[0], pdf["seed"].iloc[0]
    ways: dict[str, list] = {}
    hood = pdf[pdf["edge_seq"].notna()].drop_duplicates(["node", "edge_seq", "next"]).sort_values(["cost", "kind", "edge_seq"], kind="stable")
    for way in hood.itertuples(index=False):
        ways.setdefault(way.node, []).append(way)
    nodes = {seed: {"role": "target", "surety": 3, "edge": None, "end": "seed"}}
    total, path = {seed: 0}, {seed: [seed]}
    picked: dict[int, int] = {}
    heap, full = [(0, 0, 0, seed)], False
    tick = 0
    while heap and not full:
        cost, _, depth, at = heapq.heappop(heap)
        if depth >= hops or cost > total[at]:
            continue
        for way in ways.get(at, ()):
            forward = way.node == way.source_id and way.next == way.target_id
            new = [e for e in dict.fromkeys((way.source_id, way.target_id)) if e not in nodes]
            if len(picked) >= MOST_EDGES or new and len(nodes) >= MOST_NODES:
                full = True
                break
            sure = _SURE[way.confidence]
            for end in (way.source_id, way.target_id):
                if end not in nodes:
                    role = ("target" if end == way.source_id else TARGET_ROLES.get(way.kind, "callee")) if forward else ("caller" if end == way.source_id else "target")
                    nodes[end] = {"role": role, "surety": sure, "edge": way.edge_seq, "end": "source" if end == way.source_id else "target"}
                nodes[end]["surety"] = max(nodes[end]["surety"], sure)
            picked.setdefault(int(way.edge_seq), depth + 1)
            further, way_there = cost + way.cost, path[at] + [way.next] if forward else [way.next] + path[at]
            if further < total.get(way.next, 1 << 60) or further == total[way.next] and len(way_there) < len(path[way.next]):
                total[way.next], path[way.next] = further, way_there
                tick += 1
                heapq.heappush(heap, (further, tick, depth + 1, way.next))
    rows = [(project, seed, flow, "edge", i, seq, depth, None, None, None, None, None, full) for i, (seq, depth) in enumerate(picked.items())]
    rows += [(project, seed, flow, "node", i, x["edge"], None, n, x["role"], x["end"], x["surety"], path.get(n), full) for i, (n, x) in enumerate(nodes.items())]
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in WALK.split(", ")])
    return out.astype({"edge_seq": "Int64", "hops": "Int32", "surety": "Int32", "place": "int32"})


def edge_metadata(framework: Column, resolution: Column) -> Column:
    """What is noted of an edge as JSON, without what is null; null if nothing is."""
    return F.when(framework.isNotNull() | resolution.isNotNull(), F.to_json(F.struct(framework.alias("framework"), resolution.alias("resolution"))))


def subgraph_edges(walked: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """The selected edges in order: ends, kind, what vouches for them, how sure they are, why, and where."""
    s = symbols.select("project_id", F.col("id").alias("_id"), F.col("file_path").alias("_file"), F.col("name").alias("_name"))
    e = walked.where("part = 'edge'").select("project_id", "seed", "flow", "edge_seq", "hops", "truncated").join(edges, ["project_id", "edge_seq"])
    src, dst = (s.select("project_id", F.col("_id").alias(f"{x}_id"), F.col("_file").alias(f"_{x}_file"), F.col("_name").alias(f"_{x}_name")) for x in ("source", "target"))
    e = e.join(src, ["project_id", "source_id"], "left").join(dst, ["project_id", "target_id"], "left")
    reason = _case(F.col("vouched"), EDGE_REASONS, F.concat(F.lit("AST "), F.col("kind"), F.lit(" edge from indexed structure.")))
    length = walked.where("part = 'node'").select("project_id", "seed", F.col("node").alias("target_id"), F.size("path").alias("_way"))
    e = e.join(length, ["project_id", "seed", "target_id"], "left")
    label = F.concat_ws(" -> ", F.coalesce("_source_file", "source_file"), F.coalesce("_target_file", "target_file", "target_name"))
    order = Window.partitionBy("project_id", "seed").orderBy(F.coalesce("_way", F.lit(99)), _case(F.col("kind"), {k: i for i, k in enumerate(KIND_ORDER)}, len(KIND_ORDER)), label, "edge_seq")  # at most 48 rows
    return e.select(
        "project_id", "seed", "flow", F.row_number().over(order).alias("rank"), "edge_seq", F.col("source_id").alias("from_id"), F.col("target_id").alias("to_id"), "kind", "confidence", F.col("vouched").alias("source"), reason.alias("reason"),
        F.coalesce("_source_file", "source_file").alias("source_file"), F.coalesce("_target_file", "target_file").alias("target_file"), F.coalesce("_target_name", "target_name").alias("target_name"), "line",
        edge_metadata(F.col("framework"), F.col("resolution")).alias("metadata"), "cost", "hops", "truncated",
    )


def subgraph_nodes(walked: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """The nodes in order: role, reason, surety, the symbol they are (or `external`, placed by the edge that found them), and the way from the seed."""
    n = walked.where("part = 'node'").select("project_id", "seed", "flow", F.col("node").alias("id"), "role", "end", "surety", "path", "edge_seq", "truncated")
    s = symbols.select("project_id", "id", "file_path", "name", F.col("kind").alias("_kind"), "exported", "start_line", "end_line")
    found_by = edges.select("project_id", "edge_seq", "source_file", "target_file", "target_name", "line")
    n = n.join(s, ["project_id", "id"], "left").join(found_by, ["project_id", "edge_seq"], "left")
    placed = F.when(F.col("end") == "source", F.coalesce("source_file", "target_file")).otherwise(F.coalesce("target_file", "source_file"))
    n = n.withColumn("file", F.coalesce("file_path", placed, F.lit("external")))
    symbol = F.when(F.col("_kind").isNotNull(), F.when(F.col("_kind") != "file", F.col("name"))).when(F.col("end") == "target", F.col("target_name"))
    reason = F.when(F.col("end") == "seed", SEED_REASON).otherwise(_case(F.col("role"), NODE_REASONS, "Graph source endpoint."))
    order = Window.partitionBy("project_id", "seed").orderBy(role_rank(F.col("role")), F.coalesce(F.size("path"), F.lit(99)), "file", F.coalesce(symbol, F.lit("")), "id")  # at most 32 rows
    return n.select(
        "project_id", "seed", "flow", F.row_number().over(order).alias("rank"), "id", F.col("file").alias("file_path"), symbol.alias("symbol_name"), F.coalesce("_kind", F.lit("external")).alias("kind"), "role", reason.alias("reason"),
        _case(F.col("surety"), {3: "high", 2: "medium"}, "low").alias("confidence"), "exported", F.coalesce("start_line", "line").alias("line"), "path", "truncated",
    )


def subgraph_paths(nodes: DataFrame) -> DataFrame:
    """(project_id, seed, rank, path): the at most twelve longest ways as labels `file:symbol`."""
    label = F.concat_ws(":", "file_path", "symbol_name")
    named = nodes.select("project_id", "seed", F.col("id").alias("step"), label.alias("label"))
    steps = nodes.where(F.size("path") > 1).select("project_id", "seed", "id", F.posexplode("path").alias("at", "step")).join(named, ["project_id", "seed", "step"], "left")
    ways = steps.groupBy("project_id", "seed", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("label", "step").alias("l")))), lambda x: x["l"]).alias("p"))  # at most 32 steps
    text = F.array_join("p", " -> ")
    r = F.row_number().over(Window.partitionBy("project_id", "seed").orderBy(F.desc(F.size("p")), text, "id"))
    return ways.withColumn("rank", r).where(F.col("rank") <= MOST_PATHS).select("project_id", "seed", "rank", text.alias("path"))


def signals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per seed the six signals of coverage, how many passed, and the verdict and confidence that follow.

    `nodes` and `edges` are those of `subgraph_nodes` and `subgraph_edges`; a seed that is no symbol has no owner.
    """
    key = ["project_id", "seed"]
    n = lambda c: F.count_if(c)
    k = F.col("kind")
    e = edges.groupBy(*key).agg(
        F.count(F.lit(1)).alias("edges"), n(k.isin(*INBOUND_KINDS)).alias("inbound"), n(k.isin(*FLOW_KINDS)).alias("outbound"), n(k == "tested_by").alias("tested"),
        n((F.col("confidence") == "low") | (F.col("source") == "heuristic")).alias("unresolved"),
    )
    role = F.col("role")
    v = nodes.groupBy(*key).agg(
        F.bool_or("flow").alias("flow"), F.bool_or("truncated").alias("truncated"), F.bool_or((F.col("id") == F.col("seed")) & (F.col("kind") != "external")).alias("owner"), F.count(F.lit(1)).alias("nodes"),
        n(role == "caller").alias("callers"), n(role == "route").alias("routes"), n(role == "test").alias("tests"), n((role == "target") & F.coalesce("exported", F.lit(False))).alias("exported_targets"),
    )
    j = v.join(e, key, "left").fillna(0, ["edges", "inbound", "outbound", "tested", "unresolved"])
    state = lambda good, bad: F.when(good, "pass").otherwise(bad)
    said = {
        "primary_owner_found": state(F.col("owner"), "fail"), "inbound_callers_checked": state(F.col("flow") | (F.col("inbound") > 0), "partial"), "outbound_flow_checked": state(F.col("outbound") > 0, "partial"),
        "tests_checked": state(F.col("tested") > 0, "partial"), "unresolved_edges_present": state(F.col("unresolved") == 0, "fail"), "budget_truncated": state(~F.col("truncated"), "fail"),
    }
    j = j.withColumns(said)
    all_ = F.array(*said)
    count = lambda x: F.size(F.filter(all_, lambda s: s == x))
    j = j.withColumns({"passed": count("pass"), "partial": count("partial"), "failed": count("fail")})
    soft = (F.col("budget_truncated") == "fail").cast("int")
    verdict = F.when(F.col("failed") - soft > 0, "not_enough_context").when(F.col("truncated") | (F.col("partial") + soft > 1), "investigate_only").otherwise("safe_to_edit_after_reading")
    rest = F.array(*[c for c in said if c != "inbound_callers_checked"])
    confidence = F.when(F.col("failed") > 0, "low").when((F.col("edges") >= 2) & F.forall(rest, lambda s: s == "pass"), "high").otherwise("medium")
    return j.withColumns({"verdict": verdict, "confidence": confidence})


def explain(signalled: DataFrame) -> DataFrame:
    """Per seed the weighted risk of touching it, its level, and whether it may be edited."""
    score = (
        2 * F.col("callers") + 2 * F.col("routes") + 3 * F.col("exported_targets") + 3 * F.col("unresolved")
        + F.when(F.col("tests") == 0, 2).otherwise(0) + F.when(F.col("truncated"), 2).otherwise(0) + F.when(F.col("owner"), 0).otherwise(5)
    )
    risk = F.when(score >= 9, "high").when(score >= 4, "medium").otherwise("low")
    ready = F.when(F.col("verdict") == "not_enough_context", F.col("verdict")).when((risk == "high") | (F.col("unresolved") > 0), "investigate_only").otherwise(F.col("verdict"))
    return signalled.select("project_id", "seed", "callers", "routes", "tests", "exported_targets", "unresolved", "truncated", score.alias("risk_score"), risk.alias("risk"), ready.alias("edit_readiness"))


def why_files(nodes: DataFrame, edges: DataFrame, reasons: int = 6, evidence: int = 8) -> DataFrame:
    """Per seed and file of its nodes: roles in order, the best confidence, at most six reasons (the nodes' first) and eight edges."""
    key = ["project_id", "seed", "file_path"]
    sure = lambda c: _case(F.col(c), _SURE, 1)
    n = nodes.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_set(F.struct(role_rank(F.col("role")).alias("r"), "role"))), lambda x: x["role"]).alias("roles"), F.max(sure("confidence")).alias("n_sure"),
        F.array_sort(F.collect_list(F.struct("rank", "reason"))).alias("n_reasons"),
    )
    both = F.explode(F.array_distinct(F.array_compact(F.array("source_file", "target_file")))).alias("file_path")
    e = edges.select("project_id", "seed", both, "rank", "kind", "confidence", "reason").groupBy(*key).agg(
        F.max(sure("confidence")).alias("e_sure"), F.array_sort(F.collect_list(F.struct("rank", "reason", "kind"))).alias("e_rows")
    )  # at most 48 edges
    j = n.join(e, key, "left")
    none = F.array().cast("array<string>")
    all_reasons = F.array_distinct(F.concat(F.transform("n_reasons", lambda x: x["reason"]), F.coalesce(F.transform("e_rows", lambda x: x["reason"]), none)))
    kinds = F.coalesce(F.transform(F.slice("e_rows", 1, evidence), lambda x: x["kind"]), none)
    best = F.greatest("n_sure", F.coalesce("e_sure", F.lit(1)))
    return j.select(*key, F.array_join("roles", ",").alias("roles"), _case(best, {3: "high", 2: "medium"}, "low").alias("confidence"), F.array_join(F.slice(all_reasons, 1, reasons), " ").alias("reasons"), F.array_join(kinds, ",").alias("evidence"))
