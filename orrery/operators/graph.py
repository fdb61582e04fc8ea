"""The file graph, bounded distances, rerank signals, what vouches for an edge, and impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.paths import evidence_class, is_test
from orrery.operators.relations import RESOLVED, endpoints
from orrery.session import cut


def file_graph(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project_id, file, neighbour, kind), both ways, distinct, without loops."""
    e = endpoints(edges, symbols).where("source_file IS NOT NULL AND target_file IS NOT NULL AND source_file <> target_file")
    both = F.explode(F.array(F.struct(F.col("source_file").alias("file"), F.col("target_file").alias("neighbour")), F.struct(F.col("target_file").alias("file"), F.col("source_file").alias("neighbour")))).alias("x")
    return e.select("project_id", "kind", both).select("project_id", "x.file", "x.neighbour", "kind").distinct()


def distances(graph: DataFrame, seeds: DataFrame, strength, hops: int = 3) -> DataFrame:
    """(project_id, file, hops, strength): fewest hops from any seed, and the strongest edge on a shortest way.

    One join per hop; a file is settled when first reached, which an anti-join with those before sees to. Seeds that have no
    neighbour are left out. `seeds` is (project_id, file).
    """
    g = cut(graph.groupBy("project_id", "file", "neighbour").agg(F.max(strength(F.col("kind"))).alias("w")))
    own = g.groupBy("project_id", "file").agg(F.max("w").alias("strength"))
    front = seeds.distinct().join(own, ["project_id", "file"]).select("project_id", "file", F.lit(0).alias("hops"), "strength")
    done = cut(front)
    front = done
    for h in range(1, hops + 1):
        step = front.join(g, ["project_id", "file"]).select("project_id", F.col("neighbour").alias("file"), F.greatest("strength", "w").alias("strength"))
        new = step.join(done.select("project_id", "file"), ["project_id", "file"], "left_anti").groupBy("project_id", "file").agg(F.max("strength").alias("strength"))
        front = cut(new.select("project_id", "file", F.lit(h).alias("hops"), "strength"))
        done = done.unionByName(front)
    return done


def rerank(hits: DataFrame, dist: DataFrame, query_asks_tests: bool, mode: str) -> DataFrame:
    """Hits (project_id, file_path, source, language, score) moved by their distance from the seeds and by what they are."""
    j = hits.join(dist.select("project_id", F.col("file").alias("file_path"), "hops", "strength"), ["project_id", "file_path"], "left")
    test = is_test(F.col("file_path"))
    wants_tests = query_asks_tests or mode in ("review", "debug")
    seen = F.col("hops").isNotNull() & (~test | F.lit(wants_tests))
    near = F.when(F.col("hops") == 0, 1.0).when(F.col("hops") == 1, 0.82).when(F.col("hops") == 2, 0.52).when(F.col("hops") == 3, 0.24).otherwise(0.0)
    off = (evidence_class(F.col("file_path")) != "implementation") | F.col("language").isin("markdown", "json") | F.col("source").isin("semantic", "keyword")
    move = F.when(seen, near * 1.6 + F.col("strength") * 0.42).when(off, F.when(test, -0.15).otherwise(-0.25)).otherwise(0.0)
    tests = F.when(test & F.col("hops").isNotNull() & F.lit(wants_tests), 0.45).when(test & F.lit(not wants_tests), -0.25).otherwise(0.0)
    kept = [c for c in hits.columns if c in ("id", "source")]
    return j.select(*kept, "project_id", "file_path", "hops", F.col("score").alias("before"), (move + tests).alias("adjustment"), F.greatest(F.lit(0.0), F.col("score") + move + tests).alias("score"))


#: The rules of the next three functions are fixed values.
def edge_source(kind: Column, resolution: Column, framework: Column) -> Column:
    """What vouches for an edge."""
    return (
        F.when(resolution == "resolved_lsp", "lsp").when(resolution.isin("resolved", "exact"), "ast").when(resolution.isin("test_import", "import") & (kind == "tested_by"), "test_import")
        .when(resolution == "resource_static", "resource_rule").when(resolution == "event_static", "event_rule").when(resolution.isin("framework_static", "framework_call_graph") | framework.isNotNull(), "framework_rule")
        .when(kind.isin("imports", "exports", "contains"), "ast").otherwise("heuristic")
    )


def edge_confidence(source: Column, resolution: Column, known_target: Column, line: Column, target_name: Column, target_file: Column) -> Column:
    return (
        F.when(source.isin("lsp", "test_import", "framework_rule"), "high").when((source == "ast") & (known_target | F.coalesce(resolution.isin(*RESOLVED), F.lit(False))), "high")
        .when(source.isin("resource_rule", "event_rule") & line.isNotNull(), "medium").when(target_name.isNotNull() | target_file.isNotNull(), "medium").otherwise("low")
    )


def edge_priority(kind: Column, resolution: Column) -> Column:
    """How early a kind of edge is walked (fixed values)."""
    table = {"calls_api": 100, "routes_to": 95, "tested_by": 90, "handles_webhook": 88, "uses_middleware": 84, "writes_to": 78, "reads_from": 76, "handles_event": 74}
    out = None
    for k, v in table.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out.when(resolution == "resolved_lsp", 72).when(resolution.isin("resolved", "exact", "import"), 70).when(kind == "calls", 60).when(kind == "contains", 55).otherwise(20)


def verified(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with what vouches for them, how sure they are, and what walking them costs."""
    known = symbols.select("project_id", F.col("id").alias("target_id"), F.lit(True).alias("known"))
    e = edges.join(known, ["project_id", "target_id"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    e = e.withColumn("vouched", edge_source(F.col("kind"), F.col("resolution"), F.col("framework")))
    e = e.withColumn("confidence", edge_confidence(F.col("vouched"), F.col("resolution"), F.col("known"), F.col("line"), F.col("target_name"), F.col("target_file")))
    discount = F.when(F.col("confidence") == "high", 25).when(F.col("confidence") == "medium", 12).otherwise(0)
    return e.withColumn("cost", F.greatest(F.lit(1), 120 - edge_priority(F.col("kind"), F.col("resolution")) - discount))


#: The wording of roles and reasons below is fixed.
def impact(target: str, edges: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, references) of a free-text target: every file with its strongest role and shortest reason, and the distinct edges."""
    low = target.lower()
    hit = symbols.where(F.contains(F.lower("name"), F.lit(low)) | F.contains("file_path", F.lit(target))).select("project_id", "id", "file_path", "name")
    ends = endpoints(edges.withColumns({"said_source": F.col("source_file"), "said_target": F.col("target_file")}), symbols)
    m = hit.select("project_id", F.col("id").alias("m"), F.lit(True).alias("y")).distinct()
    e = ends.join(m.select("project_id", F.col("m").alias("target_id"), F.col("y").alias("into")), ["project_id", "target_id"], "left")
    e = e.join(m.select("project_id", F.col("m").alias("source_id"), F.col("y").alias("out")), ["project_id", "source_id"], "left")
    into = F.col("into").isNotNull() | F.contains(F.lower("target_name"), F.lit(low))
    out = F.col("out").isNotNull() | (F.col("said_source") == target) | F.col("said_source").endswith("/" + target)
    e = cut(e.withColumns({"into": F.coalesce(into, F.lit(False)), "out": F.coalesce(out, F.lit(False))}).where("into OR out"))
    k = F.col("kind")
    r_in = F.when(k.isin("calls_api", "routes_to"), "route").when(k == "tested_by", "test").when(k == "uses_middleware", "middleware").otherwise("caller")
    r_out = F.when(k == "tested_by", "test").when(k == "uses_middleware", "middleware").when(k.isin("reads_from", "writes_to"), "resource_owner").when(k == "handles_event", "event_owner").when(k.isin("calls_api", "routes_to"), "route").otherwise("callee")

    def item(file: str, role: Column, reason: Column) -> Column:
        return F.struct(F.col(file).alias("file"), role.alias("role"), reason.alias("reason"))

    t = F.lit("target")
    said = lambda role: F.when(role == "test", "target").otherwise(role)
    w = lambda a, b: F.concat(F.lit(a + " "), k, F.lit(" " + b))
    inc = F.array(item("source_file", r_in, w("Incoming", "reference to target.")), item("target_file", t, w("Target side of incoming", "reference.")), item("said_source", said(r_in), w("Incoming", "metadata reference.")), item("said_target", r_in, w("Incoming", "metadata reference.")))
    outg = F.array(item("source_file", t, w("Source side of outgoing", "reference.")), item("target_file", r_out, w("Outgoing", "reference from target.")), item("said_source", said(r_out), w("Outgoing", "metadata reference.")), item("said_target", r_out, w("Outgoing", "metadata reference.")))
    none = F.array().cast("array<struct<file:string,role:string,reason:string>>")
    rows = e.select("project_id", F.explode(F.concat(F.when(F.col("into"), inc).otherwise(none), F.when(F.col("out"), outg).otherwise(none))).alias("x")).select("project_id", "x.*")
    rows = rows.union(hit.select("project_id", F.col("file_path"), t, F.concat(F.lit("Matched target symbol "), "name", F.lit("."))))
    order = F.when(F.col("role") == "target", 0).when(F.col("role") == "test", 1).when(F.col("role").isin("caller", "callee", "route"), 2).otherwise(3)
    files = rows.where("file IS NOT NULL").groupBy("project_id", "file").agg(F.min(F.struct(order.alias("o"), "role")).alias("r"), F.min(F.struct(F.length("reason").alias("n"), "reason")).alias("w"))
    files = files.select("project_id", "file", "r.role", "w.reason")
    refs = e.groupBy("project_id", "kind", "source_file", "target_file", "target_name").agg(F.count(F.lit(1)).alias("edges"))
    return files, refs
