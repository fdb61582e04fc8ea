"""Joins between the relations: endpoints, freshness, resolution, intervals, routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.paths import import_candidates, is_test

#: Resolutions that count as proven.
RESOLVED = ("resolved", "resolved_lsp", "exact", "import")


def endpoints(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with the names and files of both ends; an unknown symbol falls back to what the edge itself says."""

    def side(s: str) -> DataFrame:
        return symbols.select("project_id", F.col("id").alias(f"{s}_id"), F.col("name").alias(f"{s}_symbol"), F.col("file_path").alias(f"_{s}_file"))

    e = edges.join(side("source"), ["project_id", "source_id"], "left").join(side("target"), ["project_id", "target_id"], "left")
    return e.withColumns({"source_file": F.coalesce("_source_file", "source_file"), "target_file": F.coalesce("_target_file", "target_file")}).drop("_source_file", "_target_file")


def freshness(indexed: DataFrame, scanned: DataFrame) -> DataFrame:
    """State of each path: fresh, stale (other hash), pending (not indexed yet) or deleted (gone from the tree).

    `indexed` and `scanned` are (project_id, path, content_hash). Null hashes differ from any hash but another null.
    """
    a = indexed.select("project_id", "path", F.col("content_hash").alias("h1"), F.lit(True).alias("i"))
    b = scanned.select("project_id", "path", F.col("content_hash").alias("h2"), F.lit(True).alias("s"))
    state = F.when(F.col("i").isNull(), "pending").when(F.col("s").isNull(), "deleted").when(F.col("h1").eqNullSafe(F.col("h2")), "fresh").otherwise("stale")
    return a.join(b, ["project_id", "path"], "full").select("project_id", "path", state.alias("state"))


def resolve_imports(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, path, source, target): the first candidate of each relative import that exists; null if none does."""
    c = sources.select("project_id", "path", "source", F.posexplode(import_candidates(F.col("path"), F.col("source"))).alias("rank", "candidate"))
    there = files.select("project_id", F.col("path").alias("candidate")).distinct().withColumn("there", F.lit(True))
    hit = c.join(there, ["project_id", "candidate"], "left")
    return hit.groupBy("project_id", "path", "source").agg(F.min_by("candidate", F.when(F.col("there"), F.col("rank"))).alias("target"))


def resolve_calls(calls: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(edge_seq, resolved_id): the exported symbol that a call's name means in a file that its file imports; the last import wins."""
    bound = imports.where("source_file IS NOT NULL AND target_file IS NOT NULL").groupBy("project_id", "source_file", "target_file").agg(F.max("edge_seq").alias("bound_at"))
    known = symbols.where("exported AND kind <> 'file'").groupBy("project_id", F.col("file_path").alias("target_file"), F.col("name").alias("target_name")).agg(F.min("id").alias("resolved_id"))
    c = calls.where("target_name IS NOT NULL AND source_file IS NOT NULL").select("project_id", "edge_seq", "source_file", "target_name")
    # names first: few of a file's imports export the name
    by_name = c.join(bound, ["project_id", "source_file"]).join(known, ["project_id", "target_file", "target_name"])
    return by_name.groupBy("edge_seq").agg(F.max_by("resolved_id", F.struct("bound_at", "resolved_id")).alias("resolved_id"))


def test_edges(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project_id, source_id, test_id): file symbols of code and of the tests that import it."""
    e = imports.where("source_file IS NOT NULL AND target_file IS NOT NULL").where(is_test(F.col("source_file")) & ~is_test(F.col("target_file"))).select("project_id", "source_file", "target_file").distinct()
    f = symbols.where("kind = 'file'").groupBy("project_id", "file_path").agg(F.min("id").alias("id"))
    a = f.select("project_id", F.col("file_path").alias("target_file"), F.col("id").alias("source_id"))
    b = f.select("project_id", F.col("file_path").alias("source_file"), F.col("id").alias("test_id"))
    return e.join(a, ["project_id", "target_file"]).join(b, ["project_id", "source_file"]).select("project_id", "source_id", "test_id").distinct()


#: Bits of a level of cells; a span lies in at most two cells of its level.
_LEVEL = 4


def around(points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str) -> DataFrame:
    """Points joined to the spans of their keys that hold them: start <= at <= end. Null and empty spans hold nothing.

    A span goes into the one or two cells of a level whose cells are no shorter than it, a point into its cell of every level,
    so that the join is on equal cells and a file of many points and spans is no single group.
    """
    levels = 32 // _LEVEL + 1
    length = F.col(end).cast("long") - F.col(start).cast("long")
    level = F.lit(0)
    for k in range(1, levels):
        level = level + (length >= F.lit(1 << (_LEVEL * (k - 1)))).cast("int")
    shift = lambda c, n: F.floor(F.col(c).cast("long") / F.pow(F.lit(2.0), n * _LEVEL)).cast("long")
    held = spans.where(F.col(end) >= F.col(start)).withColumn("_level", level)
    held = held.withColumn("_cell", F.explode(F.array_distinct(F.array(shift(start, F.col("_level")), shift(end, F.col("_level"))))))
    asked = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, range(levels)))))
    asked = asked.withColumn("_cell", shift(at, F.col("_level")))
    return asked.join(held, [*on, "_level", "_cell"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_level", "_cell")


def narrowest(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """(edge_seq, symbol_id, span): the smallest symbol around a line; ties go to the smaller id."""
    s = symbols.where("kind <> 'file'").select("project_id", F.col("file_path").alias("source_file"), "id", "start_line", "end_line")
    hit = around(points.select("project_id", "source_file", "edge_seq", "line"), s, ["project_id", "source_file"], "line", "start_line", "end_line")
    best = F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "id")).alias("b")
    return hit.groupBy("edge_seq").agg(best).select("edge_seq", F.col("b.id").alias("symbol_id"), "b.span")


def callees(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project_id, id, callee): names that a symbol calls, by the edge's source or by its line inside the symbol."""
    c = calls.where("target_name IS NOT NULL")
    by_id = c.select("project_id", F.col("source_id").alias("id"), F.col("target_name").alias("callee")).join(symbols.select("project_id", "id"), ["project_id", "id"], "left_semi")
    s = symbols.select("project_id", F.col("file_path").alias("source_file"), "id", "start_line", "end_line")
    by_line = around(c.select("project_id", "source_file", "line", F.col("target_name").alias("callee")), s, ["project_id", "source_file"], "line", "start_line", "end_line")
    return by_id.union(by_line.select("project_id", "id", "callee")).distinct()


def chunk_of_symbol(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """(project_id, id, chunk_id, tier): the chunk of a symbol's name (tier 1), else one around its lines (tier 2), else the first of its file (tier 3)."""
    s = symbols.where("kind <> 'file'").select("project_id", "id", "file_path", "name", "start_line", "end_line")
    c = chunks.select("project_id", "file_path", F.col("id").alias("chunk_id"), "symbol_name", F.col("start_line").alias("cs"), F.col("end_line").alias("ce"))
    first = F.min(F.struct("cs", "chunk_id")).alias("c")
    named = c.groupBy("project_id", "file_path", F.col("symbol_name").alias("name")).agg(first)
    one = s.join(named, ["project_id", "file_path", "name"]).select("project_id", "id", F.lit(1).alias("tier"), "c")
    cover = around(s, c.drop("symbol_name"), ["project_id", "file_path"], "start_line", "cs", "ce").where("ce >= end_line")
    two = cover.groupBy("project_id", "id").agg(first).select("project_id", "id", F.lit(2).alias("tier"), "c")
    three = s.join(c.groupBy("project_id", "file_path").agg(first), ["project_id", "file_path"]).select("project_id", "id", F.lit(3).alias("tier"), "c")
    best = one.unionByName(two).unionByName(three).groupBy("project_id", "id").agg(F.min(F.struct("tier", "c")).alias("b"))
    return best.select("project_id", "id", "b.c.chunk_id", "b.tier")


def resolve_references(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref, symbol_id, tier) of references (project_id, ref, path, name): the symbol of that name in the file (tier 1), else the file's own (2);
    if no file has that path, the same of files whose path ends in it (3, 4). Ties go to the first by line, then by id."""
    s = symbols.select("project_id", "id", F.col("file_path").alias("_file"), F.col("name").alias("_name"), "kind", "start_line").withColumn("_base", F.element_at(F.split("_file", "/"), -1))
    j = references.select("project_id", "ref", "path", "name").withColumn("_base", F.element_at(F.split("path", "/"), -1)).join(s, ["project_id", "_base"])
    j = j.where((F.col("_file") == F.col("path")) | F.col("_file").endswith(F.concat(F.lit("/"), F.col("path"))))
    tier = F.when(F.col("_file") == F.col("path"), 0).otherwise(2) + F.when(F.col("_name") == F.col("name"), 1).when(F.col("kind") == "file", 2)
    best = F.min(F.struct(tier.alias("tier"), F.coalesce("start_line", F.lit(0)).alias("l"), "id")).alias("b")
    return j.where(tier.isNotNull()).groupBy("ref").agg(best).select("ref", F.col("b.id").alias("symbol_id"), "b.tier")


def match_routes(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """(request, route): the route of each request path, exact before by pattern; :name matches any segment.

    A route's shape says which of its segments are literal. A request is asked once for each shape that routes of its
    length have, with the segments at the literal places, so that both meet by equality alone; there are few shapes, not one per route.
    """
    shape = lambda segments: F.array_join(F.transform(segments, lambda x: F.when(x.startswith(":"), ":").otherwise("=")), "")
    kept = lambda segments, pattern: F.array_join(F.transform(segments, lambda x, i: F.when(F.substr(pattern, i + 1, F.lit(1)) == "=", x).otherwise(":")), "/")
    r = routes.select("route").distinct().withColumn("rs", F.split("route", "/")).where(F.size("rs") >= 2).withColumn("shape", shape(F.col("rs")))
    r = r.select("route", F.size("rs").alias("n"), "shape", kept(F.col("rs"), F.col("shape")).alias("key"))
    q = requests.select("request").distinct().withColumn("qs", F.split("request", "/")).withColumn("n", F.size("qs"))
    asked = q.join(r.select("n", "shape").distinct(), "n").select("request", "n", "shape", kept(F.col("qs"), F.col("shape")).alias("key"))
    best = F.min(F.struct((F.col("route") != F.col("request")).alias("pattern"), F.col("route").alias("route"))).alias("b")
    return asked.join(r, ["n", "shape", "key"]).groupBy("request").agg(best).select("request", "b.route")


def duplicate_signals(structures: DataFrame, window: int = 65, least: float = 0.5) -> DataFrame:
    """Per symbol of a shared fingerprint: confirmed duplicates and the greatest similarities within the comparison pool.

    The pool is the first `window` symbols of the fingerprint by id: a group shared by more is boilerplate, whose
    signals are defined as those against the pool. That keeps the work linear in the size of a group.
    """
    from pyspark.sql import Window

    s = structures.where("body_fingerprint IS NOT NULL").select("symbol_id", "body_fingerprint", *[F.coalesce(F.array_distinct(F.array_compact(c)), F.array().cast("array<string>")).alias(c) for c in ("signature_tokens", "imports", "callees")])
    rank = F.row_number().over(Window.partitionBy("body_fingerprint").orderBy("symbol_id"))
    pool = s.withColumn("r", rank).where(F.col("r") <= window).drop("r")
    other = pool.select("body_fingerprint", F.col("symbol_id").alias("o"), *[F.col(c).alias("o_" + c) for c in ("signature_tokens", "imports", "callees")])

    def jaccard(c: str):
        n = F.size(F.array_intersect(c, "o_" + c))
        u = F.size(c) + F.size("o_" + c) - n
        return F.when(u > 0, n / u).otherwise(0.0)

    j = s.join(other, "body_fingerprint").where("symbol_id <> o").withColumns({"sig": jaccard("signature_tokens"), "imp": jaccard("imports"), "cal": jaccard("callees")})
    return j.groupBy("symbol_id").agg(
        F.sum(F.when(F.col("cal") >= least, 1).otherwise(0)).alias("duplicates"), F.round(F.max("sig"), 3).alias("signature_similarity"), F.round(F.max("imp"), 3).alias("import_overlap"), F.round(F.max("cal"), 3).alias("callee_overlap")
    )


def usage(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, callers, tests): calls that reach each symbol, and tests of it."""
    callers = edges.where("kind = 'calls'").groupBy("project_id", F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    tests = edges.where("kind = 'tested_by'").groupBy("project_id", F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("tests"))
    return symbols.select("project_id", "id").join(callers, ["project_id", "id"], "left").join(tests, ["project_id", "id"], "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("callers", "tests")])
