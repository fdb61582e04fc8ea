"""Context packs and budgets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import paths as P
from orrery.functions import text as X
from orrery.operators import context as C
from orrery.plans.search import _TERMS, QUERY, _count_terms, _search_text
from orrery.session import table
from orrery.sources import tables as T
from orrery.sources.tables import with_

BUDGET = 3_000
TOP = 30


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """The best chunks of every project for the query, ranked."""
    c = T.chunks(spark, d, "project_id", "file_path", "symbol_name", "start_line", "end_line", "content")
    text = X.searchable(F.col("file_path"), F.col("symbol_name"), F.col("content"))
    score = X.chunk_score(text, F.lit(None).cast("double"), X.Profile(QUERY, X.py_tokens(QUERY)))
    h = c.withColumn("score", score).where("score IS NOT NULL")
    r = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("score"), "file_path", "id"))
    h = h.withColumn("rank", r).where(F.col("rank") <= TOP)
    return h.withColumn("reason", F.concat(F.lit("score "), F.round("score", 2).cast("string"))).withColumn("cost", C.snippet_cost(F.col("file_path"), F.col("content")))


def n03_diverse_snippets(spark: SparkSession, d: str) -> DataFrame:
    s = C.diverse(_hits(spark, d), ["project_id"], "rank", "cost", BUDGET, QUERY)
    return s.select("project_id", "rank", "id", "cost")


def n04_budget(spark: SparkSession, d: str) -> DataFrame:
    """Ranked hits that fit the budget, those too large skipped."""
    return C.within_budget(_hits(spark, d), ["project_id"], "rank", "cost", BUDGET).select("project_id", "rank", "id", "cost")


def n05_truncated(spark: SparkSession, d: str) -> DataFrame:
    """Ranked hits up to nine tenths of the budget, the first that isn't larger than all of it in any case."""
    return C.within_budget(_hits(spark, d), ["project_id"], "rank", "cost", BUDGET, stop=0.9).select("project_id", "rank", "id", "cost")


def a05_owner_chain(spark: SparkSession, d: str) -> DataFrame:
    s = C.within_budget(_hits(spark, d), ["project_id"], "rank", "cost", BUDGET)
    o = C.owner_chain(s, ["project_id"])
    return o.select("project_id", "file_path", F.round("score", 6).alias("score"), F.array_join("symbols", ",").alias("symbols"))


def n08_owner_rank(spark: SparkSession, d: str) -> DataFrame:
    """Place of each project's expected owner, the file of its most called symbol, in the owner chain of the query; null where it isn't in it."""
    called = T.edges(spark, d).where("kind = 'calls'").groupBy("project_id", F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    s = T.symbols(spark, d, "file_path").where("file_path IS NOT NULL")
    want = called.join(s, ["project_id", "id"]).groupBy("project_id").agg(F.max_by("file_path", F.struct("n", "id")).alias("expected"))
    chain = a05_owner_chain(spark, d).groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "file_path"))), lambda x: x["file_path"]).alias("chain"))  # at most TOP files
    return want.join(chain, "project_id", "left").select("project_id", "expected", F.nullif(F.array_position("chain", F.col("expected")), F.lit(0)).alias("rank"))


def g15_topology_map(spark: SparkSession, d: str) -> DataFrame:
    """Per project the owners of the query's topic and at most 24 topology edges, without snippets."""
    from orrery.plans.graphs import topology_edges

    o = a05_owner_chain(spark, d).select("project_id", F.lit("owner").alias("part"), F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("score"), "file_path")).alias("rank"), "file_path", F.lit(None).cast("string").alias("to"))
    e = topology_edges(spark, d, 24)
    return o.unionByName(e.select("project_id", F.col("kind").alias("part"), "rank", F.col("source_file").alias("file_path"), "to"))


def q04_context_pack(spark: SparkSession, d: str) -> DataFrame:
    """One pack per project: its snippets, owners and confidence, as a document."""
    s = C.diverse(_hits(spark, d), ["project_id"], "rank", "cost", BUDGET, QUERY)
    body = C.truncated(F.col("content"))
    snip = F.struct("rank", "file_path", "start_line", "end_line", "reason", body.alias("content"))
    pack = s.groupBy("project_id").agg(F.sum("cost").alias("used_chars"), F.array_sort(F.collect_list(snip)).alias("snippets"))
    conf = C.pack_confidence(s, ["project_id"])
    j = pack.join(conf.select("project_id", "confidence"), "project_id")
    return j.select("project_id", "confidence", "used_chars", F.size("snippets").alias("n_snippets"), C.as_markdown(F.col("confidence"), F.lit(QUERY), F.col("snippets")).alias("markdown"))


def x30_expansions(spark: SparkSession, d: str) -> DataFrame:
    t = T.texts(spark, d)
    e = C.expansion(F.col("content"), F.element_at(F.split("path", "/"), -1), QUERY, "debug")
    return t.select("project_id", "path", e.alias("expansion"), C.focus_line(C.lines_of(F.col("content")), QUERY).alias("focus"))


def x32_focus_windows(spark: SparkSession, d: str) -> DataFrame:
    t = T.texts(spark, d).withColumn("focus", C.focus_line(C.lines_of(F.col("content")), QUERY)).where("focus IS NOT NULL")
    return t.select("project_id", "path", "focus", F.sha2(C.focus_window(F.col("content"), F.col("focus")), 256).alias("window_hash"))


def x31_skeletons(spark: SparkSession, d: str) -> DataFrame:
    t = T.texts(spark, d)
    return t.select("project_id", "path", F.length(C.skeleton(F.col("content"))).alias("skeleton_chars"))


def a19_completeness(spark: SparkSession, d: str) -> DataFrame:
    """How much of each project is indexed and how fresh that is."""
    f = T.files(spark, d).groupBy("project_id").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "stale").alias("stale"))
    s = table(spark, d, "skipped_files").select("project_id", "file_path").distinct().groupBy("project_id").agg(F.count(F.lit(1)).alias("skipped"))
    j = f.join(s, "project_id", "left").fillna(0, ["skipped"])
    tier = F.when(F.col("stale") > F.col("files") * 0.3, "stale").when(F.col("stale") > F.col("files") * 0.1, "moderate").otherwise("fresh")
    j = j.withColumn("staleness", tier).withColumn("coverage", F.col("files") / (F.col("files") + F.col("skipped")))
    score = (F.when(tier == "fresh", 1.0).when(tier == "moderate", 0.7).otherwise(0.3) + F.col("coverage")) / 2
    return j.select("project_id", "files", "skipped", "staleness", F.round("coverage", 6).alias("coverage"), F.round(score, 6).alias("score"))


def e07_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Texts in blocks of 80 lines, blank ones left out."""
    from orrery.sources.extract import blocks

    return blocks(T.texts(spark, d)).select("project_id", "path", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"))


QUERIES = {k: v for k, v in list(globals().items()) if re.match(r"[anxqeg]\d\d_", k)}

_HITS = f"h0 AS (SELECT *, n / {len(_TERMS)} AS score FROM (SELECT *, {_count_terms('t', _TERMS)} AS n FROM (SELECT *, {_search_text('file_path', 'symbol_name', 'content')} AS t FROM chk)) WHERE n > 0), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, file_path, id) AS rank, (ceil((length(file_path) + length(content)) * 1.3) + 200)::INT AS cost FROM h0) WHERE rank <= {TOP})"
_FOLD = "f AS (SELECT project_id, 0 AS i, 0 AS used, 0 AS took, false AS ended FROM (SELECT DISTINCT project_id FROM h) UNION ALL SELECT f.project_id, f.i + 1, CASE WHEN {fits} THEN f.used + h.cost ELSE f.used END, CASE WHEN {fits} THEN h.rank::INT ELSE 0 END, f.ended OR NOT ({fits}) FROM f JOIN h ON h.project_id = f.project_id AND h.rank = f.i + 1)"
_LINES = "(CASE WHEN content = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(content, '\\r?\\n') END)"
_LSCORE = " + ".join(f"CASE WHEN contains(lower(x), '{t}') THEN {len(t)} ELSE 0 END" for t in C.focus_terms(QUERY))
_FOCUS = f"fo AS (SELECT *, {_LINES} AS ls, list_transform({_LINES}, lambda x: {_LSCORE}) AS sc FROM txt), fl AS (SELECT *, CASE WHEN list_max(sc) > 0 THEN list_position(sc, list_max(sc))::INT END AS focus FROM fo)"


def _fold(fits: str) -> str:
    return with_("chk").replace("WITH ", "WITH RECURSIVE ", 1) + f", {_HITS}, " + _FOLD.format(fits=fits)


_TAKE = " SELECT h.project_id, h.rank::INT AS rank, h.id, h.cost FROM h JOIN f ON f.project_id = h.project_id AND f.took = h.rank AND f.took > 0"
ORACLE = {
    "n04_budget": _fold(f"f.used + h.cost <= {BUDGET}") + _TAKE,
    "n05_truncated": _fold(f"NOT f.ended AND (f.used + h.cost <= {BUDGET * 0.9} OR f.used = 0 AND NOT (h.cost > {BUDGET} AND EXISTS (SELECT 1 FROM h o WHERE o.project_id = h.project_id AND o.rank > 1)))").replace("f.ended OR NOT (", "f.ended OR f.used > 0 AND NOT (") + _TAKE,
    "a05_owner_chain": _fold(f"f.used + h.cost <= {BUDGET}") + " SELECT h.project_id, h.file_path, round(sum(h.score), 6) AS score, coalesce(string_agg(DISTINCT h.symbol_name, ',' ORDER BY h.symbol_name), '') AS symbols FROM h JOIN f ON f.project_id = h.project_id AND f.took = h.rank AND f.took > 0 GROUP BY ALL",
    "x30_expansions": with_("txt") + f", {_FOCUS} SELECT project_id, path, CASE WHEN len(ls) <= 80 OR focus IS NOT NULL THEN 'focused_body' ELSE 'skeleton' END AS expansion, focus FROM fl",
    "x32_focus_windows": with_("txt") + f", {_FOCUS}, w AS (SELECT *, greatest(0, focus - 15) AS s FROM fl WHERE focus IS NOT NULL) SELECT project_id, path, focus, sha256(CASE WHEN s > 0 THEN '...' || chr(10) ELSE '' END || array_to_string(ls[s + 1:s + 28], chr(10)) || CASE WHEN s + 28 < len(ls) THEN chr(10) || '...' ELSE '' END) AS window_hash FROM w",
    "a19_completeness": with_("fil") + " SELECT project_id, files, skipped, staleness, round(coverage, 6) AS coverage, round((CASE staleness WHEN 'fresh' THEN 1.0 WHEN 'moderate' THEN 0.7 ELSE 0.3 END + coverage) / 2, 6) AS score FROM (SELECT project_id, files, coalesce(skipped, 0) AS skipped, CASE WHEN stale > files * 0.3 THEN 'stale' WHEN stale > files * 0.1 THEN 'moderate' ELSE 'fresh' END AS staleness, files / (files + coalesce(skipped, 0)) AS coverage FROM (SELECT project_id, count(*) AS files, count(*) FILTER (WHERE status = 'stale') AS stale FROM fil GROUP BY 1) LEFT JOIN (SELECT project_id, count(*) AS skipped FROM (SELECT DISTINCT project_id, file_path FROM skipped_files) GROUP BY 1) USING (project_id))",
    "e07_blocks": with_("txt") + f", l AS (SELECT project_id, path, unnest(ls) AS line, unnest(range(len(ls))) AS i, len(ls) AS n FROM (SELECT *, {_LINES} AS ls FROM txt)), b AS (SELECT project_id, path, i // 80 AS b, string_agg(line, chr(10) ORDER BY i) AS content, min(i) + 1 AS s, max(i) + 1 AS e FROM l GROUP BY ALL) SELECT project_id, path, s::INT AS start_line, e::INT AS end_line, sha256(content) AS content_hash FROM b WHERE regexp_matches(content, '\\S')",
}
_CHAIN = "oc AS (SELECT project_id, file_path, score, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, file_path) AS rank FROM (SELECT h.project_id, h.file_path, round(sum(h.score), 6) AS score FROM h JOIN f ON f.project_id = h.project_id AND f.took = h.rank AND f.took > 0 GROUP BY ALL))"
_RANKED = _fold(f"f.used + h.cost <= {BUDGET}").replace("WITH RECURSIVE ", "WITH RECURSIVE " + with_("edg", "sym").removeprefix("WITH ") + ", ", 1) + ", " + _CHAIN
_TOPO = "SELECT project_id, kind, rank, source_file, \"to\" FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY CASE kind WHEN 'handles_webhook' THEN 100 WHEN 'calls_api' THEN 90 WHEN 'routes_to' THEN 85 WHEN 'uses_middleware' THEN 84 WHEN 'tested_by' THEN 82 WHEN 'writes_to' THEN 78 WHEN 'reads_from' THEN 76 WHEN 'handles_event' THEN 74 ELSE CASE resolution WHEN 'resolved_lsp' THEN 80 WHEN 'resolved' THEN 75 WHEN 'exact' THEN 75 ELSE 20 END END DESC, edge_seq) AS rank FROM (SELECT *, coalesce(target_name, target_id) AS \"to\" FROM edg WHERE source_file IS NOT NULL AND kind IN ('calls', 'calls_api', 'routes_to', 'handles_webhook', 'handles_event', 'tested_by', 'uses_middleware', 'reads_from', 'writes_to'))) WHERE rank <= 24"
ORACLE["g15_topology_map"] = _RANKED + f" SELECT project_id, 'owner' AS part, rank::INT AS rank, file_path, NULL::VARCHAR AS \"to\" FROM oc UNION ALL SELECT project_id, kind, rank::INT, source_file, \"to\" FROM ({_TOPO})"
ORACLE["n08_owner_rank"] = _RANKED + ", w AS (SELECT e.project_id, arg_max(s.file_path, lpad(e.n::VARCHAR, 12, '0') || e.target_id) AS expected FROM (SELECT project_id, target_id, count(*) AS n FROM edg WHERE kind = 'calls' GROUP BY ALL) e JOIN sym s ON s.project_id = e.project_id AND s.id = e.target_id WHERE s.file_path IS NOT NULL GROUP BY 1) SELECT w.project_id, w.expected, oc.rank FROM w LEFT JOIN oc ON oc.project_id = w.project_id AND oc.file_path = w.expected"
_DIVERSE = "ht AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY CASE WHEN fr = 1 THEN 0 ELSE 1 END, rank) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY project_id, file_path ORDER BY rank) AS fr FROM h) WHERE fr <= CASE WHEN " + f"regexp_matches(lower(file_path), '{P._TEST_PATH}') OR regexp_matches(lower(file_path), '{P._FIXTURE_PATH}') OR regexp_matches(lower(file_path), '{P._DOCS_PATH}')" + " THEN 1 ELSE 3 END)"
_TURNS = _FOLD.format(fits=f"f.used + h.cost <= {BUDGET}").replace("project_id FROM h)", "project_id FROM ht)").replace("JOIN h ON", "JOIN ht h ON").replace("h.rank", "h.turn")
ORACLE["n03_diverse_snippets"] = with_("chk").replace("WITH ", "WITH RECURSIVE ", 1) + f", {_HITS}, {_DIVERSE}, {_TURNS} SELECT h.project_id, h.rank::INT AS rank, h.id, h.cost FROM ht h JOIN f ON f.project_id = h.project_id AND f.took = h.turn AND f.took > 0"
