"""The engine's facade: one object over a data directory whose methods take and return DataFrames."""

from __future__ import annotations

from copy import copy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import paths as P
from orrery.functions import text as X
from orrery.functions.vectors import py_embed, stable_id
from orrery.operators import context as C
from orrery.operators import graph as G
from orrery.operators import relations as R
from orrery.operators import retrieval as S
from orrery.operators import subgraph as W
from orrery.plans import relations as plan
from orrery.sources import extract as E
from orrery.sources import postings
from orrery.sources import tables as T
from orrery.sources.store import Store


def scan_tree(spark: SparkSession, root: str, project_id: str, max_bytes: int = 512_000, paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(files with content, skipped files) of a source tree; with `paths` (path) only those, absolute and climbing ones refused."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    raw = raw.unionByName(_unlisted(spark, root))
    prefix = r"^(?:[a-z]+:)?/*" + _literal(root.rstrip("/").lstrip("/")) + "/"
    t = raw.withColumn("rel", F.regexp_replace("path", prefix, "")).withColumn("project_id", F.lit(project_id))
    if paths is not None:
        wanted = paths.where(~F.col("path").startswith("/") & ~F.col("path").rlike(r"(^|/)\.\.(/|$)")).select(F.col("path").alias("rel")).distinct()
        t = t.join(wanted, "rel", "left_semi")
    reason = F.coalesce(F.concat(F.lit("ignored directory: "), P.ignored_directory(F.col("rel"))), P.skip_reason(F.col("rel"), F.col("length"), max_bytes), F.when(P.language_of(F.col("rel")) == "unknown", "unsupported language"))
    t = t.withColumn("reason", reason)
    kept = t.where("reason IS NULL").select(
        "project_id", F.col("rel").alias("path"), P.language_of(F.col("rel")).alias("language"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"),
        F.unix_millis("modificationTime").cast("double").alias("modified_at_ms"), P.role_of(F.col("rel")).alias("role"), F.decode("content", "UTF-8").alias("content"),
    )
    return kept, t.where("reason IS NOT NULL").select("project_id", F.col("rel").alias("file_path"), "reason")


def _unlisted(spark: SparkSession, root: str) -> DataFrame:
    """Files that Spark's listing leaves out, because a name begins with `_` or `.`: `__init__.py` is one. They are
    found by walking the tree, which takes a mounted root; on an object store they stay out."""
    import os

    found = []
    if os.path.isdir(root):
        for at, dirs, names in os.walk(root):
            dirs[:] = [d for d in dirs if d not in P.IGNORED_DIRECTORIES]
            rel = os.path.relpath(at, root)
            odd = any(x[0] in "_." for x in rel.split(os.sep) if x != ".")
            found += [(os.path.join(at, n),) for n in names if odd or n[0] in "_."]

    def read(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                with open(path, "rb") as f:
                    rows.append((path, pd.Timestamp(int(os.stat(path).st_mtime), unit="s"), os.path.getsize(path), f.read()))
            yield pd.DataFrame(rows, columns=["path", "modificationTime", "length", "content"])

    return spark.createDataFrame(found, "path string").mapInPandas(read, "path string, modificationTime timestamp, length long, content binary")


def _literal(s: str) -> str:
    import re

    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", s)


def _full_text():
    return F.concat_ws("\n", "file_path", "symbol_name", "content")


class Engine:
    """Queries over a data directory, or over a store that `index_tree` fills."""

    def __init__(self, spark: SparkSession, data: str):
        self.spark, self.data = spark, data
        self.files, self.symbols, self.edges = T.files(spark, data), T.symbols(spark, data), T.edges(spark, data)
        self.chunks = T.chunks(spark, data, *T.CHUNK_COLUMNS, "embedding")

    def _of(self, df: DataFrame, project: str | None) -> DataFrame:
        return df if project is None else df.where(F.col("project_id") == project)

    def index_status(self) -> DataFrame:
        return plan.a01_index_status(self.spark, self.data)

    def _fresh(self, df: DataFrame) -> DataFrame:
        stale = self.files.where("status IN ('stale', 'deleted')").select("project_id", F.col("path").alias("file_path"))
        return df.join(stale, ["project_id", "file_path"], "left_anti")

    def index_text(self, root: str) -> None:
        """Write the full-text index of the chunks of files that aren't stale under `root`, for searches to take their ranks from."""
        postings.build(self._fresh(self.chunks), "id", _full_text(), root)

    def keyword(self, query: str, k: int, project: str | None = None, index: str | None = None) -> DataFrame:
        """The k best chunks by text, of files that aren't stale; with the folder of an index, the full-text rank adds to the score."""
        chunks = self._fresh(self._of(self.chunks, project))
        ranked = postings.search(self.spark, index, X.py_words(query)).select(F.col("key").alias("id"), F.col("score").alias("rank_score")) if index else None
        return S.keyword_hits(chunks, S.expanded_names(self._of(self.symbols, project), query), k, ranked=ranked)

    def fused(self, query: str, project: str | None = None, k: int = 20, embed=py_embed, index: str | None = None) -> DataFrame:
        """Keyword and vector lists of twice k hits each, fused; stale files left out before the limits."""
        chunks = self._fresh(self._of(self.chunks, project))
        return S.fuse(("keyword", self.keyword(query, 2 * k, project, index)), ("semantic", S.vector_hits(chunks, embed(query), 2 * k)))

    def search_code(self, query: str, project: str | None = None, mode: str | None = None, k: int = 20, embed=py_embed, index: str | None = None, seeds: int = 0) -> DataFrame:
        """Ranked hits: keyword and vector lists, fused and boosted; stale files left out before the limit.

        With `seeds`, hits are moved by their files' distance in the file graph from the files of the first so many.
        """
        mode = X.resolve_mode(query, mode)
        hits = S.boosted(self.fused(query, project, k, embed, index), self._of(self.chunks, project), query, mode, k)
        if not seeds:
            return hits
        from orrery.session import cut

        near = cut(hits.join(self._of(self.chunks, project).select("id", "project_id", "language"), "id"))
        start = near.orderBy(F.desc("score"), "file_path", "id").limit(seeds).select("project_id", F.col("file_path").alias("file"))
        dist = G.distances(G.file_graph(self._of(self.edges, project), self._of(self.symbols, project)), start, plan.strength)
        moved = G.rerank(near, dist, P.asks_for_tests(query), mode)
        return moved.where("score > 0").select("id", "file_path", "source", "score").orderBy(F.desc("score"), "file_path", "id")

    def get_context(self, query: str, project: str | None = None, mode: str | None = None, budget: int = 18_000) -> DataFrame:
        hits = self.search_code(query, project, mode)
        c = self.chunks.select("id", "project_id", "symbol_name", "start_line", "end_line", "content")
        from pyspark.sql import Window

        h = hits.join(c, "id").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "file_path", "id")))  # at most k rows
        h = h.withColumn("reason", F.concat_ws(" ", F.lit("ranked by"), "source")).withColumn("g", F.lit(0)).withColumn("cost", C.snippet_cost(F.col("file_path"), F.col("reason"), F.col("content")))
        return C.diverse(h, ["g"], "rank", "cost", budget, query).drop("g")

    def find_symbol(self, name: str, project: str | None = None) -> DataFrame:
        return self._of(self.symbols, project).where(F.contains(F.lower("name"), F.lit(name.lower()))).orderBy("name", "id")

    def explain_file(self, path: str, project: str | None = None) -> DataFrame:
        return self._of(self.symbols, project).where(F.col("file_path") == path).orderBy("start_line", "id")

    def expand_node(self, ref: str, project: str | None = None, level: str = "focused", budget: int = 8_000) -> DataFrame:
        """The chunks of `path:symbol` or `path`, as skeleton or body, cut back to a skeleton over the budget."""
        path, _, name = ref.partition(":")
        c = self._of(self.chunks, project).where((F.col("file_path") == path) | F.col("file_path").endswith("/" + path))
        if name:
            c = c.where(F.col("symbol_name") == name)
        body = C.skeleton(F.col("content")) if level == "skeleton" else C.truncated(F.col("content"))
        body = F.when(F.length(body) + 120 > budget, C.skeleton(F.col("content"))).otherwise(body)
        return c.select("project_id", "id", "file_path", "symbol_name", body.alias("content"))

    def owner_matches(self, query: str, project: str | None = None, profile: X.Profile | None = None) -> DataFrame:
        """(id, file_path, name, score, text): symbols of files that aren't stale which the query names."""
        profile = profile or S.expanded_names(self._of(self.symbols, project), query)
        s = self._fresh(self._of(self.symbols, project)).where("kind <> 'file'")
        cov = S.with_stems(s, "id", F.col("name")).withColumn("coverage", X.symbol_coverage(F.col("parts"), F.col("stems"), profile)).select("id", "coverage")
        m = s.join(cov, "id", "left").withColumn("t", X.searchable(F.col("name"), F.col("file_path"), F.col("signature")))
        m = m.withColumn("score", X.symbol_score(F.col("t"), F.col("coverage"), profile)).where("score IS NOT NULL")
        return m.select("id", "file_path", "name", "score", F.lower(F.concat_ws("\n", "file_path", "name", "signature")).alias("text"))

    def find_owner(self, query: str, project: str | None = None, k: int = 5, profile: X.Profile | None = None) -> DataFrame:
        """The k best owners; stale files left out before the limits."""
        profile = profile or S.expanded_names(self._of(self.symbols, project), query)
        chunks = self._fresh(self._of(self.chunks, project))
        low = chunks.select("id", F.lower(F.concat_ws("\n", "file_path", "symbol_name", "content")).alias("text"))
        hits = S.keyword_hits(chunks, profile, max(8 * k, 50)).join(low, "id")
        return S.owners(hits, self.owner_matches(query, project, profile), query).orderBy(F.desc("score"), "file_path").limit(k)

    def find_reuse_candidates(self, query: str, structures: DataFrame, project: str | None = None, owners: int = 8) -> DataFrame:
        """What a request may reuse, unordered: drafts of search hits, owners and similar symbols, their structural duplicates, all scored.

        `structures` is (symbol_id, body_fingerprint, signature_tokens, imports, callees), one row per symbol. Stale files
        are left out of everything.
        """
        from orrery.session import cut

        e = copy(self)  # the relations made once, as each is read several times
        e.files = cut(self.files.where("status IN ('stale', 'deleted')").select("project_id", "path", "status"))
        e.symbols = cut(self._of(self.symbols, project).select("project_id", "id", "file_path", "name", "kind", "signature", "exported", "start_line"))
        e.chunks = cut(e._fresh(self._of(self.chunks, project).select("id", "project_id", "file_path", "symbol_name", "content", "embedding")))
        s = cut(e._fresh(e.symbols.where("kind <> 'file'")))
        profile = S.expanded_names(e.symbols, query)
        hits = e.search_code(query).join(e.chunks.select("id", "project_id", "symbol_name"), "id").select("project_id", "file_path", F.nullif("symbol_name", F.lit("")).alias("name"), "score")
        at = e.chunks.select("project_id", "file_path").union(s.select("project_id", "file_path")).distinct()
        own = cut(e.find_owner(query, None, owners, profile).select("file_path", "score").join(at, "file_path").select("project_id", "file_path", "score"))
        drafts = cut(S.reuse_drafts(s, hits, own, e.owner_matches(query, None, profile), X.reuse_terms(query)))
        st = cut(structures.join(s.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi"))
        edges = self._of(self.edges, project)
        for side in ("source_file", "target_file"):
            edges = edges.join(e.files.select("project_id", F.col("path").alias(side)), ["project_id", side], "left_anti")
        return S.reuse_scores(S.with_duplicates(drafts, s, st), R.duplicate_signals(st), R.usage(s, edges))

    def impact_analysis(self, target: str, project: str | None = None) -> tuple[DataFrame, DataFrame]:
        return G.impact(target, self._of(self.edges, project), self._of(self.symbols, project))

    def related_tests(self, symbol_id: str) -> DataFrame:
        e = self.edges.where((F.col("kind") == "tested_by") & (F.col("source_id") == symbol_id)).select("project_id", F.col("target_id").alias("id"))
        return self.symbols.join(e, ["project_id", "id"], "left_semi").select("project_id", "file_path").distinct()

    def _walked(self, seeds: DataFrame, flow: bool = False) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of the verified subgraph around each seed (project_id, id)."""
        from orrery.session import cut

        edges = W.walkable(self.edges, self.symbols)
        walked = cut(W.walks(edges, seeds, flow=flow))
        return W.subgraph_nodes(walked, edges, self.symbols), W.subgraph_edges(walked, edges, self.symbols)

    def explain_impact(self, seeds: DataFrame) -> DataFrame:
        return W.explain(W.signals(*self._walked(seeds)))

    def trace_request_flow(self, seeds: DataFrame) -> DataFrame:
        return self._walked(seeds, flow=True)[1]

    def verified_subgraph(self, seeds: DataFrame, preset: str = "compact") -> DataFrame:
        """The subgraph in one of its shapes: one document per seed (compact, agent_edit), or rows of edges (debug_trace, review_risk)."""
        nodes, edges = self._walked(seeds)
        if preset == "debug_trace":
            return edges
        if preset == "review_risk":
            return edges.where("confidence <> 'high' OR source = 'heuristic' OR kind = 'tested_by'").select("project_id", "seed", "rank", "from_id", "to_id", "kind", "confidence", "source", "reason", "line")
        key = ["project_id", "seed"]
        node = ["rank", "id", "file_path", "symbol_name", "role"] + (["reason", "confidence", "line"] if preset == "agent_edit" else [])
        edge = ["rank", "from_id", "to_id", "kind", "confidence"] + (["source", "reason", "source_file", "target_file", "line"] if preset == "agent_edit" else [])
        rows = lambda df, cols, name: df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))  # noqa: E731 at most 32 nodes and 48 edges
        paths = W.subgraph_paths(nodes).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))
        head = W.signals(nodes, edges).select(*key, "verdict", "confidence")
        return head.join(rows(nodes, node, "nodes"), key).join(rows(edges, edge, "edges"), key, "left").join(paths, key, "left")

    def review_diff(self, diff: str) -> DataFrame:
        """Changed paths of a diff, the files that depend on each, and the tests among them."""
        from orrery.plans.scans import changed_paths

        one = self.spark.createDataFrame([(diff,)], "diff string").select(F.explode(changed_paths(F.col("diff"))).alias("neighbour"))
        g = G.file_graph(self.edges, self.symbols).select("project_id", "file", "neighbour").distinct()
        return one.join(g, "neighbour", "left").groupBy("neighbour").agg(F.count("file").alias("impacted"), F.count_if(P.is_test(F.col("file"))).alias("tests")).withColumnRenamed("neighbour", "path")

    def reuse_signals(self, structures: DataFrame) -> DataFrame:
        return R.duplicate_signals(structures)


def doctor(spark: SparkSession, data: str) -> DataFrame:
    """(check, passed, detail): whether the tables are there, the relations hold rows, searches answer, and checkpoints can be written."""
    from orrery.session import cut

    def run(name, f):
        try:
            n = f()
            return (name, bool(n), str(n))
        except Exception as e:  # a failing check is a finding
            return (name, False, f"{type(e).__name__}: {e}"[:200])

    checks = {
        "projects": lambda: spark.read.parquet(f"{data}/projects.parquet").count(), "files": lambda: T.files(spark, data).limit(1).count(), "symbols": lambda: T.symbols(spark, data).limit(1).count(),
        "edges": lambda: T.edges(spark, data).limit(1).count(), "chunks": lambda: T.chunks(spark, data, "content").limit(1).count(), "search": lambda: Engine(spark, data).search_code("a", k=1).limit(1).count(),
        "checkpoint": lambda: cut(spark.range(1)).count(),
    }
    return spark.createDataFrame([run(n, f) for n, f in checks.items()], "check string, passed boolean, detail string")


def index_tree(store: Store, root: str, project_id: str, paths: DataFrame | None = None) -> dict[str, int]:
    """Index a source tree into a store: all of it the first time, then only what changed and what depends on that.

    Returns how many files were scanned, analysed and removed.
    """
    spark = store.spark
    scanned, skipped = scan_tree(spark, root, project_id, paths=paths)
    scanned = scanned.persist()
    old = store.read("files")
    hashes = scanned.select("project_id", "path", "content_hash")
    if old is None:
        touched = hashes.select("project_id", "path")
    else:
        mine = old.where(F.col("project_id") == project_id)
        state = R.freshness(mine.select("project_id", "path", "content_hash"), hashes)
        if paths is not None:
            state = state.join(paths.select("path").distinct(), "path", "left_semi").select("project_id", "path", "state")
        touched = state.where("state <> 'fresh'").select("project_id", "path").persist()
        e = store.read("edges")
        if e is not None:
            into = e.join(touched.select("project_id", F.col("path").alias("target_file")), ["project_id", "target_file"], "left_semi")
            touched = touched.union(into.select("project_id", F.col("source_file").alias("path"))).distinct()
    work = scanned.join(touched, ["project_id", "path"], "left_semi").persist()
    sym = E.extract_symbols(work)
    ids = sym.select("project_id", stable_id(F.lit(root), F.col("path"), F.col("name"), F.col("start_line").cast("string"), F.col("end_line").cast("string"), F.col("kind")).alias("id"), F.col("path").alias("file_path"), "name", "kind", "start_line", "end_line", "signature", "exported")
    file_symbols = work.select("project_id", stable_id(F.lit(root), F.col("path"), F.lit("file")).alias("id"), F.col("path").alias("file_path"), F.col("path").alias("name"), F.lit("file").alias("kind"), F.lit(1).alias("start_line"), F.size(F.split("content", "\n")).alias("end_line"), F.lit(None).cast("string").alias("signature"), F.lit(False).alias("exported"))
    refs = E.extract_references(work)
    imports = refs.where("kind = 'imports' AND target LIKE '.%'").select("project_id", "path", F.col("target").alias("source")).distinct()
    everything = hashes if paths is None or old is None else old.select("project_id", "path").union(hashes.select("project_id", "path")).distinct()
    resolved = R.resolve_imports(imports, everything.select("project_id", "path"))
    edges = refs.join(resolved.select("project_id", "path", F.col("source").alias("target"), F.col("target").alias("target_file")), ["project_id", "path", "target"], "left")
    edges = edges.select("project_id", F.col("path").alias("source_file"), "target_file", F.col("target").alias("target_name"), "kind", "line", "within")
    chunks = E.blocks(work).select("project_id", F.col("path").alias("file_path"), "start_line", "end_line", "content", F.sha2("content", 256).alias("content_hash"))
    counts = {"scanned": scanned.count(), "analysed": work.count(), "touched": touched.count()}
    store.upsert({"files": work.drop("content"), "symbols": ids.union(file_symbols), "edges": edges, "chunks": chunks}, touched)
    store.write({"skipped_files": skipped if store.read("skipped_files") is None else store.read("skipped_files").where(F.col("project_id") != project_id).unionByName(skipped)} if paths is None else {})
    return counts
