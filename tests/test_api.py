"""The facade over the smallest tables."""

import math
import os
import re

import pytest
from pyspark.sql import functions as F

from orrery.api import Engine, doctor
from orrery.functions import text as X
from orrery.functions.stemming import stem
from orrery.plans import search
from orrery.sources.store import explain_failure

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, DATA)


def test_search_is_ranked_and_scoped(engine):
    hits = engine.search_code("refresh the session ledger").collect()
    assert 0 < len(hits) <= 20 and [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True)
    project = engine.chunks.select("project_id").first()[0]
    own = {r["id"] for r in engine.chunks.where(F.col("project_id") == project).select("id").collect()}
    assert {h["id"] for h in engine.search_code("refresh the session ledger", project).collect()} <= own
    assert engine.search_code("日本語").count() == 0


def test_stale_files_are_left_out(engine):
    stale = {(r["project_id"], r["path"]) for r in engine.files.where("status IN ('stale', 'deleted')").collect()}
    got = engine.search_code("panel beacon", k=50).join(engine.chunks.select("id", "project_id"), "id").collect()
    assert not any((r["project_id"], r["file_path"]) in stale for r in got)


def _coverage(name, wanted):
    parts = X.py_split_identifier(name or "")
    n = sum(p in wanted or (p.isascii() and p.isalpha() and stem(p) in wanted) for p in parts)
    return n / len(parts) if len(parts) >= 2 and n >= 2 else None


def test_keyword_search_equals_brute_force(spark, engine):
    """With stems, expanded names and stale files out; the reduced registered query differs."""
    terms = X.py_tokens(search.QUERY)
    wanted = set(X.variants(terms))
    names = {r["name"] for r in engine.symbols.where("kind <> 'file'").select("name").collect()}
    ranked = sorted((-c, n) for n in names if n and (c := _coverage(n, wanted)) is not None)[:48]
    expanded = list(dict.fromkeys("".join(X.py_split_identifier(n)) for _, n in ranked))
    stale = {(r["project_id"], r["path"]) for r in engine.files.where("status IN ('stale', 'deleted')").collect()}

    def has(text, term):
        p = X.term_pattern(term)
        return term in text if p is None else re.search(p, text) is not None

    rows = []
    for c in engine.chunks.collect():
        if (c["project_id"], c["file_path"]) in stale:
            continue
        raw = "\n".join(x for x in (c["file_path"], c["symbol_name"], c["content"]) if x)
        text = raw.lower() + "\n" + " ".join(X.py_split_identifier(raw))
        n = sum(any(has(text, v) for v in X.variants([t])) for t in terms)
        e = sum(has(text, t) for t in expanded)
        cov = _coverage(c["symbol_name"], wanted)
        if n or e or cov is not None:
            rows.append((-round(n / len(terms) + min(0.45, 0.15 * e) + 0.85 * (cov or 0), 6), c["file_path"], c["id"]))
    want = [(i, -s) for s, _, i in sorted(rows)[:40]]
    got = [(r["id"], r["score"]) for r in search.x06_keyword_search(spark, DATA).collect()]
    assert len(want) > 5 and sorted(got) == sorted(want)
    assert sorted(got) != sorted((r["id"], r["score"]) for r in search.x06_keyword_topk(spark, DATA).collect())


def test_search_with_full_text_ranks_and_graph(spark, engine, tmp_path):
    root = str(tmp_path / "fts")
    engine.index_text(root)
    q = "refresh the session ledger"
    plain = {r["id"]: r["score"] for r in engine.keyword(q, 1000).collect()}
    ranked = {r["id"]: r["score"] for r in engine.keyword(q, 1000, index=root).collect()}
    words = X.py_words(q)
    lists = {c["id"]: re.findall(r"[^\W_]+", "\n".join(x for x in (c["file_path"], c["symbol_name"], c["content"]) if x is not None).lower()) for c in engine._fresh(engine.chunks).collect()}
    n, mean = len(lists), sum(map(len, lists.values())) / len(lists)
    df = {w: sum(w in x for x in lists.values()) for w in words}
    for i, score in ranked.items():
        tf = {w: lists[i].count(w) for w in words}
        bm = sum(max(math.log((n - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(lists[i]) / mean)) for w in words)
        assert abs(score - plain[i] - min(0.25, math.log1p(max(0.0, bm)))) < 1e-6
    assert ranked.keys() == plain.keys() and any(ranked[i] > plain[i] for i in plain)
    moved = engine.search_code(q, index=root, seeds=3).collect()
    still = {r["id"]: r["score"] for r in engine.search_code(q, index=root).collect()}
    assert {r["id"] for r in moved} <= still.keys() and [r["score"] for r in moved] == sorted((r["score"] for r in moved), reverse=True)
    assert any(abs(r["score"] - still[r["id"]]) > 1e-9 for r in moved)
    from orrery.sources import postings

    assert postings.search(spark, root, []).count() == 0 and postings.search(spark, root, ["nosuchword"]).count() == 0
    postings.build(spark.createDataFrame([], "id string, t string"), "id", F.col("t"), str(tmp_path / "none"))
    assert postings.search(spark, str(tmp_path / "none"), ["a"]).count() == 0


def test_registered_searches_leave_stale_files_out(spark, engine):
    stale = {r["path"] for r in engine.files.where("status IN ('stale', 'deleted')").collect()} - {r["path"] for r in engine.files.where("status NOT IN ('stale', 'deleted')").collect()}
    for f in (search.n01_search_fusion, search.q03_search_code, search.q10_find_owner):
        got = [r["file_path"] for r in f(spark, DATA).collect()]
        assert got and not stale & set(got)


def test_context_stays_within_the_budget(engine):
    for budget in (0, 900, 4000):
        rows = engine.get_context("refresh the session ledger", budget=budget).collect()
        assert sum(r["cost"] for r in rows) <= budget


def test_lookups(engine):
    s = engine.symbols.where("kind = 'function'").first()
    assert s["id"] in {r["id"] for r in engine.find_symbol(s["name"].upper()).collect()}
    assert s["id"] in {r["id"] for r in engine.explain_file(s["file_path"]).collect()}
    assert engine.find_owner(f"where is {s['name']}").count() <= 5
    files, refs = engine.impact_analysis(s["name"])
    assert s["file_path"] in {r["file"] for r in files.collect()} and refs.count() >= 0
    engine.related_tests(s["id"]).collect()
    c = engine.chunks.where("symbol_name IS NOT NULL").first()
    node = engine.expand_node(f"{c['file_path']}:{c['symbol_name']}", level="skeleton").collect()
    assert node and all(len(n["content"]) <= max(len(c["content"]), 1) + 200 for n in node)
    assert engine.index_status().count() > 0


def test_subgraph_presets(engine):
    seeds = engine.symbols.where("kind = 'function' AND exported").groupBy("project_id").agg(F.min("id").alias("id"))
    full = engine.verified_subgraph(seeds, "agent_edit")
    one = full.first()
    assert one["nodes"] and one["nodes"][0]["role"] == "target" and one["verdict"] and (not one["edges"] or one["edges"][0]["reason"])
    assert "confidence" in full.columns and "cost" in engine.verified_subgraph(seeds, "debug_trace").columns
    assert engine.verified_subgraph(seeds, "review_risk").where("confidence = 'high' AND kind <> 'tested_by'").count() == 0
    assert engine.explain_impact(seeds).where("risk NOT IN ('low', 'medium', 'high')").count() == 0


def test_review_diff(engine):
    path = engine.edges.where("kind = 'imports' AND target_file IS NOT NULL").first()["target_file"]
    out = engine.review_diff(f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -1 +1 @@\n-a\n+b\n").collect()
    assert [r["path"] for r in out] == [path] and out[0]["impacted"] >= 1


def test_doctor(spark, tmp_path):
    good = {r["check"]: r["passed"] for r in doctor(spark, DATA).collect()}
    assert good["files"] and good["symbols"] and good["checkpoint"]
    bad = {r["check"]: r["passed"] for r in doctor(spark, str(tmp_path)).collect()}
    assert not bad["files"] and not bad["search"] and bad["checkpoint"]


def test_failures_are_told_apart():
    assert [explain_failure(x) for x in ("HTTP 429", "401 Unauthorized", TimeoutError("timed out"), ConnectionError("refused"), "expected dimension 64", "odd")] == ["rate_limit", "auth", "timeout", "network", "bad_response", "unknown"]
