"""Relations, retrieval, graph and context on literal tables, against plain Python."""

import random
from collections import deque

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.operators import context as C
from orrery.operators import graph as G
from orrery.operators import subgraph as W
from orrery.operators import relations as R
from orrery.operators import retrieval as S
from orrery.operators.evaluation import gate, ranks, summary
from orrery.plans.relations import strength

SYM = "project_id string, id string, file_path string, name string, kind string, language string, start_line int, end_line int, signature string, exported boolean"
EDGE = "edge_seq long, project_id string, source_id string, target_id string, kind string, source_file string, target_file string, target_name string, framework string, resolution string, line int, file_path string"


def _sym(spark, *rows):
    return spark.createDataFrame([("p", i, f, n, k, "typescript", a, b, None, x) for i, f, n, k, a, b, x in rows], SYM)


def _edges(spark, *rows):
    return spark.createDataFrame([(i, "p", s, t, k, sf, tf, tn, None, r, ln, sf) for i, (s, t, k, sf, tf, tn, r, ln) in enumerate(rows)], EDGE)


def test_freshness_states(spark):
    a = spark.createDataFrame([("p", "same", "1"), ("p", "other", "1"), ("p", "gone", "1"), ("p", "null", None)], "project_id string, path string, content_hash string")
    b = spark.createDataFrame([("p", "same", "1"), ("p", "other", "2"), ("p", "new", "1"), ("p", "null", "1")], "project_id string, path string, content_hash string")
    got = {r["path"]: r["state"] for r in R.freshness(a, b).collect()}
    assert got == {"same": "fresh", "other": "stale", "gone": "deleted", "new": "pending", "null": "stale"}


def test_narrowest_and_callees(spark):
    s = _sym(spark, ("f", "a.ts", "a.ts", "file", 1, 99, False), ("out", "a.ts", "Outer", "class", 1, 50, True), ("in", "a.ts", "inner", "method", 10, 20, True), ("bad", "a.ts", "bad", "method", 30, 5, True))
    e = _edges(spark, ("x", "y", "calls", "a.ts", None, "go", None, 15), ("out", "y", "calls", "b.ts", None, "stop", None, 40), ("x", "y", "calls", "a.ts", None, None, None, 12), ("x", "y", "calls", "a.ts", None, "far", None, 70))
    got = {r["edge_seq"]: (r["symbol_id"], r["span"]) for r in R.narrowest(e, s).collect()}
    assert got == {0: ("in", 10), 2: ("in", 10)}
    c = {(r["id"], r["callee"]) for r in R.callees(e, s).collect()}
    assert c == {("f", "go"), ("out", "go"), ("in", "go"), ("out", "stop"), ("f", "far")}


def test_route_match_prefers_exact(spark):
    q = spark.createDataFrame([("/api/users/7",), ("/api/users/me",), ("/api/x",), ("/other/users/7",)], "request string")
    r = spark.createDataFrame([("/api/users/:id",), ("/api/users/me",), ("/:any/users/:id",)], "route string")
    assert {x["request"]: x["route"] for x in R.match_routes(q, r).collect()} == {"/api/users/7": "/:any/users/:id" if "/:any" < "/api" else "/api/users/:id", "/api/users/me": "/api/users/me", "/other/users/7": "/:any/users/:id"}


def test_duplicates_need_shared_callees(spark):
    rows = [("a", "F", ["x"], ["i"], ["c1", "c2"]), ("b", "F", ["x"], ["i"], ["c1", "c2", "c2"]), ("c", "F", ["y"], None, ["z"]), ("d", None, ["x"], ["i"], ["c1"]), ("e", "G", [], [], [])]
    d = spark.createDataFrame(rows, "symbol_id string, body_fingerprint string, signature_tokens array<string>, imports array<string>, callees array<string>")
    got = {r["symbol_id"]: (r["duplicates"], r["signature_similarity"], r["callee_overlap"]) for r in R.duplicate_signals(d).collect()}
    assert got == {"a": (1, 1.0, 1.0), "b": (1, 1.0, 1.0), "c": (0, 0.0, 0.0)}


def test_fusion_ignores_scales(spark):
    kw = spark.createDataFrame([("a", "f1", 12000.0), ("b", "f2", 8000.0)], "id string, file_path string, score double")
    se = spark.createDataFrame([("c", "f3", 0.92), ("a", "f1", 0.5)], "id string, file_path string, score double")
    got = {r["id"]: (r["source"], round(r["score"], 6)) for r in S.fuse(("keyword", kw), ("semantic", se)).collect()}
    assert got == {"a": ("graph", round(60 / 61 + 60 / 62, 6)), "b": ("keyword", round(60 / 62, 6)), "c": ("semantic", round(60 / 61, 6))}
    assert got["c"][1] > got["b"][1]


def test_owners_demote_tests_and_prefer_exact_names(spark):
    hits = spark.createDataFrame([("src/a.ts", 1.0, "loadusername here"), ("tests/a.test.ts", 1.4, "loads"), ("src/b.ts", 0.5, "x")] + [("src/pile.ts", 0.2, "x")] * 50, "file_path string, score double, text string")
    m = spark.createDataFrame([("s1", "src/a.ts", "loadUserName", 1.0, "loadusername")], "id string, file_path string, name string, score double, text string")
    got = {r["file_path"]: r["score"] for r in S.owners(hits, m, "where is loadUserName").collect()}
    assert max(got, key=got.get) == "src/a.ts" and got["tests/a.test.ts"] < 1.4 and got["src/pile.ts"] < 1.0
    asked = {r["file_path"]: r["score"] for r in S.owners(hits, m, "tests of loadUserName").collect()}
    assert asked["tests/a.test.ts"] == 2.4


def test_reuse_decision(spark):
    d = spark.createDataFrame([("a", 4.0, "high", True, 2), ("b", 3.2, "medium", True, 0)], "id string, score double, confidence string, exported boolean, duplicates long")
    assert tuple(S.reuse_decision(d).first()) == ("reuse", "high", "review_required")
    assert tuple(S.reuse_decision(d.limit(0)).first()) == ("implement_new", "low", "allow_new")


def _bfs(adj, seeds, most):
    dist = {s: 0 for s in seeds if s in adj}
    q = deque(dist)
    while q:
        u = q.popleft()
        if dist[u] < most:
            for v in adj[u]:
                if v not in dist:
                    dist[v] = dist[u] + 1
                    q.append(v)
    return dist


def test_distances_equal_breadth_first_search(spark):
    r = random.Random(4)
    files = [f"f{i:02d}" for i in range(40)]
    rows = [(f"x{i}", f"y{i}", r.choice(["calls", "imports", "contains"]), r.choice(files), r.choice(files), None, None, None) for i in range(60)]
    e, s = _edges(spark, *rows), _sym(spark)
    g = G.file_graph(e, s)
    adj = {}
    for x in rows:
        if x[3] != x[4]:
            adj.setdefault(x[3], set()).add(x[4])
            adj.setdefault(x[4], set()).add(x[3])
    seeds = ["f00", "f07", "absent"]
    got = {x["file"]: x["hops"] for x in G.distances(g, spark.createDataFrame([("p", f) for f in seeds], "project_id string, file string"), strength).collect()}
    assert got == _bfs(adj, seeds, 3)


def test_rerank_moves_near_files_up(spark):
    hits = spark.createDataFrame([("p", "docs/a.md", "semantic", "markdown", 1.8), ("p", "src/s.ts", "keyword", "typescript", 0.8), ("p", "src/r.ts", "keyword", "typescript", 0.2)], "project_id string, file_path string, source string, language string, score double")
    dist = spark.createDataFrame([("p", "src/s.ts", 0, 1.0), ("p", "src/r.ts", 1, 1.0)], "project_id string, file string, hops int, strength double")
    got = {r["file_path"]: r["score"] for r in G.rerank(hits, dist, False, "feature").collect()}
    assert got["src/s.ts"] > got["docs/a.md"] and got["src/r.ts"] > got["docs/a.md"] - 0.1


def test_impact_roles(spark):
    s = _sym(spark, ("a", "src/pay.ts", "charge", "function", 1, 5, True), ("b", "src/ui.ts", "button", "function", 1, 5, True), ("c", "tests/pay.test.ts", "tests/pay.test.ts", "file", 1, 9, False), ("d", "src/db.ts", "ledger", "function", 1, 5, True))
    e = _edges(spark, ("b", "a", "calls", "src/ui.ts", "src/pay.ts", "charge", "exact", 3), ("a", "c", "tested_by", "src/pay.ts", "tests/pay.test.ts", None, None, None), ("a", "d", "writes_to", "src/pay.ts", "src/db.ts", "ledger", None, None))
    files, refs = G.impact("charge", e, s)
    assert {r["file"]: r["role"] for r in files.collect()} == {"src/pay.ts": "target", "src/ui.ts": "caller", "tests/pay.test.ts": "test", "src/db.ts": "resource_owner"}
    assert refs.count() == 3


def _subgraph(spark, s, e, seed, flow=False):
    v = W.walkable(e, s)
    walked = W.walks(v, spark.createDataFrame([("p", seed)], "project_id string, id string"), flow=flow).cache()
    return W.subgraph_nodes(walked, v, s), W.subgraph_edges(walked, v, s)


def test_subgraph_takes_the_sure_way(spark):
    s = _sym(spark, *[(i, f"{i}.ts", i, "function", 1, 2, True) for i in ("seed", "weak", "strong", "route", "service")])
    e = _edges(spark, ("seed", "weak", "references", "a", "b", None, None, None), ("weak", "strong", "references", "a", "b", None, None, None), ("seed", "route", "calls_api", "a", "b", "x", "exact", 1), ("route", "service", "routes_to", "a", "b", "x", "exact", 1), ("service", "strong", "calls", "a", "b", "x", "exact", 1), ("far", "away", "calls", "a", "b", None, "exact", 1), ("seed", "far", "related", "a", "b", None, "exact", 1))
    nodes, edges = _subgraph(spark, s, e, "seed", flow=True)
    g = edges.collect()
    assert {(r["from_id"], r["to_id"]) for r in g} == {("seed", "weak"), ("weak", "strong"), ("seed", "route"), ("route", "service"), ("service", "strong")}
    assert not any(r["truncated"] for r in g)
    # the sure way of three steps is cheaper than the unsure one of two
    ways = {r["path"] for r in W.subgraph_paths(nodes).collect()}
    assert "seed.ts:seed -> route.ts:route -> service.ts:service -> strong.ts:strong" in ways and not any("weak" in w and "strong" in w for w in ways)
    roles = {r["id"]: (r["role"], r["rank"]) for r in nodes.collect()}
    assert roles["seed"] == ("target", 1) and roles["route"][0] == "route" and roles["service"][0] == "route" and roles["strong"][0] == "callee"
    got = W.signals(nodes, edges).first()
    assert (got["routes"], got["tests"], got["unresolved"]) == (2, 0, 2) and got["inbound_callers_checked"] == "pass" and got["verdict"] == "not_enough_context" and got["confidence"] == "low"
    assert W.explain(W.signals(nodes, edges)).first()["risk_score"] == 2 * 2 + 3 * 1 + 3 * 2 + 2


def test_subgraph_roles_files_and_lone_seeds(spark):
    s = _sym(spark, ("t", "src/t.ts", "t", "function", 1, 2, False), ("c", "src/c.ts", "c", "function", 1, 2, True), ("k", "tests/t.test.ts", "k", "file", 1, 2, False), ("lone", "src/l.ts", "lone", "function", 1, 2, False))
    e = _edges(spark, ("c", "t", "calls", "src/c.ts", "src/t.ts", "t", "resolved", 3), ("t", "k", "tested_by", "src/t.ts", "tests/t.test.ts", None, "test_import", None), ("t", "db", "writes_to", "src/t.ts", None, "table", "resource_static", 4))
    nodes, edges = _subgraph(spark, s, e, "t")
    n = {r["id"]: r for r in nodes.collect()}
    assert {k: v["role"] for k, v in n.items()} == {"t": "target", "c": "caller", "k": "test", "db": "resource"}
    assert n["db"]["kind"] == "external" and n["db"]["file_path"] == "src/t.ts" and n["db"]["symbol_name"] == "table" and n["db"]["confidence"] == "medium" and n["k"]["symbol_name"] is None
    got = W.signals(nodes, edges).first()
    assert got["verdict"] == "safe_to_edit_after_reading" and got["confidence"] == "high" and got["passed"] == 6
    why = {r["file_path"]: r for r in W.why_files(nodes, edges).collect()}
    assert why["src/t.ts"]["roles"] == "target,resource" and why["src/t.ts"]["confidence"] == "high" and why["tests/t.test.ts"]["evidence"] == "tested_by"
    assert edges.where("kind = 'writes_to'").first()["metadata"] == '{"resolution":"resource_static"}'
    lone_nodes, lone_edges = _subgraph(spark, s, e, "lone")
    assert [r["id"] for r in lone_nodes.collect()] == ["lone"] and lone_edges.count() == 0
    assert W.signals(lone_nodes, lone_edges).first()["verdict"] == "investigate_only"
    ghost = W.signals(*_subgraph(spark, s, e, "ghost")).first()
    assert ghost["primary_owner_found"] == "fail" and ghost["verdict"] == "not_enough_context"


def test_walk_is_capped():
    rows = [("p", "s", "s", f"n{i}", i, "s", f"n{i}", "calls", "high", 35) for i in range(100)]
    out = W.walk(pd.DataFrame(rows, columns=["project_id", "seed", "node", "next", "edge_seq", "source_id", "target_id", "kind", "confidence", "cost"]))
    assert (out["part"] == "edge").sum() == 31 and (out["part"] == "node").sum() == 32 and out["truncated"].all()


@pytest.mark.parametrize("seed", range(6))
def test_walk_costs_are_those_of_the_cheapest_ways(seed):
    """On graphs under the caps a forward walk reaches all it can, each node by a way of least cost."""
    r = random.Random(seed)
    names = [f"n{i}" for i in range(12)]
    edges = [(i, r.choice(names), r.choice(names), r.choice([20, 35, 60])) for i in range(16)]
    rows = [("p", "n0", a, b, i, a, b, "calls", "high", c) for i, a, b, c in edges] + [("p", "n0", "n0", None, None, None, None, None, None, None)]
    out = W.walk(pd.DataFrame(rows, columns=["project_id", "seed", "node", "next", "edge_seq", "source_id", "target_id", "kind", "confidence", "cost"]), hops=99)
    best = {"n0": 0}
    for _ in names:
        for _, a, b, c in edges:
            if a in best and best[a] + c < best.get(b, 1 << 30):
                best[b] = best[a] + c
    nodes = out[out["part"] == "node"].set_index("node")
    assert set(nodes.index) == set(best)
    price = {}
    for _, a, b, c in edges:
        price[a, b] = min(c, price.get((a, b), 1 << 30))
    for n, p in nodes["path"].items():
        assert p[0] == "n0" and p[-1] == n and sum(price[x] for x in zip(p, p[1:])) == best[n]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=0, max_size=12), st.integers(10, 120))
def test_budget_folds(spark, costs, budget):
    d = spark.createDataFrame([("g", i, c) for i, c in enumerate(costs)], "g string, o int, c int")
    used, want = 0, []
    for i, c in enumerate(costs):
        if used + c <= budget:
            used += c
            want.append(i)
    assert sorted(r["o"] for r in C.within_budget(d, ["g"], "o", "c", budget).collect()) == want
    used, want = 0, []
    for i, c in enumerate(costs):
        if used + c > 0.9 * budget:
            if want:
                break
            if len(costs) > 1 and c > budget:
                continue
        used += c
        want.append(i)
    assert sorted(r["o"] for r in C.within_budget(d, ["g"], "o", "c", budget, stop=0.9).collect()) == want


def test_points_in_spans(spark):
    r = random.Random(1)
    spans = [(i, a, a + r.choice([0, 1, 5, 15, 16, 17, 300, 5_000, 2_000_000_000]) if i % 9 else a - 1) for i, a in enumerate(r.choice([-3, 0, 1, 15, 16, 4_000, 70_000]) + r.randrange(20) for _ in range(60))] + [(90, None, 5), (91, 5, None)]
    points = [(i, r.choice([-2, 0, 7, 16, 31, 4_100, 70_010, 2_000_000_100])) for i in range(40)] + [(99, None)]
    p = spark.createDataFrame([("f", *x) for x in points], "f string, p int, at int")
    s = spark.createDataFrame([("f", *x) for x in spans], "f string, s int, a int, b int").where("b IS NULL OR b < 2147483647")
    got = [(x["p"], x["s"]) for x in R.around(p, s, ["f"], "at", "a", "b").collect()]
    want = {(i, j) for i, at in points for j, a, b in spans if at is not None and a is not None and b is not None and a <= at <= b}
    assert len(got) == len(set(got)) and set(got) == want


def test_chunks_of_symbols_and_references(spark):
    s = spark.createDataFrame([("p", "1", "a/x.ts", "f", "function", 3, 9), ("p", "2", "a/x.ts", "g", "function", 20, 30), ("p", "3", "a/x.ts", "h", "function", 90, 99), ("p", "4", "a/x.ts", "a/x.ts", "file", 1, 99), ("p", "5", "b/x.ts", "f", "function", 1, 2)], "project_id string, id string, file_path string, name string, kind string, start_line int, end_line int")
    c = spark.createDataFrame([("p", "a/x.ts", "c1", "f", 50, 60), ("p", "a/x.ts", "c2", None, 15, 40), ("p", "a/x.ts", "c3", "z", 1, 2)], "project_id string, file_path string, id string, symbol_name string, start_line int, end_line int")
    assert {(r["id"], r["chunk_id"], r["tier"]) for r in R.chunk_of_symbol(s, c).collect()} == {("1", "c1", 1), ("2", "c2", 2), ("3", "c3", 3)}
    refs = spark.createDataFrame([("p", "r1", "a/x.ts", "f"), ("p", "r2", "a/x.ts", "none"), ("p", "r3", "x.ts", "f"), ("p", "r4", "y.ts", "f"), ("p", "r5", "x.ts", None), ("p", "r6", None, "f")], "project_id string, ref string, path string, name string")
    got = {r["ref"]: (r["symbol_id"], r["tier"]) for r in R.resolve_references(refs, s).collect()}
    assert got == {"r1": ("1", 1), "r2": ("4", 2), "r3": ("5", 3), "r5": ("4", 4)}


def test_routes_meet_by_equality(spark):
    routes = spark.createDataFrame([(x,) for x in ("/a/:id", "/a/b", "/:x/b", "/:x/:y", "/a/:id/c", "/a/b")], "route string")
    asked = spark.createDataFrame([(x,) for x in ("/a/b", "/a/q", "/z/b", "/z/z", "/a/1/c", "/a/1/d", "/a", "/:x/b")], "request string")
    got = {r["request"]: r["route"] for r in R.match_routes(asked, routes).collect()}
    assert got == {"/a/b": "/a/b", "/a/q": "/:x/:y", "/z/b": "/:x/:y", "/z/z": "/:x/:y", "/a/1/c": "/a/:id/c", "/:x/b": "/:x/b"}


def test_snippets(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t")).alias("x")).first()["x"]
    assert one(C.skeleton, "export function a(x) {\n  return x;\n}\nclass B {\n}\n") == "export function a(x) ...\nclass B ..."
    long = "\n".join(["x;"] * 145 + ["}"] + ["y;"] * 60)
    assert one(C.truncated, long).endswith("... [truncated: +60 lines]") and one(C.truncated, "a" * 9000).endswith("+1000 chars]") and one(C.truncated, "short") == "short"
    assert one(lambda t: C.focus_line(C.lines_of(t), "load user"), "a\nuser\nload user\nload user") == 3 and one(lambda t: C.focus_line(C.lines_of(t), "zzz"), "a") is None
    assert one(lambda t: C.focus_window(t, F.lit(1), 2), "a\nb\nc") == "a\nb\n..."


def test_evaluation(spark):
    res = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "c", 4)], "query string, item string, rank int")
    want = spark.createDataFrame([("q1", "b"), ("q2", "c"), ("q3", "z")], "query string, item string")
    s = summary(ranks(res, want), 3)
    r = s.first()
    assert (r["queries"], round(r["hit_rate"], 4), round(r["mrr"], 4)) == (3, 0.3333, 0.25)
    assert {x["metric"]: x["passed"] for x in gate(s, {"mrr": (">=", 0.2), "hit_rate": (">=", 0.9)}).collect()} == {"mrr": True, "hit_rate": False}


def test_reuse_drafts_take_hits_owners_and_duplicates(spark):
    sym = [
        ("p", "s1", "src/bucket.ts", "takeBucket", "function", None, False, 1), ("p", "s2", "src/a.ts", "refill", "function", None, False, 1), ("p", "s3", "src/b.ts", "again", "function", None, False, 1),
        ("p", "s4", "src/c.ts", "open", "function", None, True, 1), ("p", "s5", "src/d.ts", "alone", "function", None, False, 1), ("p", "s6", "src/own.ts", "x1", "function", None, False, 1),
        ("p", "s7", "src/own.ts", "x2", "function", None, False, 2), ("p", "s8", "src/own.ts", "x3", "function", None, False, 3), ("p", "s9", "src/e.ts", "twin", "function", None, False, 1),
    ]
    s = spark.createDataFrame(sym, "project_id string, id string, file_path string, name string, kind string, signature string, exported boolean, start_line int")
    hits = spark.createDataFrame([("p", "src/a.ts", "refill", 0.75), ("p", "docs/x.md", None, 0.01)], "project_id string, file_path string, name string, score double")
    own = spark.createDataFrame([("p", "src/a.ts", 4.0), ("p", "src/own.ts", 2.0), ("p", "notes.md", 1.0)], "project_id string, file_path string, score double")
    m = spark.createDataFrame([("s2",)], "id string")
    drafts = S.reuse_drafts(s, hits, own, m, ["bucket"])
    key = lambda df: {(r["file_path"], r["name"]): (r["id"], r["score"]) for r in df.collect()}
    assert key(drafts) == {
        ("src/bucket.ts", "takeBucket"): ("s1", 1.2), ("src/a.ts", "refill"): ("s2", 6.0), ("src/c.ts", "open"): ("s4", 0.5), ("docs/x.md", None): (None, 0.1),
        ("src/own.ts", "x1"): ("s6", 2.5), ("src/own.ts", "x2"): ("s7", 2.5), ("notes.md", None): (None, 1.0),
    }
    st = spark.createDataFrame([("s1", "f"), ("s2", "f"), ("s3", "f"), ("s4", "g"), ("s9", "g"), ("s5", "h"), ("s6", None)], "symbol_id string, body_fingerprint string")
    got = key(S.with_duplicates(drafts, s, st))
    want = key(drafts) | {("src/bucket.ts", "takeBucket"): ("s1", 4.8), ("src/a.ts", "refill"): ("s2", 7.5), ("src/b.ts", "again"): ("s3", 5.1), ("src/e.ts", "twin"): ("s9", 1.5)}
    assert got == want
