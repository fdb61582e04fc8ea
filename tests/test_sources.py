"""Extraction, topology, store, streams, settings and the facade."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from orrery.api import index_tree, scan_tree
from orrery.plans.scans import changed_paths
from orrery.sources import config
from orrery.sources.extract import blocks, extract_references, references_of, symbols_of
from orrery.sources.store import Conflict, Store, liveness, merge_dirty, retrying, with_vectors
from orrery.sources.topology import facts_of, link_calls, routes, topology_facts
from orrery.streaming import events as V
from orrery.streaming import watcher as W

TS = "import { b } from './b';\nexport function load(id) {\n  // fake() call\n  return b(id, \"x(y)\");\n}\nexport class Box {\n  open(n) {\n    return load(n);\n  }\n}\n"


def test_symbols():
    assert [(s[0], s[1], s[2], s[3], s[4]) for s in symbols_of(TS, "typescript")] == [("load", "function", 2, 5, True), ("Box", "class", 6, 10, True), ("open", "method", 7, 9, False)]
    assert [(s[0], s[1], s[4]) for s in symbols_of("class A:\n    def _m(self): pass\nasync def f(): ...\n", "python")] == [("A", "class", True), ("_m", "function", False), ("f", "function", True)]
    assert [(s[0], s[1], s[4]) for s in symbols_of("package a\ntype T struct {\n}\nfunc (t *T) Run() {\n}\nfunc help() {\n}\n", "go")] == [("T", "type", True), ("Run", "method", True), ("help", "function", False)]
    assert [(s[0], s[1], s[4]) for s in symbols_of("pub struct S { a: u8 }\nimpl S {\n  pub fn go(&self) {}\n}\nfn x() {}\n", "rust")] == [("S", "type", True), ("S", "class", False), ("go", "function", True), ("x", "function", False)]
    assert [(s[0], s[1], s[4]) for s in symbols_of("public class C {\n  public int size() {\n    return 1;\n  }\n}\n", "java")] == [("C", "class", True), ("size", "method", True)]
    assert symbols_of("def (", "python") == [] and symbols_of("# T", "markdown") == []


def test_references():
    got = references_of(TS, "typescript")
    assert ("imports", "./b", 1, None) in got and ("calls", "b", 4, "load") in got and ("calls", "load", 8, "open") in got and not any(r[1] in ("fake", "y", "load") and r[2] == 2 for r in got)
    assert ("calls", "g", 3, "f") in references_of("from .m import g\ndef f():\n    return g()\n", "python")


def test_blocks(spark):
    d = spark.createDataFrame([("p", "a", "\n".join(str(i) for i in range(170))), ("p", "e", ""), ("p", "b", "\n\n"), ("p", "n", None)], "project_id string, path string, content string")
    assert [(r["path"], r["start_line"], r["end_line"]) for r in blocks(d).orderBy("path", "start_line").collect()] == [("a", 1, 80), ("a", 81, 160), ("a", 161, 170)]


def test_topology(spark):
    server = "const base = '/api';\napp.get('/api/users/:id', h);\napp.use('/admin', guard);\nbus.on('user.created', f);\nconst r = await prisma.user.findMany();\nawait db.order.create({});\n"
    client = "const root = '/api/users';\nfetch(`${root}/${id}`);\naxios.post('/api/nowhere');\nlet u = unknown; fetch(u);\n"
    assert {f[:3] for f in facts_of(server, "typescript")} == {("route", "get", "/api/users/:id"), ("uses_middleware", "use", "/admin"), ("handles_event", "on", "user.created"), ("reads_from", "findMany", "user"), ("writes_to", "create", "order")}
    t = spark.createDataFrame([("p", "s.ts", "typescript", server), ("p", "c.ts", "typescript", client), ("q", "s.ts", "typescript", "app.post('/api/nowhere', h)"), ("p", "app/api/stripe/webhook/route.ts", "typescript", "x")], "project_id string, path string, language string, content string")
    f = topology_facts(t)
    r = routes(f, t)
    assert {(x["project_id"], x["route"], x["webhook"]) for x in r.collect()} == {("p", "/api/users/:id", False), ("q", "/api/nowhere", False), ("p", "/api/stripe/webhook", True)}
    assert [(x["path"], x["route"], x["route_file"]) for x in link_calls(f, r).collect()] == [("c.ts", "/api/users/:id", "s.ts")]
    assert facts_of("const a = '/x'; const a = '/y'; fetch(a)", "typescript") == []


def test_diffs(spark):
    diff = "diff --git a/a.ts b/a.ts\n--- a/a.ts\n+++ b/a.ts\n@@ -1 +1 @@\n-x\n+y\ndiff --git a/gone b/gone\n--- a/gone\n+++ /dev/null\ndiff --git a/o b/n\nrename from o\nrename to n\n"
    assert spark.createDataFrame([(diff,)], "d string").select(changed_paths(F.col("d")).alias("x")).first()["x"] == ["a.ts", "n"]


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# c\nbudget_chars='9'\nexport quiet_ms=7\n\nbad line\n")
    s = config.settings({"quiet_ms": 1}, {"ORRERY_BATCH_FILES": "3"}, config.read_env_file(str(tmp_path / ".env")))
    assert s["quiet_ms"] == ("1", "override") and s["batch_files"] == ("3", "env") and s["budget_chars"] == ("9", "file") and s["max_file_bytes"] == ("512000", "default")
    roots = ["/w/a", "/w/a/b", "/w/c"]
    assert config.resolve_workspace(config.Hints(file_path="/w/a/b/x.ts"), roots) == "/w/a/b" and config.resolve_workspace(config.Hints(), ["/w/a"]) == "/w/a"
    for h in (config.Hints(), config.Hints(file_path="/else/x"), config.Hints(root="/w")):
        with pytest.raises(config.Ambiguous):
            config.resolve_workspace(h, roots)


def test_git_remote(spark):
    text = '[core]\n\tbare = false\n[remote "origin"]\n\tfetch = x\n\turl = ssh://git.example/a.git\n[branch "m"]\n'
    d = spark.createDataFrame([(text,), ("[core]\n",)], "t string").select(config.git_remote(F.col("t")).alias("u"))
    assert [r["u"] for r in d.collect()] == ["ssh://git.example/a.git", None]


def _tree(root, files):
    for p, t in files.items():
        f = root / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_incremental_index_equals_a_full_one(spark, tmp_path):
    tree = tmp_path / "tree"
    first = {"src/auth.ts": "import { p } from './profile';\nexport function login() {\n  return p();\n}\n", "src/profile.ts": "export function p() {\n  return 1;\n}\n", "src/__init__.py": "z = 1\n", "src/alone.py": "def x():\n    return y()\n", ".env": "S=1", "node_modules/m/i.js": "x", "src/a.generated.ts": "x"}
    _tree(tree, first)
    store = Store(spark, str(tmp_path / "store"))
    assert index_tree(store, str(tree), "p")["analysed"] == 4
    assert {r["reason"] for r in store.read("skipped_files").collect()} == {"sensitive file policy", "ignored directory: node_modules", "generated file policy"}
    assert [r["target_file"] for r in store.read("edges").where("kind = 'imports'").collect()] == ["src/profile.ts"]
    (tree / "src/profile.ts").write_text("export function p() {\n  return q();\n}\nexport function q() {}\n")
    (tree / "src/alone.py").unlink()
    again = index_tree(store, str(tree), "p")
    assert again["analysed"] == 2  # the changed file and the one that imports it
    full = Store(spark, str(tmp_path / "full"))
    index_tree(full, str(tree), "p")
    for t, cols in {"files": ["path", "content_hash"], "symbols": ["id", "file_path", "name"], "edges": ["source_file", "target_name", "line"], "chunks": ["file_path", "start_line", "content_hash"]}.items():
        assert _rows(store.read(t), *cols) == _rows(full.read(t), *cols), t
    one, _ = scan_tree(spark, str(tree), "p", paths=spark.createDataFrame([("src/auth.ts",), ("../x",), ("/abs",)], "path string"))
    assert [r["path"] for r in one.collect()] == ["src/auth.ts"]


def test_store_projects_dirty_and_reset(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    p = lambda t, n: spark.createDataFrame([("p", n, t)], "project_id string, display_name string, created_at_ms long")
    s.upsert_projects(p(1, "a"))
    s.upsert_projects(p(9, "b"))
    assert tuple(s.read("projects").first()) == ("p", "b", 1)
    ev = lambda *r: spark.createDataFrame(r, "project_id string, path string, first_ms long, last_ms long, events long")
    s.record_events(ev(("p", "a", 5, 6, 2), ("p", "b", 1, 1, 1)))
    s.mark(spark.createDataFrame([("p", "a")], "project_id string, path string"), "dead_letter", "failed")
    s.record_events(ev(("p", "b", 0, 9, 3)))
    got = {r["path"]: (r["first_ms"], r["last_ms"], r["events"], r["status"]) for r in s.read("dirty_files").collect()}
    assert got == {"a": (5, 6, 2, "dead_letter"), "b": (0, 9, 4, "pending")}
    s.clear(spark.createDataFrame([("p", "a")], "project_id string, path string"))
    assert s.read("dirty_files").count() == 1
    g = s.manifest()["generation"]
    s.reset("p")
    assert s.read("projects").count() == 0 and s.manifest()["generation"] == g + 1


def test_vectors_are_reused_by_hash(spark, tmp_path):
    schema = "id string, project_id string, file_path string, language string, symbol_name string, content string, content_hash string"
    c = spark.createDataFrame([("1", "p", "a", "go", None, "x", "h1"), ("2", "p", "b", "go", "s", "y", "h2"), ("3", "p", "b", "go", "s", "y", "h2")], schema)
    s = Store(spark, str(tmp_path / "v"))
    t = spark.createDataFrame([("p", "a"), ("p", "b")], "project_id string, path string")
    state = s.sync_vectors(c, t, lambda texts: [[1.0, float(len(x))] for x in texts], model="m", width=2)
    assert state["fresh"] and s.read("semantic_chunks").count() == 3

    def none(texts):
        raise AssertionError("nothing new to embed")

    moved = spark.createDataFrame([("9", "p", "a", "go", None, "x", "h1")], schema)
    assert s.sync_vectors(moved, spark.createDataFrame([("p", "a")], "project_id string, path string"), none, model="m", width=2)["fresh"]
    assert _rows(s.read("semantic_chunks"), "id") == [("2",), ("3",), ("9",)]
    bad = s.sync_vectors(moved.withColumn("content_hash", F.lit("new")), t, none, model="m", width=2)
    assert not bad["fresh"] and bad["error"] and s.read("semantic_chunks").count() == 3
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 2:
            raise ConnectionError
        return [[1.0]] * len(texts)

    assert retrying(flaky, ["a"]) == [[1.0]] and len(calls) == 2
    with pytest.raises(ValueError):
        retrying(lambda t: [[float("nan")]], ["a"])
    assert with_vectors(c.limit(0), None, none).count() == 0


def test_journal_replay_and_stream_equal_the_batch(spark, tmp_path):
    j = str(tmp_path / "j")
    V.append_journal(spark, j, [{"event": "change", "file_path": " a\\b.ts ", "observed_at_ms": i} for i in (5, 3)] + [{"event": "nope", "file_path": "x", "observed_at_ms": 1}])
    with open(os.path.join(j, "broken.json"), "w") as f:
        f.write("{broken\n")
    V.append_journal(spark, j, [{"event": "add", "file_path": "c.ts", "observed_at_ms": 9}, {"event": "add", "file_path": "a/b.ts", "observed_at_ms": 1}])
    batch = V.journal(spark, j)
    assert [r["file_path"] for r in V.replay_paths(batch).collect()] == ["a/b.ts", "c.ts"]
    fold = lambda b: V.dirty_state(b, "file_path", "observed_at_ms")
    cols = ("file_path", "first_seen", "last_seen", "events")
    run = lambda: V.run_available(V.journal(spark, j, stream=True), fold, lambda a, b: V.merge_state(a, b, "file_path"), "t", str(tmp_path / "st"))
    assert _rows(run(), *cols) == _rows(fold(batch), *cols) == [("a/b.ts", 1, 5, 3), ("c.ts", 9, 9, 1)]
    # started again: with nothing new, with more, and after a batch that died while it wrote its state
    assert _rows(run(), *cols) == [("a/b.ts", 1, 5, 3), ("c.ts", 9, 9, 1)]
    V.append_journal(spark, j, [{"event": "unlink", "file_path": "c.ts", "observed_at_ms": 20}])
    assert _rows(run(), *cols) == [("a/b.ts", 1, 5, 3), ("c.ts", 9, 20, 2)]
    V.append_journal(spark, j, [{"event": "add", "file_path": "d.ts", "observed_at_ms": 30}])

    def dies(batch):
        raise ValueError("killed")

    with pytest.raises(Exception):
        V.run_available(V.journal(spark, j, stream=True), dies, lambda a, b: a, "t", str(tmp_path / "st"))
    os.makedirs(tmp_path / "st" / "state" / "2", exist_ok=True)  # what a killed write leaves: a folder without its mark
    assert _rows(run(), *cols) == [("a/b.ts", 1, 5, 3), ("c.ts", 9, 20, 2), ("d.ts", 30, 30, 1)]
    assert V.truncate_journal(spark, j) == 5 and not [n for n in os.listdir(j) if not n.startswith(".")]


def test_streams_are_restarted_with_growing_waits():
    told, tries = [], []

    def start():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("down")
        return "up"

    assert V.restarting(start, lambda n, e: told.append((n, str(e))), base_s=0.001) == "up" and told == [(1, "down"), (2, "down")]
    with pytest.raises(OSError):
        V.restarting(lambda: (_ for _ in ()).throw(OSError("x")), lambda n, e: None, attempts=2, base_s=0.001)


def test_commits_touch_their_buckets_only_and_never_collide(spark, tmp_path):
    s, other = (Store(spark, str(tmp_path / "b"), buckets=8, keep=2) for _ in range(2))
    paths = [f"src/{i}.ts" for i in range(40)]
    rows = lambda v, ps: spark.createDataFrame([("p", x, v) for x in ps], "project_id string, path string, content_hash string")
    touched = lambda ps: spark.createDataFrame([("p", x) for x in ps], "project_id string, path string")
    s.upsert({"files": rows("a", paths)}, touched(paths))
    before = s.manifest()["tables"]["files"]["parts"]
    s.upsert({"files": rows("b", paths[:1]).withColumn("more", F.lit(1))}, touched(paths[:1]))
    after = s.manifest()["tables"]["files"]["parts"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) > 4
    assert _rows(s.read("files"), "path", "content_hash", "more") == sorted([(p, "b" if p == paths[0] else "a", 1 if p == paths[0] else None) for p in paths])
    s.upsert({"files": rows("x", [])}, touched(paths[:2]))
    assert s.read("files").count() == 38
    stale = other.manifest()
    s.upsert({"files": rows("c", paths[5:6])}, touched(paths[5:6]))
    with pytest.raises(Conflict):
        other._publish(stale | {"generation": stale["generation"] + 1})
    s.upsert({"files": rows("x", [])}, touched(["p"]), full=True)
    assert s.read("files").count() == 0
    assert len(os.listdir(tmp_path / "b" / "manifests")) - sum(n.startswith(".") for n in os.listdir(tmp_path / "b" / "manifests")) == 2


def test_one_writer_at_a_time_and_its_status(spark, tmp_path):
    root = str(tmp_path / "w")
    a, b = W.WriterLock(spark, root, "a"), W.WriterLock(spark, root, "b")
    assert W.watch_status(spark, root, None, at=0).first()["watcher"] == "not_running"
    assert a.acquire(1_000) and not b.acquire(2_000) and a.heartbeat(5_000) and not b.heartbeat(5_000)
    dirty = spark.createDataFrame([("p", "x", "pending"), ("p", "y", "dead_letter"), ("p", "z", "indexing"), ("p", "w", "pending")], "project_id string, path string, status string")
    now = W.watch_status(spark, root, dirty, at=6_000).first()
    assert (now["watcher"], now["owner"], now["heartbeat_age_ms"], now["pending"], now["indexing"], now["dead_letter"]) == ("running", "a", 1_000, 2, 1, 1)
    assert W.watch_status(spark, root, dirty, at=90_000).first()["watcher"] == "stale"
    assert b.acquire(90_000) and not a.heartbeat(90_001)
    b.release(91_000)
    assert W.watch_status(spark, root, dirty, at=91_000).first()["watcher"] == "dead" and a.acquire(91_001)
    f = spark.createDataFrame([("p", "x", "indexed"), ("p", "q", "indexed"), ("p", "z", "deleted")], "project_id string, path string, status string")
    assert _rows(W.with_dirty(f, dirty), "path", "status") == [("q", "indexed"), ("x", "stale"), ("z", "deleted")]


def test_progress_is_kept_and_tailed(spark, tmp_path):
    root = str(tmp_path / "p")
    assert W.progress(spark, root) is None and W.progress_tail(spark, root).count() == 0
    for i in range(7):
        assert W.record_progress(spark, root, {"phase": "scan", "done": i, "total": 7}, at=i) == i + 1
    assert W.progress(spark, root) == {"phase": "scan", "done": 6, "total": 7, "at_ms": 6}
    assert [(r["n"], r["done"]) for r in W.progress_tail(spark, root, 3).collect()] == [(5, 4), (6, 5), (7, 6)]


def test_coalescing_and_retries(spark):
    e = spark.createDataFrame([("d", p) for p in ("a", "a", "b", "c", "z")], "day string, path string")
    got = V.coalesce_events(e, ["day"], "path", keep=3, burst=2).orderBy("path").collect()
    assert [(r["path"], r["events"], r["burst"], r["dropped"]) for r in got] == [("a", 2, True, 1), ("b", 1, True, 1), ("c", 1, True, 1)]
    t = dt.datetime
    o = spark.createDataFrame([("a", t(2024, 1, i), True) for i in range(1, 6)] + [("b", t(2024, 1, 1), True), ("b", t(2024, 1, 2), False), ("b", t(2024, 1, 3), True), ("c", t(2024, 1, 1), False)], "path string, at timestamp, bad boolean")
    count = lambda x: V.retry_counts(x, "path", "at", F.col("bad"))
    state = lambda c: {x["path"]: (x["attempts"], x["status"], x["delay_ms"]) for x in V.retry_state(c, "path").collect()}
    assert state(count(o)) == {"a": (5, "dead_letter", None), "b": (1, "pending", 750)}
    for day in range(1, 7):  # however the stream is cut into batches
        cut = F.col("at") < F.lit(t(2024, 1, day))
        assert state(V.merge_retries(count(o.where(cut)), count(o.where(~cut)), "path")) == state(count(o))


def test_dirty_merge_and_liveness(spark):
    a = spark.createDataFrame([("p", "x", 2, 2, 1, "indexing", "r")], "project_id string, path string, first_ms long, last_ms long, events long, status string, reason string")
    b = spark.createDataFrame([("p", "x", 1, 5, 2, "pending", None)], "project_id string, path string, first_ms long, last_ms long, events long, status string, reason string")
    assert tuple(merge_dirty(a, b).first()) == ("p", "x", 1, 5, 3, "pending", None)
    d = spark.createDataFrame([(None, False), (5, True), (40_000, False), (5, False)], "age long, gone boolean")
    assert [r[0] for r in d.select(liveness(F.col("age"), F.col("gone"))).collect()] == ["not_running", "dead", "stale", "running"]


def test_late_events_fall_behind_the_watermark(spark, tmp_path):
    src = tmp_path / "ev"
    schema = "ts timestamp, value double"
    t = lambda *a: dt.datetime(2024, 1, 1, *a)
    for i, rows in enumerate(([(t(10, 1), 1.0), (t(10, 59), 1.0)], [(t(14, 0), 1.0)], [(t(10, 5), 9.0), (t(15, 0), 1.0)], [(t(20, 0), 1.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"b{i}"))
    s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))
    out = str(tmp_path / "out")
    q = V.tumbling(s, "ts", "1 hour", "30 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["start"].hour: r["events"] for r in spark.read.parquet(out).collect()}
    assert got[10] in (2, 3) and got[14] == 1


def test_registered_coalescing_keeps_the_first_1000_paths(spark, tmp_path):
    from orrery.plans import streams

    rows = [(u, dt.datetime(2024, 1, day, 12)) for day, n in ((1, 1003), (2, 100), (3, 99)) for u in range(n)]
    spark.createDataFrame(rows, "user_id long, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    got = {}
    for r in streams.QUERIES["a18_event_bursts"](spark, str(tmp_path)).collect():
        n, last, _, _ = got.get(r["day"], (0, "", None, None))
        got[r["day"]] = (n + 1, max(last, r["path"]), r["burst"], r["dropped"])
    assert got == {"2024-01-01": (1000, "00000999", True, 3), "2024-01-02": (100, "00000099", True, 0), "2024-01-03": (99, "00000098", False, 0)}
