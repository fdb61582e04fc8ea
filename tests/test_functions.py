"""Tokens, identifiers, stems, paths and vectors."""

import pytest
from pyspark.sql import functions as F

from orrery.functions import paths as P
from orrery.functions import text as X
from orrery.functions.stemming import stem
from orrery.functions.vectors import cosine, embed_rows, fnv1a, py_embed, stable_id


def _one(spark, column, **values):
    schema = ", ".join(f"`{k}` {'array<double>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["refreshHTTPClient user_name src/a-b.ts:12", "", "  ,, ", "XMLParser2Go", "ünïcode Wörter", "a.b c/d E_f"])
def test_tokens_agree_with_the_driver_version(spark, text):
    assert _one(spark, X.tokens(F.col("t")), t=text) == X.py_tokens(text)
    assert _one(spark, X.split_identifier(F.col("t")), t=text) == X.py_split_identifier(text)


@pytest.mark.parametrize("word,root", [("classes", "class"), ("users", "user"), ("status", "status"), ("running", "run"), ("hopping", "hop"), ("relational", "relat"), ("generalizations", "general"), ("happy", "happi"), ("dying", "die"), ("sky", "sky"), ("agreed", "agre"), ("conditional", "condit"), ("electricity", "electr"), ("skies", "sky"), ("knightly", "knight"), ("is", "is"), ("", "")])
def test_stems(word, root):
    assert stem(word) == root


@pytest.mark.parametrize("text,parts", [
    ("HTTPServer", ["http", "server"]), ("parseJSON2XML", ["parse", "json2", "xml"]), ("aBCd", ["a", "b", "cd"]), ("ABc", ["a", "bc"]), ("HTTP2Server", ["http2", "server"]), ("x_y-Z1b", ["x", "y", "z1b"]),
    ("ABCD1E", ["abcd1", "e"]), ("", []), ("__", []), ("getURLsNow", ["get", "ur", "ls", "now"]),
])
def test_identifier_parts(text, parts):
    assert X.py_split_identifier(text) == parts


def test_term_boundaries(spark):
    has = lambda text, term: _one(spark, X.contains_any_variant(F.col("t"), term), t=text)
    assert has("a react-query hook", "react") and not has("a preact-query hook", "react")
    assert has("the policies hold", "policy") and has("boxes", "box") and not has("category", "cat")
    assert has("see src/a.ts here", "src/a.ts")


def test_modes():
    assert X.resolve_mode("fix the crash in login") == "debug" and X.resolve_mode("anything") == "explain" and X.resolve_mode("x", "review") == "review"
    assert X.exact_identifiers("find loadUserName in src/app/main.ts or abc") == ["loadusername", "src/app/main.ts"]


def test_paths(spark):
    roles = {"yarn.lock": "config", "yarnxlock": "source", "a/mocks/b.ts": "generated", "x.pb.go": "generated", "_next/static/chunks/a.js": "minified", "src/a.ts": "source", "node_modules/x/a.js": "vendor", "a/dist/b.js": "build", "a.min.js": "minified", "x_pb2.py": "generated", "tests/a.py": "test", "a.spec.tsx": "test", "docs/a.md": "docs", "package.json": "config", "a/b.yaml": "config", "src\\gen\\a.go": "generated"}
    for path, role in roles.items():
        assert _one(spark, P.role_of(F.col("p")), p=path) == role, path
    assert _one(spark, P.skip_reason(F.col("p"), F.lit(9), 5), p="src/a.ts") == "file exceeds 5 bytes"
    assert _one(spark, P.skip_reason(F.col("p"), F.lit(1), 5), p="conf/.env.local") == "sensitive file policy"
    assert _one(spark, P.language_of(F.col("p")), p="A/B.TSX") == "typescript" and _one(spark, P.language_of(F.col("p")), p="Makefile") == "unknown"
    assert _one(spark, P.evidence_class(F.col("p")), p="examples/a.ts") == "fixture" and _one(spark, P.evidence_class(F.col("p")), p="a/b.mdx") == "docs"


def test_ignore_rules(spark):
    rules = P.ignore_rules("# c\n*.log\nbuild/\nsrc/*/tmp\n!keep.log\n**/x.ts\na?c\n")
    want = {"a.log": True, "build": False, "d/keep.log": False, "build/a.ts": True, "p/build/a.ts": True, "src/q/tmp/z": True, "src/q/r/tmp/z": False, "d/e/x.ts": True, "abc/z": True, "abbc": False, "ok.ts": False}
    for path, ignored in want.items():
        assert _one(spark, P.ignored_by(F.col("p"), rules), p=path) is ignored, path
    assert _one(spark, P.ignored_by(F.col("p"), []), p="a") is False


def test_routes_and_imports(spark):
    assert _one(spark, P.next_route(F.col("p")), p="src/app/(shop)/items/[id]/page.tsx") == "/items/:id"
    assert _one(spark, P.next_route(F.col("p")), p="pages/api/users/[...rest].ts") == "/api/users/:rest"
    assert _one(spark, P.next_route(F.col("p")), p="src/lib/a.ts") is None
    assert _one(spark, P.import_candidates(F.col("f"), F.col("s")), f="src/a/b.ts", s="../c/./d.js")[:2] == ["src/c/d.js", "src/c/d.ts"]
    assert _one(spark, P.import_sources(F.col("t")), t="import a from './a'; export * from \"../b\"; const c = require('./c'); import('d')") == ["./a", "../b", "./c"]
    assert _one(spark, P.api_routes(F.col("t")), t="fetch('/api/a/b') + `/api/c` + '/api/*'; api.users.list(); apiClient.orders(); billingApi.pay()") == ["/api/a/b", "/api/billing", "/api/c", "/api/orders", "/api/users"]


def test_vectors(spark):
    assert _one(spark, fnv1a(F.col("w")), w="a") == 0xE40C292C and _one(spark, fnv1a(F.col("w")), w="foobar") == 0xBF9CF968
    assert abs(_one(spark, cosine(F.col("a"), F.col("b")), a=[1.0, 0.0, 9.0], b=[1.0, 1.0]) - 0.5**0.5) < 1e-12
    assert _one(spark, cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) == 0
    assert len(_one(spark, stable_id(F.col("a"), F.col("b")), a="x", b=None)) == 24
    d = spark.createDataFrame([(1, "load the user, load!"), (2, ""), (3, None)], "id int, t string")
    got = {r["slot"]: r["weight"] for r in embed_rows(d, "id", F.col("t")).collect()}
    want = py_embed("load the user, load!")
    assert got.keys() == {i for i, x in enumerate(want) if x} and all(abs(want[i] - w) < 1e-12 for i, w in got.items())
