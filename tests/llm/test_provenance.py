import pytest

from orrery.llm.provenance import Classifier, classify_files, data_share, hints, minified

CODE = "import { a } from './a';\n\nexport function run(x: number) {\n  const y = a(x);\n  return y + 1;\n}\n"
OWN = {"my-proj"}


def _why(path, text, lang="typescript"):
    return Classifier().reason(path, text, lang, OWN)


@pytest.mark.parametrize("text", [
    "// Code generated by tool. DO NOT EDIT.\n" + CODE, CODE + "\n/*\n * @generated\n * by gen from x.idl\n */\n", "// <auto-generated> x </auto-generated>\n" + CODE, "// AUTOGENERATED by x v1.2\n" + CODE,
    "// This file was produced automatically from a.sql; manual changes will be overwritten.\n" + CODE, "// Do not modify this file by hand. Regenerate it with `make a`.\n" + CODE, "// Fichier produit par x a partir de y.proto, ne pas modifier\n" + CODE,
    "// Code generated\n// by tool x.\n// Do not edit.\n" + CODE,
])
def test_generated(text):
    assert _why("src/a.ts", text) == "generated"


@pytest.mark.parametrize("text", [
    CODE, CODE + "export const H = '// Code generated by ' + 't' + '. DO NOT EDIT.';\n", "// Writes the generated client. Do not edit its output by hand, edit this template.\n" + CODE, CODE + "const t = `\n// Code generated by x. DO NOT EDIT.\n`;\n",
    "// The a table is generated elsewhere; this module only reads it.\n" + CODE, "// Copyright (c) the my-proj team.\n" + CODE, "// Our own replacement for zlib, written after the license review.\n" + CODE, "// Checks whether a bundle is minified.\n" + CODE,
    CODE + "export const LONG = '" + "word " * 300 + "';\n", CODE * 3 + "export const STEPS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12];\n", "",
])
def test_hand_written(text):
    assert _why("src/generated/vendor/build/a.ts", text) is None


@pytest.mark.parametrize("text", [
    "/*\n * SPDX-License-Identifier: MIT\n * Part of the zed library, release 1.2.3\n */\n" + CODE, "// zed v1.2.3\n// (c) the zed authors, released under the MIT license\n" + CODE, "/*\n * zed 1.2.3 - https://zed.example/\n * @license ISC\n */\n" + CODE,
    "// Copyright (c) zed contributors. Licensed MIT.\n// See the LICENSE file of the upstream distribution.\n" + CODE, "// Taken unchanged from zed 1.2.3 (MIT)\n" + CODE,
])
def test_third_party(text):
    assert _why("src/a.ts", text) == "third_party"


def test_paths_and_shapes():
    assert _why("node_modules/zed/lib/a.ts", CODE) == _why("vendor/zed@1.2.3/a.ts", CODE) == _why("third_party/zed-1.2.3/a.ts", CODE) == _why("extern/zed/1.2.3/src/a.ts", CODE) == "third_party"
    assert _why("vendor/zed/a.ts", CODE) is None and _why("packages/vendor/lib/2v1/a.ts", CODE) is None
    assert _why("a_pb2.py", "x = 1\n", "python") == _why("a.pb.go", "package a\n", "go") == _why("a.generated.ts", CODE) == "generated"
    small = "var a=function(b){for(var c=0;c<b.length;c++)b[c]+=1};" * 20
    assert minified(small, "javascript") and not minified(CODE * 20, "typescript") and not minified(small, "python")
    assert _why("a.ts", "export const T = [\n" + ", ".join(f'"k-{i}"' for i in range(60)) + "\n];\n") == "data" and data_share(CODE) < 0.2
    assert _why("a.py", "T = {" + ", ".join(f"'k{i}': 0x{i:02x}" for i in range(60)) + "}\n", "python") == "data"


def test_operator(spark):
    big = CODE.replace("run", "copied") + "// pad\n" * 80
    rows = [(f"r{i}", "s/c.ts", big, "k") for i in range(3)] + [("r0", "s/c.ts", big, "k"), ("r1", "b.ts", big + "(", "k"), ("r2", "b.ts", big + "(", "k"), ("r3", "b.ts", big + "(", "k")]
    rows += [("r0", "a.ts", CODE, "k"), ("r1", "a.ts", CODE, "k"), ("r2", "a.ts", CODE, "k"), ("r0", "x.json", "{}", "k"), ("r0", None, "x", "k"), ("r0", "n.py", None, "k"), ("r0", "e.py", "", "k"), ("r0", "g.py", "# @generated\nx = (", "k"), ("zz", "own.py", "# Copyright (c) the zed team.\nx = 1\n", "k"), ("r0", "own.py", "# Copyright (c) the zed team.\nx = 1\n", "k")]
    files = spark.createDataFrame(rows, "repo string, path string, content string, reason string")
    projects = spark.createDataFrame([("zz", "Zed", None, 1), ("r0", None, "/w/other", 1)], "project_id string, display_name string, repo_root string, content int")
    out = classify_files(files, projects)
    got = {(r["repo"], r["path"]): (r["reason"], r["well_formed"]) for r in out.collect()}
    assert got[("r0", "s/c.ts")] == got[("r2", "s/c.ts")] == ("third_party", True) and got[("r1", "b.ts")] == ("third_party", False)
    assert got[("r0", "a.ts")] == (None, None) and got[("r0", "e.py")][0] is None and got[("r0", "g.py")] == ("generated", False)
    assert got[("zz", "own.py")][0] is None and got[("r0", "own.py")] == ("third_party", True) and len(got) == 13
    f = spark.createDataFrame([("r0", "s\\c.ts", "vendor", 10, 1)], "project_id string, path string, role string, size_bytes long, generation long")
    s = spark.createDataFrame([(None, "x", None), ("r0", "s/c.ts", "vendor file policy")], "project_id string, file_path string, reason string")
    h = {(r["repo"], r["class"], r["language"]): r for r in hints(out, f, s).collect()}
    assert h[("r0", "third_party", "typescript")]["role_set_apart"] == 1 and h[("r0", "third_party", "typescript")]["skipped"] == 1


def test_empty(spark):
    assert classify_files(spark.createDataFrame([], "repo string, path string, content string"), spark.createDataFrame([], "project_id string, display_name string, repo_root string")).count() == 0
