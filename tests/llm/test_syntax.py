import pytest

from orrery.llm.syntax import EXTENSIONS, check_files, parses, rates, verdict
from syntax_cases import BROKEN, WELL_FORMED

GOOD = {
    "ts": [
        "", "\ufeffconst a: number = 1\n", "let f = <T,>(x: T, ...r: string[]): x is string => typeof x === 'string'", "type A<T> = T extends (infer U)[] ? U : { readonly [K in keyof T]?: T[K] };",
        "export abstract class B<T extends object = {}> extends C<T> implements D, E.F {\n  private readonly x?: Map<string, Array<number>> = new Map<string, Array<number>>();\n  static { init(); }\n  constructor(private a: number, b = 2) { super() }\n  get y(): number { return this.#z >>> 2 }\n  abstract run(): void;\n  @dec() async *gen<K>(k: K) { yield* k }\n  [key: string]: unknown\n}",
        "const r = a < b && c > d ? x as unknown as Y : z!; label: for (const [k, v] of Object.entries(q)) { if (k) continue label }", "enum E { A = 1, B = 'x' } declare module 'm' { export function f(a: string): void }",
        "import type { A } from './a'; import b, * as c from 'c'; export * as d from 'd'; export default async function () {}", "const t = `a ${b ? `c ${d}` : '}'} e`; const re = /[/}]+\\/(?<n>x)/gu.test(s)",
        "function over(a: string): void\nfunction over(a: number): void\nfunction over(a: any) {}", "const x = { async *[Symbol.iterator]() {}, get a() { return 1 }, b, ...c, 'd-e': 1 }", "let v = <any>w; const g = f<string>('x'); if (a) b; else c\nvar d = a\n++b",
    ],
    "tsx": ["const a = <div className=\"x\" {...p}>{list.map((i) => <Li key={i}>{i} &amp; more</Li>)}<br/></div>;", "const b = <><A.B on={() => { go() }} /></>"],
    "js": ["#!/usr/bin/env node\n'use strict'\nmodule.exports = { a: 1 }", "a ??= b?.c?.[d]?.(e) ** 2; for (;;) { break } do { x-- } while (x) y()", "class A { #p = 1; static async *m() { for await (const x of y) yield x } 'q' = 2\n z }", "x = a / b / c; y = (1) / 2; var z = function* () { return /re/ }, w = async x => await x; switch (q) { case 1: default: }"],
    "py": ["", "async def f(*, a: int = 1, **k) -> None:\n    match a:\n        case {'x': [1, *r]} if r: pass\n    return (yield)\n", "x = f'{a!r:>{w}}' '''b'''\n@d\nclass C[T](B, metaclass=M): ...\n"],
    "rs": [
        "", "#![allow(x)]\nuse a::{b::*, c as d};\n/* x /* nested */ y */\npub(crate) fn f<'a, T: Into<String> + ?Sized, const N: usize>(x: &'a mut [T; N]) -> Result<Vec<Vec<u8>>, Box<dyn Error + 'a>> where T: Clone { let r#type = r#\"a\"b\"#; Ok(x.iter().map(|y| y.clone().into()).collect::<Vec<_>>()) }",
        "impl<T> Tr for S<T> { type O = <T as X>::Y; fn g(&self) -> i32 { if let Some(x) = self.a && x > 1 { return -1 } match self { S { a, .. } if *a > 0 => 1, S::<T> { b: 0..=9 | 20, .. } => { 2 } _ => unreachable!() } } }",
        "fn main() { let v = vec![1, 2]; 'o: loop { while let Some(x) = v.pop() { if x == b'\\'' as u8 { break 'o } } } let s = P { x: 1, ..d }; println!(\"{}\", s.0.1); let c = move |a: u8| -> u8 { a >> 1 }; for i in 0..n { x[i] <<= 2; } }", "struct A(pub u8); struct B; enum E { X = 1, Y { a: u8 }, Z(B) } macro_rules! m { ($x:expr) => { $x } } static mut G: [u8; 2] = [0; 2]; extern \"C\" { fn h(); }",
    ],
    "go": [
        "package a\n", "package a\n\nimport (\n\t. \"fmt\"\n\tb \"c\"\n)\n\ntype S[T any] struct {\n\t*E\n\tx, y map[string][]int `json:\"x\"`\n\tf func(int, ...string) (a, b int)\n}\n\nfunc (s *S[T]) M(a, b int, c ...string) (err error) {\n\tdefer func() { recover() }()\n\tfor i, v := range s.x {\n\t\tif w, ok := v.(int); ok && w < 1 {\n\t\t\tcontinue\n\t\t} else if x := (S[int]{}); x.a {\n\t\t}\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase x := <-d:\n\tdefault:\n\t}\n\tswitch t := y.(type) {\n\tcase int, *E:\n\t\tfallthrough\n\tdefault:\n\t}\n\treturn nil\n}\n",
        "package a\n\nvar x = []T{{1, 2}, {a: 3}}\nvar y = map[string]func(){\"a\": func() {}}\nconst (\n\tA = iota\n\tB\n)\n\nfunc f() { go g(x[1:2], []byte(\"s\")...); L: for { break L } ; a, b = b, a; c &^= 1; x.y++ }\n", "package a\ntype I interface {\n\tM(int) string\n\t~int | string\n}\n",
    ],
    "java": [
        "", "package a.b;\nimport static c.D.*;\n@A(x = {1, 2}) public sealed class E<T extends F & G<? super T>> extends H<T[]> implements I permits J {\n  private final int[][] k = {{1}, {2, }}, l[] = new int[3][];\n  static { m(); }\n  E(int... a) throws N, O { this(a, 1); }\n  <U> List<Map<String, U>> p(final @Q U u) { return (List<Map<String, U>>) u; }\n  int r() default 1;\n}",
        "enum A implements B { C(1) { void d() {} }, E; int f; }\nrecord G<T>(int a, T... b) { G { if (a < 0) throw new X(); } }\n@interface H { int v() default 1; }",
        "class A { void f() { for (int i = 0, j = 1; i < 3; i++, j--) ; for (var x : y) { } int z = (int) -1 + (a) + b >>> 2; Runnable r = () -> { }; F g = (p, q) -> p::r; String[]::new.x(); } }".replace(" String[]::new.x();", " s(String[]::new);"),
        "class A { int f(Object o) { return switch (o) { case Integer i when i > 1 -> i; case P(int x, var y) -> { yield x; } case null, default -> throw new X(); }; } void g() throws E { try (var a = b(); c) { d(); } catch (F | G e) { } finally { } l: do { if (o instanceof String s && !s.isEmpty()) continue l; } while (true); synchronized (this) { assert a : b; } String t = \"\"\"\n  x \"y\" \\\"\"\" z\n  \"\"\"; } }",
    ],
    "json": ['{"a": [1, -2.5e3, "\\u00e9", null, true], "a": {}}', "[]", " 3 "],
}
BAD = {
    "ts": ["const a = ", "function f( {", "let x = 'open", "if (a { }", "class A { b( }", "interface { }", "const a = 1 const b = 2", "<<<<<<< HEAD\nlet a\n=======\nlet b\n>>>>>>> x\n", "type A = ;", "foo(a,,b)", "`${a", "a b", "let x: = 1", "return )", "for (const x of) {}", "import { a from 'b'", "x = {a: 1,, b}"],
    "tsx": ["const a = <div><span></div></span>", "const a = <div>", "const a = <div x=></div>"],
    "js": ["interface A { b: string }", "let a: number = 1", "function f(a: string) {}", "const a", "a = 1 2", "1 = a", "new", "async function", "export { a", "let let1 = ; "],
    "py": ["def f(:\n  pass", "x = (1", "  x = 1\ny", "print 'a'", "<<<<<<< a\nx=1\n=======\n"],
    "rs": ["fn main() {", "let x = 1;", "fn f() { let x = ; }", "fn f( { }", "struct A { x u8 }", "fn f() { a b }", "use a::;", "fn f() -> { }", "fn f() { match x { 1 => } }", "pub", "fn f() { 'a }"],
    "go": ["", "func f() {}", "package a\nfunc f() { x := }", "package a\nfunc f()\n{\n}\n", "package a\nvar x int = \n", "package a\nfunc f() { if x { }", "package a\nimport a", "package a\nfunc f() { a b }\n", "package a\nx := 1\n", "package a\nfunc f() { s := \"open\n}\n"],
    "java": ["class A { void f() { int x = ; } }", "class A { void f() { g() } }", "class { }", "class A { int x }", "public void f() { }", "class A { void f() { a + b; } }", "import a", "class A { void f() { for (;) {} } }", "class A { String s = \"open; }", "class A { void f( { } }", "class A extends { }"],
    "json": ["", "{'a': 1}", "{\"a\": 1,}", "[1 2]", "{\"a\": NaN}", "\ufeff{}", "// x\n{}", "{\"a\": 01}"],
}


@pytest.mark.parametrize("ext,src", [(e, s) for table in (GOOD, WELL_FORMED) for e, v in table.items() for s in v])
def test_well_formed(ext, src):
    assert parses(src, EXTENSIONS[ext], ext == "tsx")


@pytest.mark.parametrize("ext,src", [(e, s) for table in (BAD, BROKEN) for e, v in table.items() for s in v])
def test_broken(ext, src):
    assert not parses(src, EXTENSIONS[ext], ext == "tsx")


def test_findings():
    assert verdict("package a;\npublic class B { int c; }\n", "py")[1:3] == ("wrong_extension", "java")
    assert verdict("def f(x):\n    return x\n", "ts")[1:3] == ("wrong_extension", "python")
    assert verdict("a = 1\n<<<<<<< HEAD\nb = 2\n=======\nc = 3\n>>>>>>> d\n", "py")[1] == "merge_conflict"
    assert verdict("function f() {\n  g(", "js")[1] == "truncated"
    assert verdict("function f() { ] }\n", "js")[1] == "corrupt"
    assert verdict('{"a": [1, 2]}', "py") == (True, "ok", "python", "json")  # a literal, likelier data than a program
    assert verdict("const a = 1\n", "ts") == (True, "ok", "typescript", None)


def test_operator(spark):
    rows = [("r", "a.py", "x = 1", "k"), ("r", "a.py", "x = 1", "k"), ("r", "b.py", "x = (", "k"), ("r", "c.md", "x = (", "k"), ("r", None, "x", "k"), ("r", "d.py", None, "k"), ("r", "e.GO", "", "k"), ("r", "f.js", "a(" * 3 + "1" + ")" * 3 + ";\n" * 200_000, "k"), ("r", "two.py", "x = 1", "k"), ("r", "two.py", "x = ", "k")]
    files = spark.createDataFrame(rows, "repo string, path string, content string, finding string")
    got = {r["path"]: r["well_formed"] for r in check_files(files).collect()}
    assert got == {"a.py": True, "b.py": False, "e.GO": False, "f.js": True, "two.py": False}
    said = spark.createDataFrame([("r", "a.py", "Go"), ("r", "b.py", None)], "project_id string, path string, language string")
    warn = spark.createDataFrame([("r", "parser_fallback", ["b.py", "zz"]), ("r", "parser_fallback", None)], "project_id string, kind string, samples array<string>")
    r = {x["language"]: x for x in rates(check_files(files), said, warn).collect()}["python"]
    assert (r["files"], r["broken"], r["broken_and_warned"], r["mislabelled"]) == (3, 2, 1, 1)


def test_empty(spark):
    assert check_files(spark.createDataFrame([], "repo string, path string, content string")).count() == 0


@pytest.mark.parametrize("ext", ["ts", "js", "java", "go", "rs", "py", "json"])
def test_every_cut_of_a_bracketed_text_is_broken(ext):
    src = {"ts": "f({a: [1, (x: number) => { return `${x}` }]})", "js": "f({a: [1, (x) => { return `${x}` }]})", "java": "class A { void f() { g(new int[] {1}, x -> { return x; }); } }", "go": "package a; func f() { g([]int{1}, func(x int) { h(x) }) }", "rs": "fn f() { g(vec![1], |x: u8| { h(x) }) }", "py": "f({'a': [1, (lambda x: (x,))]})", "json": '{"a": [1, {"b": "c"}]}'}[ext]
    first = next(i for i, c in enumerate(src) if c in "([{" and (ext != "go" or c == "{"))
    assert parses(src, EXTENSIONS[ext])
    assert not any(parses(src[:n], EXTENSIONS[ext]) for n in range(first + 1, len(src)))


def test_depth_is_no_grammar_error(spark):
    deep = {"py": "x = a" + ".b()" * 30_000 + "\n", "json": "[" * 200_000 + "]" * 200_000, "ts": "(" * 20_000 + "1" + ")" * 20_000}
    rows = [("r", f"deep.{e}", t) for e, t in deep.items()] + [("r", "bad.py", "def f(:\n"), ("r", "two.json", "{"), ("r", "two.json", deep["json"]), ("r", "deep_bad.json", deep["json"][:-1])]
    rows += [("r", "number.py", "x = " + "1" * 5_000 + "\n"), ("r", "number.json", "1" * 5_000)]
    got = {r["path"]: (r["well_formed"], r["finding"]) for r in check_files(spark.createDataFrame(rows, "repo string, path string, content string")).collect()}
    assert got["deep.py"] == (None, "too_deep") and got["bad.py"][0] is False and got["two.json"][0] is False and got["deep_bad.json"][0] is False
    assert all(got[k][0] for k in ("deep.json", "deep.ts", "number.py", "number.json"))
