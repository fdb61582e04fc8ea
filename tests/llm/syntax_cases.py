"""Well-formed and broken texts, by extension."""

WELL_FORMED = {
    'java': [
        'class A { void f() { a >>= 2; x[0] >>>= 1; b <<= 1; a.b >>>= c; } }',
        'class A { boolean f(Object o) { return o instanceof P(_) && o instanceof P(int x, _); } }',
        'class A { int x = a > b ? c : d; boolean y = a >= b; List<List<List<String>>> z; }',
        'class A { void f() { Foo<Bar>.Baz x = null; int[] a[] = {}; foo.<String>bar(); new int[]{1}[0]++; } }',
        'class A { Function<A, B> f = A::new; Supplier<int[]> g = int[]::new; void h() { ((Runnable) () -> {}).run(); } }',
        'public interface X { private static int f() { return 1; } default void g() {} int C = 3; }',
        'class A { @Override public <T> T f(T... x) throws E { return x[0]; } }',
        'class A<T extends B & C> { class D {} enum F { X { int g() { return 1; } }, Y; } record R<T>(T t) { R { } static int z; } }',
        'class A { void f() { switch (x) { case 1, 2: break; case 3: { } default: return; } int y = switch (x) { case A -> 1; default -> { yield 2; } }; } }',
        'class A { char c = \'\\\'\'; String s = "a\\"b"; long l = 0xFFL, m = 1_000; double d = 1e-3, e = .5f, g = 1.; int o = 017; }',
        'class A { void f() { if (a) b(); else if (c) d(); else { } while (x-- > 0); do x(); while (y); for (;;) { break; } } }',
        'class A { A() { super(); } A(int x) { this(); } { init(); } static final int X; }',
        '@interface B { String value() default ""; int[] x() default {1, 2}; }',
        'class A { void f() { var x = (a) + b; var y = (int) c; var z = (String) d; var w = (A & B) e; var v = -(x); } }',
        'class A { int f() { return a ? b : c ? d : e; } }',
        'class A { void f() { label: for (String s : list) { continue label; } synchronized (x) { } throw new X("a" + b); } }',
        'class A { void f() { try { } catch (final A | B e) { } finally { } try (a; var b = c()) { } } }',
        'package x;;import a.b;; class A {};',
        'sealed interface S permits A, B {} non-sealed class A implements S {} final class B implements S {}',
        'class A { Object o = new Object() { int x; }; int a = b[c[d]]; int e = f.g().h[1].i; }',
        'class A { void f() { int a = b < c ? 1 : 2; boolean d = e < f && g > h; foo(a < b, c > d); i = j << k >> l >>> m; } }',
        'class A { var x = a -> b -> c; Comparator<X> c = Comparator.<X, Y>comparing(q -> q.z()).reversed(); }',
        'class A { void f() { record P(int x) {} enum E {A} interface I {} class L {} final int z = 1; } }',
        'class A { int yield; void f() { yield = 3; var.foo(); record = 1; } }',
        'class A { void f() { assert x : "y"; ; ; return; } abstract void g(); native int h(); }',
        'class A { void f(A this, int... x) {} int[] g()[] { return null; } }',
        'class A { void f() { x.new B(); A.this.y(); A.super.z(); int.class.getName(); String[].class.x(); } }',
    ],
    'js': [
        'if (a) /re/.test(b)',
        'function f(){}\n/re/.test(b)',
        'if (a) {\n}\n/x/.test(b)',
        'while (x) /a[/]b/.exec(y)',
        'x = {} / 2',
        'x = function(){} / 2',
        'a = b\n/c/d',
        '(a) / b / c',
        'f() / 2 / g',
        'for (const x of y) /z/.test(x)',
        'a = {b: 1}\nc = d / e / f',
        'x => {}\n/re/.test(y)',
        'switch (a) { case 1: {} /re/.test(b); break }',
        'class A { m() {} get x() { return 1 } set x(v) {} static async *g() {} }\n/re/.test(x)',
        'do {} while (x) /re/.test(y)',
        'a = (b) / c; d = [1] / 2; e = f[0] / g',
        'label: {\n}\n/re/.test(a)',
        'return_ = x / y / z',
        'x = a ? {} / 1 : b / c',
        '({}) / 2',
        'if (x) { y } else { z }\n/q/.test(w)',
        'try { } catch { } /re/.test(x)',
        '`${a / b}` / 2',
        'x = y => { return 1 }\n/re/g.test(z)',
        'foo(function () { return 1 } / 2)',
        'async function f() { for await (const x of y) {} await z; (await a) ** 2 }',
        'a ?? (b || c); (a && b) ?? c; (-1) ** 2; 2 ** -1; 2 ** 3 ** 4',
        'for (const x of (y, z)) {}',
        'for (var i = 0, j = 1; i < j; i++);',
        'for (let in obj) ;',
        'let x = 0n, y = 10n, z = 0.5, w = .5e3, v = 5., u = 0xFn, t = 1_000',
        "import('x').then(); import.meta.url",
        "class A { #p; has(o) { return #p in o } static { this.x = 1 } 'quoted'() {} 12() {} [c]() {} get; set; static; async; get = 1; static x; }",
        '({ get: 1, set: 2, async: 3, get a() { return 1 }, set a(v) {}, async b() {}, *c() {}, async *d() {}, get [e]() { return 1 }, if: 1, class: 2 })',
        'var { a, b: { c = 1 }, ...d } = e, [f, , g = 2, ...h] = i',
        'function f({ a, b } = {}, [c] = [], ...d) {}',
        'a = async () => {}; b = async x => x; c = async (x, y) => { await x }',
        "x = a ? b : c ? d : e; y = (a, b); z = void 0; typeof x === 'y'; delete a.b",
        'label: for (;;) { continue label }\nbreak_: while (1) break break_',
        'a\n++b\nc',
        'var a = 1, b\nlet c\nconst d = 2',
        "export { a as b, c as default } from 'd'; export * from 'e'; export * as f from 'g'; export default class {}",
        "import a, { b as c, default as d } from 'e'; import * as f from 'g'; import 'h'; import j from './j.json' with { type: 'json' }",
        'if (a) b; else c',
        'if (a) ; else ;',
        "throw new Error('x')",
        'with (a) b',
        'debugger',
        'async\nfunction f() {}',
        'let async; async = 1; of = 2; get = 3; let_ = 4',
        'yield_ = function* () { yield; yield a; yield* b; const x = yield c }',
        'a?.b?.[c]?.(d); e ??= f; g ||= h; i &&= j; k **= 2; l >>>= 1; m >>= 1; n <<= 1',
        'tag`a${b}c`; String.raw`\\u`',
        '// only a comment',
        '/* a */',
        'x',
        'a = /[/\\]]+/.test(b) ? /=/ : /a/g',
        'var re = /=(.*)/, x = a /= 2',
        'function* g() { yield /re/ }',
        'x = !/a/.test(y) && /b/.test(z)',
        'return_(/a/)',
        '[/a/, /b/]',
        '({ a: /b/ })',
        'a = b ? /c/ : /d/',
        '() => /a/',
        'case_: x',
        'var \\u0061b = 1',
        '\'use strict\'; "a\\\nb"',
        'a.if.class.return',
        'if (1) function f() {}',
        'x = <div/>',
        'x = cond && <A b={1} {...c}>t {d}</A>',
        'const f = () => <p>{/* c */}</p>',
        'const x = await y',
        'export const a = 1, b = 2',
        'export async function f() {}',
        'export default async () => {}',
        'export default (a)',
        'a = b ? (c, d) : e => f',
        'a = b ? c => d : e',
        'for (x in y) ;for (x.y of z) ;for ([a, b] of c) ;for ({ a } of b) ;',
        'for (var x in y, z) ;',
        'if (a) { return_ } \n[1].map(f)',
        'x = y / z; // re/\nw = 1',
        'x++ / 2',
        'x = a++ / b',
        'function f() { }\n/a/.test(b)',
        '1',
        'var x = function () { /re/.test(a) }',
        'a = [function(){}, /b/]',
        'a(/b/)\n(/c/)',
    ],
    'ts': [
        'type A<T> = T extends infer U extends string ? U : never',
        'type B<T> = T extends (infer U extends string) ? U : never',
        'type C<T> = T extends [infer H extends string, ...infer R] ? H : R',
        'let x: A extends B ? C : D',
        'function f(this: Foo, a?: string, ...b: number[]): asserts a is string {}',
        'abstract class A<T = string> extends B<T> implements C, D<E> { private static readonly x?: number; constructor(private readonly a: string, public b = 1) { super() } abstract m(): void; declare y: string; override z!: number; get q(): number { return 1 } set q(v: number) {} [k: string]: any; static async *gen<T>(x: T): AsyncGenerator<T> {} }',
        'interface A<T> extends B, C<T> { (x: number): string; new (x: number): A; readonly [k: string]: unknown; m?<U>(u: U): void; get a(): string; set a(v: string); p: { q: number }; }',
        "enum A { B, C = 'x', D = 1 << 2 } const enum E { F } declare enum G { H }",
        "declare module 'x' { export const a: number; export default a } declare global { interface Window { x: 1 } } declare namespace N.M { let y: string }",
        "import type { A } from 'c'; import { type D, E } from 'f'; import G = require('h'); export type { I } from 'j'; export = K",
        'let a = <T,>(x: T) => x, b = async <T,>(x: T): Promise<T> => x, c = (x: number, y?: string): x is 5 => true',
        'let a = b as const, c = d as unknown as E, f = g satisfies H, i = j!, k = l!.m![0]!()',
        'type A = { [K in keyof T as `x${K & string}`]-?: T[K] } & { -readonly [P in B]+?: C }',
        "type A = `a${B}c${D}`; type F = typeof import('x'); type G = import('y').Z<string>; type H = typeof a.b<string>",
        "type A = [a: string, b?: number, ...c: boolean[]]; type B = readonly string[]; type C = unique symbol; type D = -1 | 2n | 'x'",
        'type F = (a: string, ...b: number[]) => void; type G = new (...a: any[]) => T; type H = abstract new () => U; type I = { (): void }',
        'function f(a: string): string; function f(a: number): number; function f(a: any) { return a }',
        'let x = y < z && a > b; f(a < b, c > d); const m = new Map<string, Array<Set<number>>>(); g<A, B>(c); h<D>`x`',
        'class A { constructor(); constructor(a?: any) {} m(): void; m(a?: any): void {} }',
        "@Dec() class A { @Input() a: string; @Out b = new E<string>(); @H('x', ['y']) m(@P() p: Q) {} }",
        'export default interface A { b: string } ',
        'export abstract class A {} export declare const b: string; export enum C {}',
        'for (const [k, v] of Object.entries(x) as [string, number][]) {}',
        'let f = function <T>(this: Window, x: T): x is T { return /re/.test(y) }\n',
        'function f(): { a: number } {\n}\n/re/.test(x)',
        'class A { m(): string {\n}\n n = /re/ }',
        'namespace A { export function f() {} }\n/re/.test(x)',
        "let a: typeof b[number]; let c: A['b']['c']; let d: keyof typeof e; let g: (string | number)[]",
        "type A = | 'a' | 'b'; type B = & C & D",
        'let x = a ? (b) : c; let y = a ? (b): d => c : e',
        'let x = a ? b as C : d',
        'const { a, b }: { a: string; b: number } = c; const [d]: [string] = e',
        'var v = <any>w; var u = <A<B>>x',
        'declare function f<T>(x: T): T; declare let y: string, z: number; declare class A { m(): void; p: string }',
        'let fn: typeof f<string>; let x = f<string>; let y = a.b<C>;',
        'if (a < b || c > d) {}',
        'type Rec<T> = T extends object ? { [K in keyof T]: Rec<T[K]> } : T',
        'accessor_ = 1; class A { accessor x = 1; static accessor y = 2 }',
        'let x: A.B.C<D>[] | null | undefined = null',
        'try { } catch (e: unknown) { }',
        'type A = (new () => B) | (() => C)',
        'let b: any',
        'using_ = 1',
        'export type A = B;\nexport interface C { d: E; f?: () => void, g(): H }',
        'type G<in out T, const U extends readonly unknown[]> = T',
        "let o = { m<T>(x: T): T { return x }, async n(): Promise<void> {}, get p(): string { return '' } }",
        'class A<T> { private x: Array<Map<string, T>> = []; y?: (a: T) => void; z = (a: T): a is T => true }',
        'const f = async <T>(x: T): Promise<T> => { return await x }',
    ],
    'go': [
        'package a\nconst x int = 1\nconst ( A = iota; B; C )\nconst (\n\tX, Y = 1, 2\n\tZ, W\n)\n',
        'package a\nfunc f() { const c = 1; const d float64 = 2 }\n',
        'package a\nvar x, y int\nvar z = 1\nvar (\n\ta int\n\tb = 2\n)\ntype (\n\tT int\n\tU = V\n)\n',
        'package a\nfunc F[T any, U comparable](x T, y ...U) (T, error) { return x, nil }\ntype S[T any] struct{ v T }\nfunc (s S[T]) G() {}\n',
        'package a\nfunc f() { for i := range 10 { _ = i }; for range ch {}; for ; ; {}; for x < y {}; for k, v := range m {} }\n',
        'package a\nfunc f() { switch x := y; x {\n\tcase 1, 2:\n\tdefault:\n\t}\n\tswitch {\n\tcase a > b:\n\t}\n\tswitch y := x.(type) {\n\tcase nil:\n\t}\n}\n',
        'package a\nfunc f() { go func() {}(); defer x.y(); ch <- 1; v := <-ch; v, ok := <-ch; L:\n\tfor {\n\t\tbreak L\n\t}\n\tgoto L\n}\n',
        'package a\nvar x = map[string][]int{"a": {1, 2}, "b": nil}\nvar y = [...]string{2: "x"}\nvar z = struct{ a int }{1}\nvar w = &T{a: 1}\nvar f = func(a int) (b int) { return a }\n',
        'package a\ntype I interface {\n\tM()\n\tio.Reader\n\t~int | ~string\n}\ntype F func(int) (string, error)\ntype C chan<- int\ntype D <-chan int\ntype P *T\ntype A [3]int\n',
        'package a\nfunc f() { if x := y(); x != nil { } else if z { } else { }; a[1:2:3] = b; c.(T).d(); *p = 1; x.y[z]++ ; if (T{}) == x {} }\n',
        'package a\nimport "b"\nimport (\n\tc "d"\n\t_ "e"\n)\n',
        'package a\nvar r = \'a\'\nvar s = `raw\n"x"`\nvar n = 0x1p-2 + 1_000 + 0b11 + 0o7 + 1i + .5\n',
        'package a\nfunc f() { select { case x := <-c: case d <- 1: default: } }\n',
        'package a\nfunc f() {\n\tx := g(\n\t\t1,\n\t\t2,\n\t)\n\ty := []T{\n\t\t{1},\n\t}\n}\n',
        'package a\nfunc (r *R) m(a, b int, c string) {}\nfunc g(int, string) {}\nfunc h(...int)\n',
    ],
    'rs': [
        'fn f() { let x = if a { b } else { c }; match x { Some(y) if y > 1 => {}, None => return, _ => () } }',
        "impl<'a, T: Clone + 'a> A<'a, T> for B<T> where T: C<D = E> { const X: usize = 1; type Y = Z; fn f(&mut self, x: impl Fn(i32) -> i32) -> &'a dyn G { self.x?.y()?; &self.z } }",
        'use std::{collections::{HashMap, hash_map::Entry}, io::{self, Read as _}}; pub use self::x::*; extern crate foo;',
        "fn f() { let Some(x) = y else { return }; if let A { b, c: 1..=2, .. } = d {} while let Some(_) = it.next() {} 'a: loop { break 'a 1; } }",
        'macro_rules! m { ($($x:expr),* $(,)?) => { $( f($x); )* }; } m![1, 2]; m! { x }',
        'pub struct A<T>(pub T, B) where T: C; pub struct D { pub(crate) x: [u8; 4], y: (i32,), z: fn(&str) -> bool } enum E { A, B(C), D { e: F } = 2 } union U { a: u32 }',
        'async fn f() { g().await?; let x = async move { 1 }; } unsafe fn h() { unsafe { *p = 1 } } const fn i() {} extern "C" fn j() {}',
        'fn f() { let c = |x: i32, y| -> i32 { x + y }; let d = || 1; let e = move |&z| z; a.iter().map(|x| x * 2).collect::<Vec<_>>(); }',
        'trait A: B + C { type D: E; fn f(&self) -> Self::D where Self: Sized; fn g() {} const H: i32; }',
        '#[derive(Debug, Clone)] #[cfg(test)] mod tests { use super::*; #[test] fn t() { assert_eq!(1, 2, "x {}", y); } }',
        "fn f<const N: usize, T = i32>(x: [T; N], (a, b): (i32, i32), Foo { c, .. }: Foo, _: &dyn for<'a> Fn(&'a str)) -> impl Iterator<Item = T> + '_ { return x }",
        'static X: &str = "a"; const Y: [i32; 2] = [1, 2]; static mut Z: Option<Box<dyn Fn()>> = None; type A<\'a> = &\'a str; pub(in crate::x) fn g() {}',
        'fn f() { x.0.1 = 2; *y += 1; a <<= 1; b >>= 2; c |= d & e ^ !f; if a && b || !c {} return; }',
        'fn f() { let v: Vec<Vec<u8>> = vec![vec![0; 3]; 4]; let s = S { a, b: 1, ..Default::default() }; println!("{x:?}"); x.await }',
    ],
}

BROKEN = {
    'js': [
        'return 1',
        'a ?? b || c',
        'a && b ?? c',
        '-1 ** 2',
        'for (const x of y, z) {}',
        'for (let x = 1 of y);',
        'async function f() { for await (x in y){} }',
        'class A { get a(b){} }',
        'class A { set a(){} }',
        'switch (a) { default: default: }',
        'import()',
        '08n',
        '1.5n',
        'var a = 0_1',
        'x = ({ get a(b) {} })',
        'if (a) { return 1 }',
        'class A { static { return 1 } }',
        'await x ** 2',
        '(a',
        'a)',
        '{',
        'var 1a',
        'let x = ;',
        'a b',
        'if a {}',
        'function () {}',
        'class {}',
        'for (;) {}',
        'x = [1, 2',
        "'open",
        '`open',
        '/re',
        'a = /',
        'case 1:',
        'break break',
        'try {}',
        'catch (e) {}',
        'else {}',
        'new',
        'a..b',
        'a.',
        '?.b',
        'x ? y',
        'x = { a: }',
        'x = { a b }',
        "import a b from 'c'",
        "import { a } 'b'",
        'export { a',
        'export a',
        'const a',
        'const { a }',
        'let [b]',
        'async function',
        'function f( {}',
        'function f(a, ...b, c) {}',
        'class A { x y }',
        'class A extends {}',
        'throw\nx',
        '1++',
        '++1',
        'a => { ',
        '() => ',
        '<div>',
        '<a></b>',
        '<a b=></a>',
        '@',
        '#x = 1 +',
        'yield: yield ;;)',
        'with a {}',
        'do x while y',
    ],
    'ts': [
        'type A = ',
        'interface A',
        'let x: = 1',
        'enum { A }',
        'function f(a: ) {}',
        'let x: string | = 1',
        'type A<> = B',
        'class A { private }}',
        'let x = a as',
        'interface A { b: }',
        'abstract class',
        'type A = { [K in] : B }',
        'namespace {',
        'import type from',
        'let x: (a: string) =',
        'function f(): {',
        'let y: [a',
        'let z: A<B',
        'x = <T>',
        'const a: number',
        'let f = (a: ) => b',
        '@',
        'class A implements {}',
        'enum A { B = }',
    ],
    'go': [
        'package a\nconst x int\n',
        'package a\nconst x\n',
        'package a\nconst (\n\tx int\n)\n',
        'package\n',
        'package a\nfunc {}\n',
        'package a\nvar\n',
        'package a\nfunc f() { if { } }\n',
        'package a\nfunc f() { for { \n',
        'package a\ntype T struct { a }}\n',
        'package a\nfunc f() { a := }\n',
        'package a\nfunc f() { return 1 2 }\n',
        'package a\nfunc f( {\n}\n',
        'package a\nimport b\n',
        'package a\nvar x = [1, 2]\n',
        'package a\nfunc f() { x = 1 y = 2 }\n',
        'package a\nfunc f() { else { } }\n',
        "package a\nvar s = 'ab'\n",
        'package a\nfunc f() { switch x { case 1 } }\n',
        'package a\nfunc f() { while x { } }\n',
        'package a\nx = 1\n',
        'package a\nclass A {}\n',
    ],
    'java': [
        'class A { void f() { a >> 2; } }',
        'class A { void f() { a + b; } }',
        'class A { void f() { int; } }',
        'class A { int f( { } }',
        'class A { void f() { if x { } } }',
        'class A { void f() { return } }',
        'class A { void f() { for (int i = 0; i < n; i++ { } } }',
        'class A',
        'class A {',
        'class A { int x = ; }',
        'class A { int x }',
        'import a.b',
        'package;',
        'class A { void f() { x = ; } }',
        'class A { void f() { else { } } }',
        'class A { void f() { try { } } }',
        'class A { void f() { case 1: } }',
        'class A extends { }',
        'enum { A }',
        'interface A { int f() }',
        "class A { String s = 'ab'; }",
        'class A { void f() { foo(a, ); } }',
        'class A { void f() { new; } }',
        'class A { void f() { int[] a = {1, 2; } }',
        'void f() {}',
        'class A { void f() { switch (x) { 1 -> 2; } } }',
        'class A { private int; }',
        'class A { void f() { a.; } }',
        'class A { void f() { (a; } }',
        'class A { void f() { do { } } }',
    ],
    'rs': [
        'fn',
        'fn f(',
        'fn f() {',
        'fn f() { let = 1; }',
        'struct',
        'struct A { x }',
        'enum A { x: }',
        'impl {',
        'fn f() { match { } }',
        'fn f() { if { } }',
        'use a',
        'fn f() { x = ; }',
        'fn f() { a b; }',
        'let x = 1;',
        'fn f() -> {}',
        'fn f() { 1 + }',
        'fn f() { let x: = 1; }',
        'mod',
        'trait A { fn }',
        'fn f() { for x y {} }',
        'fn f(x) {}',
        'fn f() { println!("a" }',
        'fn f() { "open }',
        'pub pub fn f() {}',
        'fn f() { else {} }',
        'type A',
        'const X = ;',
        'static X: i32',
    ],
}
