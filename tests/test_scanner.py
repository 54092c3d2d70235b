"""Declarations and calls of six languages against facts written by hand, and the sweep against a plain loop."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from graphloom.operators import sweep
from graphloom.plans import scan_queries
from graphloom.sources import code, scanner

CASES = {
    "go": (
        """package p
import (
\t"fmt" // "no"
\tm "a/b"
)
import "os"
type (
\tA struct { f func(int) }
\tB interface { M(x int) error }
)
type G[T any] struct{}
type C = int
func Map[K comparable, V any](m map[K]V,
\tf func(K, V) error) (out []V, err interface{ Error() string }) {
\tgo func(x int) { run(x) }(1)
\ty := []byte("f(")
\tz := string(y); q := G[int]{}
\treturn fmt.Sprint(A{}.f(1, 2)), B(nil).M(3)
}
func (G[T]) get() (a,
\tb int) { if (true) { for range (x()) {} }; return }
func noBody(a int) int
var v = func() int { return call() }
""",
        {"fmt", "a/b", "os"},
        {("A", "struct"), ("B", "interface"), ("G", "struct")},
        {"Map": (13, 19, 2, "(out []V, err interface{ Error() string })"), "get": (20, 21, 0, "(a,\n\tb int)"), "noBody": (22, 22, 1, "int")},
        {("Map", "run", "", 1), ("Map", "string", "", 1), ("Map", "Sprint", "fmt", 2), ("Map", "f", "A{}", 2), ("Map", "B", "", 1), ("Map", "M", "B(nil)", 1), ("get", "x", "", 0), (None, "call", "", 0)},
    ),
    "python": (
        '''import os, sys as s, a.b
from .. import x
from .y import (z,
    w)
@deco(1)
class K(Base):
    x = f(1,
          2)

    def m(self, *,
          a="""
def no(): pass
""", b: "Call[int]" = g(3)) -> "R":
        # h()
        if (a): return [self.n(i) for i in range(3)]

        x = 1 + \\
            k()

    async def n(self): pass
def one(): two()
print(one)
print (not(one()), lambda x: three(x))
''',
        {"os", "a.b", "..", ".y"},
        {("K", "class")},
        {"m": (10, 18, 4, '"R"'), "n": (20, 20, 1, ""), "one": (21, 21, 0, "")},
        {(None, "deco", "", 1), (None, "f", "", 2), ("m", "g", "", 1), ("m", "n", "self", 1), ("m", "range", "", 1), ("m", "k", "", 0), ("one", "two", "", 0), (None, "print", "", 1), (None, "print", "", 2), (None, "one", "", 0), (None, "three", "", 1)},
    ),
    "javascript": (
        """import a, { b } from "m1";
import 'm2';
const fs = require('fs'), x = y.require('no');
const re = /function f() { \\/ [/(]/g, t = a / b / c(1);
export default async function main(a, { b = 1 }) {
  const inner = (x) =>
    go(x)
      .then(y);
  let k = function named() { return stop(); };
  const single = x => 1, [d] = e(`a ${f(`n ${g(1)}`)} h(`);
  if (a) { return; }
  label: while (b) { }
}
class K extends mixin(L) {
  constructor(a) { super(a); this.#p(1); }
  static async *gen() { yield i(1, 2); }
  get v() { return new M(j()).n(o?.p(2)); }
  field = (z) => z;
}
const obj = { method(q) { return q?.(1); }, arrow: (r) => r };
function* gen2() { }
""",
        {"m1", "m2", "fs"},
        {("K", "class")},
        {"main": (5, 13, 2, ""), "inner": (6, 8, 1, ""), "constructor": (15, 15, 1, ""), "gen": (16, 16, 0, ""), "v": (17, 17, 0, ""), "method": (20, 20, 1, "")},
        {(None, "require", "", 1), (None, "require", "y", 1), (None, "c", "", 1), ("inner", "go", "", 1), ("inner", "then", "go(x)", 1), ("main", "stop", "", 0), ("main", "e", "", 1), ("main", "f", "", 1), ("main", "g", "", 1), (None, "mixin", "", 1), ("gen", "i", "", 2), ("v", "j", "", 0), ("v", "n", "new M(j())", 1), ("v", "p", "o", 1)},
    ),
    "typescript": (
        """import type { A } from './a';
export interface I<T> { m(x: T): void; f: (y: number) => void }
export type U = 'a' | { k(): void };
export const enum E { A = f1(1) }
abstract class X { abstract no(a: number): void; yes(): { a: number } { return q(); } }
export class Y<T> implements I<T> {
  private readonly z = new Map<string, number>();
  public async m<K extends T>(
    @dec() x: K, ...rest: string[]
  ): Promise<Array<T>> {
    return this.z.get<K>("f(");
  }
  over(a: string): void;
  over(a: any): void { a.b!(1); }
}
function over2(a: string): void;
function over2(a: any): asserts a is string { }
export const arrow = async <T,>(a: T, b = (1, 2)): Promise<T> => { await w(a as T); };
""",
        {"./a"},
        {("I", "interface"), ("U", "alias"), ("E", "enum"), ("Y", "class")},
        {"yes": (5, 5, 0, "{ a: number }"), "m": (8, 12, -1, "Promise<Array<T>>"), "over": (14, 14, 1, "void"), "over2": (17, 17, 1, "asserts a is string"), "arrow": (18, 18, 2, "Promise<T>")},
        {("yes", "q", "", 0), ("m", "dec", "", 0), ("m", "get", "this.z", 1), ("arrow", "w", "", 1)},
    ),
    "rust": (
        """use std::fmt;
use a::{b, c};
use d as e;
use f::*;
mod inner;
#[derive(Debug, Default)]
pub struct P(u32);
enum E { A(u8), B { x: u8 } }
pub trait T { fn sig(&self); fn body(&self) -> u8 { self.g(1) } }
impl<'a> P {
    pub(crate) const unsafe fn new<F: Fn(i32) -> i32>(f: F, c: char) -> Option<Self>
    where
        F: Sized,
    {
        let r = r##"fn x( "# "##; let q = '"'; let n = 'n';
        if let Some(v) = go(2) { format!("{}", no(1)); }
        fn nested() { x.y::<u8>().z(3) }
        Foo::make(1);
        match q { 'a' => E::A(1), _ => Some(f(4)) }
    }
}
""",
        {"std::fmt", "inner"},
        {("P", "struct"), ("E", "enum"), ("T", "trait")},
        {"body": (9, 9, 1, "u8"), "new": (11, 20, 2, "Option<Self>"), "nested": (17, 17, 0, "")},
        {("body", "g", "self", 1), ("new", "go", "", 1), ("nested", "z", "x.y::<u8>()", 1), ("new", "Some", "", 1), ("new", "f", "", 1)},
    ),
    "java": (
        """package p;
import java.util.List;
import static a.b.C.d;
import e.f.*;
import g;
@Ann(x = "f()")
public class K<T extends Comparable<T>> {
    private final List<T> l = make(1);
    static { init(); }
    public K(int a) { this(a, 2); }
    @Override
    @SuppressWarnings("a")
    protected synchronized Map<String, int[]> get(
            @NonNull List<? super T> a, int... b)
            throws E, F {
        if (a) { for (T t : l) { new L(t).run(go(1)); } }
        return (x, y) -> { z.w(); };
    }
    abstract void none(int a);
    interface I { int m(int a, int b); default int n() { return 1; } }
    enum E { A(1), B { int o() { return 2; } }; E(int i) { } }
    int[] arr()[] { return null; }
}
""",
        {"java.util.List", "a.b.C.d", "e.f"},
        {("K", "class"), ("I", "interface"), ("E", "enum")},
        {"K": (10, 10, 1, ""), "get": (13, 18, -1, "Map<String, int[]>"), "none": (19, 19, 1, "void"), "m": (20, 20, 2, "int"), "n": (20, 20, 0, "int"), "E": (21, 21, 1, ""), "o": (21, 21, 0, "int"), "arr": (22, 22, 0, "int[]")},
        {(None, "make", "", 1), (None, "init", "", 0), ("get", "run", "new L(t)", 1), ("get", "go", "", 1), ("get", "w", "z", 0)},
    ),
}


@pytest.fixture(scope="module")
def facts(spark):
    files = [(f"f.{k}", k, CASES[k][0]) for k in CASES] + [("empty", "go", ""), ("none", "java", None), ("odd", "python", "def (((\n'''"), ("odd", "rust", "fn } ) \"")]
    return {k: x.collect() for k, x in code.facts(spark.createDataFrame(files, "path string, language string, text string")).items()}


@pytest.mark.parametrize("language", sorted(CASES))
def test_facts(facts, language):
    _, imports, types, functions, calls = CASES[language]
    own = {k: [r for r in x if r.path == f"f.{language}"] for k, x in facts.items()}
    assert {r.imp for r in own["imports"]} == imports
    assert {(r.name, r.kind) for r in own["types"]} == types
    assert {r.name: (r.line, r.end_line, r.param_count, r.result) for r in own["functions"]} == functions
    assert {(r.caller, r.callee, r.receiver, r.args) for r in own["calls"]} == calls


def test_broken_files_have_what_can_be_read(facts):
    assert {r.path for x in facts.values() for r in x} <= {f"f.{k}" for k in CASES} | {"odd"}


def brute(calls, ranges):
    out = []
    for path, line, tag in calls:
        hit = [(o, n or "") for p, o, n, a, b in ranges if p == path and None not in (path, line) and a <= line <= b]
        out.append((path, line, tag, max(hit)[1] if hit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_sweep(spark, shards, monkeypatch):
    monkeypatch.setattr(sweep, "SAMPLED", 4)
    rng = random.Random(shards)
    ranges = [(rng.choice("abc"), i, f"n{i}", a := rng.randint(0, 300), a + rng.choice((-1, 0, 3, 40, 290))) for i in range(200)] + [("a", 7, "same", 10, 300), (None, 1, "x", 0, 9)]
    calls = [(rng.choice("aaaabcd"), rng.randint(-5, 320), f"t{i % 7}") for i in range(600)] + [(None, 5, "t"), ("a", None, "t")]
    got = sweep.containing(spark.createDataFrame(calls, "path string, call_line int, tag string"), spark.createDataFrame(ranges, "path string, ord int, name string, start_line int, end_line int"), shards)
    assert got.columns == ["path", "call_line", "tag", "caller"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(calls, ranges)
    none = spark.createDataFrame([], "path string, ord int, name string, start_line int, end_line int")
    assert sweep.containing(spark.createDataFrame(calls, "path string, call_line int, tag string"), none, shards).filter("caller is not null").count() == 0


def test_a_file_of_a_million_calls(spark):
    began = time.time()
    calls = spark.range(1_000_000).select(F.lit("big").alias("path"), F.col("id").alias("call_line"))
    ranges = spark.range(10_000).select(F.lit("big").alias("path"), F.col("id").alias("ord"), F.concat(F.lit("f"), "id").alias("name"), (F.col("id") * 100).alias("start_line"), (F.col("id") * 100 + 49).alias("end_line"))
    whole = spark.createDataFrame([("big", -1, "all", 0, 899_999)], "path string, ord long, name string, start_line long, end_line long")
    got = sweep.containing(calls, ranges.unionByName(whole), 16).groupBy("caller").count().groupBy("count").agg(F.count("*").alias("n")).collect()
    assert {(r["count"], r.n) for r in got} == {(50, 10_000), (450_000, 1), (50_000, 1)} and time.time() - began < 120


def numbered(text, rng):
    """The text with other numbers, some of them equal."""
    return re.sub(r"[0-9]+", lambda _: str(rng.choice((3, 7, 12, rng.randint(0, 10**9)))), text)


def test_files_that_differ_in_numbers_have_their_own_facts():
    rng, memo = random.Random(5), scanner.Shapes(scanner.KINDS)
    odd = [("rust", "fn f<'a1>(a: &'a1 u8) { g('1', '12, h(\"%s 5\")) }\nfn f2() { x1('\\u{41}') }"), ("java", "class C1 { C1(int a) { f2(); } C2 g(int b) { } }\nclass C2 { C1(int a) {} }"), ("python", "def f1():\n    g2()\ndef f1():\n    f1(\N{MATHEMATICAL BOLD DIGIT ONE})"), ("go", "func f\0001() {}"), ("go", "")]
    cases = [(k, x[0]) for k, x in CASES.items()] + odd + [(k, head + text.replace("@P", "1").replace("@S", "2") * 3 + end) for k, (_, head, text, end) in zip(("go", "python", "javascript", "typescript", "rust", "java"), scan_queries.SAMPLES, strict=True)]
    for language, text in cases:
        for _ in range(12):
            one = numbered(text, rng)
            want = scanner.Facts(one, language, scanner.KINDS, False)
            got, texts = memo.read(one, language)
            assert texts == want.texts and got.numbers.tolist() == want.numbers.tolist() and got.again(texts) == want.again(want.texts)
    assert memo.known


def test_shapes_are_read_once(monkeypatch):
    read, memo = [], scanner.Shapes(("call",))
    monkeypatch.setattr(scanner.File, "read", lambda self, was=scanner.File.read: read.append(1) or was(self))
    for k in range(50):
        assert memo.read(f"def f{k}():\n    g{k * 7}(1)\n", "python")[1] == [f"g{k * 7}", "", f"f{k}"]
    assert len(read) == 2


def test_callers_need_no_sweep_where_paths_differ(spark, monkeypatch):
    monkeypatch.setattr(sweep, "containing", lambda *_: 1 / 0)
    rows = [("a.py", "python", "def a():\n    b()\ndef a():\n    c()\nd()\n"), (None, "python", "def a():\n    b()\n"), ("b.rb", "ruby", "def x(a)\ndef x(b)\nrequire 'q'\n")]
    got = code.facts(spark.createDataFrame(rows, "path string, language string, text string"))
    assert {(r.path, r.caller, r.callee) for r in got["calls"].collect()} == {("a.py", "a", "b"), ("a.py", "a", "c"), ("a.py", None, "d"), (None, None, "b")}
    assert sorted((r.path or "", r.name, r.line, r.param_count) for r in got["functions"].collect()) == [("", "a", 1, 0), ("a.py", "a", 1, 0), ("b.rb", "x", 1, 1)]
    assert [r.imp for r in got["imports"].collect()] == ["q"]
