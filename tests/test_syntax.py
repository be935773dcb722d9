import random
import time

import pytest

from lodestone.operators import chunking, syntax

PROGRAMS = {
    "javascript": ("""import { reader } from './reader.js';
function parse(lines) {
    const limit = 3
    const trim = (line) => {
        return line.trim();
    };
    return (
        <ul title="all">
            <li>It's {lines.map(trim)}</li>
        </ul>
    );
}
function brace() { return /[{]/; }
const half = a / 2, other = b / 3
export default function () { return 1 }
const text = `a ${ [1].map(function inner() { return `}${x}` }) } {`;
class A extends mixin(B) {
  count = 0
  #hidden = 1
  static async run(a, { b }) { if (a) { return 1 } }
  get size() { return 2; }
  field = (x) => { return x; }
}
const o = { first: function () { return 1 }, second() { return 2 }, third: async () => { return 3 } };
module.exports = { a: 1 };
""", [("parse", "function"), ("trim", "function"), ("brace", "function"), ("inner", "function"), ("A", "class"), ("run", "function"), ("size", "function"), ("field", "function"), ("first", "function"), ("second", "function"), ("third", "function")]),
    "typescript": ("""interface Point {
    x: number;
}
export abstract class Grid<T extends Point> implements A, B {
    private cells: T[] = [];
    constructor(private wide: number) { super(); }
    put(cell: T): void { this.cells.push(cell); }
    fold<K, V>(f: (k: K) => V): Map<K, V> { return new Map(); }
    nearest = async (x: number): Promise<T> => { return this.cells.find(c => c.x > x); };
}
enum Color { Red }
const add: Adder = (a: number, b: number) => { return a + b; };
type X = { a: number };
""", [("Point", "class"), ("Grid", "class"), ("constructor", "function"), ("put", "function"), ("fold", "function"), ("nearest", "function"), ("Color", "class"), ("add", "function")]),
    "go": ("""package geo

import (
    "math"
)

type Circle struct {
    radius float64
}

type Shape interface {
    Area() float64
}

func Unit(label string, n int) *Circle {
    s := `}{`
    return &Circle{radius: 1}
}

func (c *Circle) Grow() (int, error) {
    f := func(x int) int { return x }
    if r := '{'; r != '}' {
        return f(1), nil
    }
    return 0, nil
}

func Keys[K comparable, V any](m map[K]V) []K {
    return nil
}
""", [("Circle", "class"), ("Shape", "class"), ("Unit", "function"), ("Grow", "function"), ("Keys", "function")]),
    "rust": ("""use std::fmt;

#[derive(Debug)]
struct Line<'a> {
    text: &'a str,
}

impl<'a> Line<'a> {
    fn blank() -> Self { Line { text: "" } }
    pub fn words(&self, sep: &'a str) -> usize { self.text.split(sep).count() }
}

impl<T: Clone> Shape for Square<T> where T: Copy { fn area(&self) -> u32 { match self { _ => 1 } } }
fn f<'b>(x: &'b str) -> char { g::<'b>(); let c = '{'; let d = '\\''; let s = r#"}" {"#; '}' }
trait Shape { fn area(&self) -> u32; fn twice(&self) -> u32 { 2 } }
enum E { A { x: u32 }, B }
""", [("Line", "class"), ("Line", "class"), ("blank", "function"), ("words", "function"), ("Shape", "class"), ("area", "function"), ("f", "function"), ("Shape", "class"), ("twice", "function"), ("E", "class")]),
    "java": ("""package shelf;
public class Shelf<T extends Comparable<T>> {
    private int[] x = {1, 2};
    static { init(); }
    public Shelf() { this.books = new TreeSet<>(); }
    @Test(expected = X.class) @Override
    public Map<String, List<T>> sorted(int n) throws IOException {
        for (int i = 0; i < n; i++) { run(new Runnable() { public void run() { go(); } }); }
        String s = \"\"\"
            } " {
            \"\"\";
        return books;
    }
    enum Kind { A, B }
    record Place(int x, int y) { int sum() { return x + y; } }
}
@interface Mark { }
""", [("Shelf", "class"), ("Shelf", "function"), ("sorted", "function"), ("run", "function"), ("Kind", "class"), ("Place", "class"), ("sum", "function"), ("Mark", "class")]),
    "cpp": ("""#include <vector>
#define OPEN {
#define LONG(x) do { \\
  x; } while (0)
namespace a::b {
template <typename T>
class V : public Base<T>, private Other {
public:
  V(int n) : size(n), data{n} { }
  ~V() { }
  T& operator[](int i) { return data[i]; }
  bool operator()(int a) const noexcept { return a < 1'000; }
  bool operator==(const V& o) const { return true; }
};
template <class K, class W> std::map<K, W> build(const K& k) { return {}; }
struct point make_point(int x) { struct point p = { x }; return p; }
enum class Color { Red };
const char* raw = R"x( } )" { )x";
void a::b::V::run() { if (x) { y(); } auto l = [&](int z) { return z; }; }
extern "C" { int plain(void) { return '{'; } }
int values[] = { 1, 2 };
}
""", [("V", "class"), ("V", "function"), ("~V", "function"), ("operator[]", "function"), ("operator()", "function"), ("operator==", "function"), ("build", "function"), ("make_point", "function"), ("Color", "class"), ("run", "function"), ("plain", "function")]),
    "c": ("static int *find(const char *s, int (*f)(int)) {\n  while (*s) { if (*s == '}') return 0; s++; }\n  return 1;\n}\nstruct point { int x; };\ntypedef struct { int y; } other;\n", [("find", "function"), ("point", "class")]),
    "c_sharp": ('using System;\nnamespace A.B {\n  public class Order : IOrder {\n    public int Total { get; set; }\n    [Fact] public async Task<int> Sum<T>(List<T> x) where T : class { var s = @"c:\\"; return $"{x}".Length; }\n  }\n  interface IOrder { }\n}\n', [("Order", "class"), ("Sum", "function"), ("IOrder", "class")]),
    "php": ("<?php\n# it's {\nclass Page extends Sheet {\n  public function title(string $x = '}') { return \"{$this->head}\"; }\n}\nfunction &helper($a) { return <<<EOT\n } {\nEOT;\n}\n", [("Page", "class"), ("title", "function"), ("helper", "function")]),
}


@pytest.mark.parametrize("language", list(PROGRAMS))
def test_definitions(language):
    text, want = PROGRAMS[language]
    nodes = syntax.scan(text, language).nodes
    assert [(n.name, n.kind) for n in nodes] == want
    for k, n in enumerate(nodes):
        assert text[n.head - 1] == "{" and text[n.end - 1] == "}" and n.start < n.head < n.end
        around = [j for j, o in enumerate(nodes) if o.start <= n.start and n.end <= o.end and j != k]
        assert n.parent == (max(around) if around else -1) and n.depth == len(around)
    assert [(d[3], d[4]) for d in chunking.definitions(text, language)] == want


def test_starts_have_attributes_and_modifiers():
    text = PROGRAMS["rust"][0]
    first = syntax.scan(text, "rust").nodes[0]
    assert text[first.start :].startswith("#[derive(Debug)]\nstruct Line")
    text = PROGRAMS["java"][0]
    assert text[next(n for n in syntax.scan(text, "java").nodes if n.name == "sorted").start :].startswith("@Test(expected")
    text = PROGRAMS["cpp"][0]
    assert text[syntax.scan(text, "cpp").nodes[0].start :].startswith("template <typename T>")


@pytest.mark.parametrize("language", sorted(syntax.LANGUAGES))
def test_time_is_linear(language):
    for text in ("word " * 200_000 + "{ }", "f(" * 50_000 + "{" * 50_000, "a < b > c :: " * 30_000 + "{}", "'" * 200_000, "x\n" * 100_000 + "{", "{}" * 50_000, "` ${ " * 30_000, "/* " * 50_000, "class A " * 30_000 + "{", "impl < " * 30_000 + "{"):
        began = time.perf_counter()
        syntax.scan(text, language)
        assert time.perf_counter() - began < 4, text[:20]


@pytest.mark.parametrize("language", sorted(syntax.LANGUAGES))
def test_any_text_tiles(language):
    rng = random.Random(3)
    bits = ["{", "}", "(", ")", "[", "]", ";", ",", "'", '"', "`", "${", "/", "//", "/*", "*/", "\n", " ", "#", "class", "fn", "function", "func", "operator", "impl", "<", ">", "template", "=", "=>", ":", "::", "@", "type", "struct", "x", "é", "\\", "r#", 'R"(', "1'0", "record", "<<<EOT\n"]
    suffix = next(s for s, name in chunking.LANGUAGES.items() if name == language)
    for _ in range(300):
        text = "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(80)))
        found = syntax.scan(text, language)
        assert all(0 <= n.start < n.head <= n.end <= len(text) and n.parent < k for k, n in enumerate(found.nodes))
        rows = chunking.chunk_file(text, f"a{suffix}", 30)
        assert "".join(text[r["start_char"] : r["end_char"]] for r in rows) == text and all(r["end_char"] - r["start_char"] <= 30 for r in rows)
