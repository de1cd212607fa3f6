"""Definitions in several languages, what a symbol anchor means, and drift."""

from waymark.operators import health, matching, reanchor
from waymark.sources import logs, scripts


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


ANCHOR = "id long, source string, severity string, confidence double, status string, kind string, value string, anchor_ord int"
SCRIPT = """import {x} from "y";
// function no() {}
export const Lantern = (oil) => {
    while (oil > 0) { oil -= burn(oil) }
};
const wick = "w".repeat(3), shades: Map<string, number> = new Map();
let hours = 2
let glow = wick < hours ? 'const soot = 1' : /const [f]{2} = "/.test(hours)
for (const g of []) { if (g) { h() } }
export default async function run<T>(p: {q: T}): Promise<void> {
    function inner() { return 1; }
}
const { r, s } = run;
class Box extends Base {
    static async open(p) { return `}${p}`; }
    #hidden(): {n: number} { return {n: 1}; }
    label = "x";
}
abstract class Shape { area() { return 0; } }
const obj = { go() { return 1 }, f: function named() {} };
function declared(x);
var u = 1"""


def symbol(i, value):
    return (i, f"r{i}.md", "high", 1.0, "active", "symbol", value, 0)


def names(text):
    return [d[0] for d in scripts.definitions(text)]


def test_script_definitions():
    assert names(SCRIPT) == ["Lantern", "wick", "shades", "hours", "glow", "run", "run.inner", "Box", "Box.open", "Box.#hidden", "area", "obj", "obj.go", "u"]
    lines = {d[0]: d[1:3] for d in scripts.definitions(SCRIPT)}
    assert (lines["Lantern"], lines["run"], lines["hours"], lines["u"]) == ((3, 5), (10, 12), (7, 7), (22, 22))


def test_odd_scripts():
    for text in ("", "\n", "const", "function", "class {", "const a = (", "}}}", "let x: Array<", "const {a", "f(function g() {", "class A { b(", "'", "`", "/", "a /*", "var \u00e9 = 1;" * 3):
        list(scripts.definitions(text))
    assert names("const a = (") == ["a"] and names("function f() { const g = 1") == ["f", "f.g"]


def test_shingles_of_scripts():
    of = lambda text: dict((d[0], d[3]) for d in scripts.definitions(text))
    assert of("function f(a) {\n  // c\n  return a }") == of("function f(a){return a}")
    assert of("function f(a) { return a.b(1) }")["f"] != of("function f(a) { return a.z(2) }")["f"]


def test_shingles_tell_bodies_of_one_shape_apart(spark):
    d = logs.definitions(frame(spark, [("x.py", "def bar(a):\n    return a.b(1)\n"), ("y.py", "def bar(a):\n    return a.z(2)\n"), ("z.py", "def bar(a):\n    # c\n    return a.b( 1)\n")], "path string, content string"))
    got = {r.path: r.shingles for r in d.collect()}
    assert got["x.py"] != got["y.py"] and got["x.py"] == got["z.py"]


def test_what_an_anchor_means(spark):
    code = "class Mill:\n    class Wheel:\n        def turn(self, water):\n            return water * 2\nclass Lathe:\n    def turn(self):\n        return None\n"
    d = logs.definitions(frame(spark, [("a.py", code), ("b.tsx", "export const Turn = () => 1;"), ("c.txt", "def turn(): pass")], "path string, content string"))
    asked = {1: "turn", 2: "Mill.turn", 3: "a.py::Lathe.turn", 4: "b.tsx::turn", 5: "Turn", 6: "Mill.Lathe", 7: "::Wheel.turn", 8: "tu.", 9: "", 10: "[", 11: "Wheel.Mill.turn"}
    a = frame(spark, [symbol(*x) for x in asked.items()], ANCHOR)
    files = frame(spark, [(0, "a.py", code), (1, "b.tsx", "")], "ord long, path string, content string")
    got = {(r.id, r.path) for r in matching.signals(a, files, symbols=d.select("path", "name")).collect()}
    assert got == {(1, "a.py"), (2, "a.py"), (3, "a.py"), (5, "b.tsx"), (7, "a.py")}
    assert {r.id for r in health.lost_symbols(a, d).collect()} == {4, 6, 8, 9, 10, 11}


def test_drift_refuses_names_of_several(spark):
    src = lambda text: logs.definitions(frame(spark, [("a.py", text)], "path string, content string"))
    two = "class Mill:\n    def turn(self, water):\n        return water * {}\nclass Lathe:\n    def turn(self):\n        return None\n"
    asked = frame(spark, [(1, "symbol", "turn", "a.py"), (2, "symbol", "Mill.turn", "a.py"), (3, "symbol", "Lathe.turn", "a.py"), (4, "symbol", "Mill.turn", "b.py")], "id long, kind string, value string, path string")
    was, now = (reanchor.symbol_prints(asked, src(two.replace("{}", x))) for x in ("1", "7"))
    assert {r.id for r in was.collect()} == {2, 3}
    assert [(r.id, r.name) for r in reanchor.symbol_drift(was, now).collect()] == [(2, "Mill.turn")]
