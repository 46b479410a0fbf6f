"""Extraction, resolution, kinds of use and metrics on files written out here."""

from pyspark.sql import functions as F

from graphloom.operators import code
from graphloom.operators.scripts import scan, script_facts, script_metrics

PYTHON = '''"""Doc."""
import os, a.b as c
from ..x import y as z, w
from pkg import *


class A(Base):
    """Kept."""

    def m(self, q=1) -> int:
        def inner():
            import late
        return q


async def f(): pass
'''
SCRIPT = '''import a, { b as c, type D } from './x';
import * as ns from "y";
import 'side';
// import no from 'no'
export { q as r } from '../z';
export * from './all';
const m = require('mod');
export const arrow = async (x) => {
  return `import { t } from './t'`;
};
export default class Foo extends Bar {
  constructor(a) { if (a) { this.a = a } }
  async run(b) {
    for (;;) { }
  }
}
function old(a, b) { return 1 }
'''


def test_python_facts():
    symbols, imports = code.python_facts(PYTHON)
    assert [(s["name"], s["kind"], s["parent"], s["line_start"], s["line_end"]) for s in symbols] == [("A", "class", None, 7, 13), ("m", "method", "A", 10, 13), ("f", "function", None, 16, 16)]
    assert symbols[0]["docstring"] == "Kept." and symbols[1]["signature"] == "def m(self, q=1) -> int"
    assert [(i["specifier"], i["names"], i["locals"]) for i in imports] == [("os", [], ["os"]), ("a.b", [], ["c"]), ("..x", ["y", "w"], ["z", "w"]), ("pkg", ["*"], [None]), ("late", [], ["late"])]
    assert code.python_facts("def broken(:") == ([], [])


def test_script_facts():
    symbols, imports = script_facts(SCRIPT)
    assert [(s["name"], s["kind"], s["parent"], s["line_start"], s["line_end"]) for s in symbols] == [("arrow", "function", None, 8, 10), ("Foo", "class", None, 11, 16), ("constructor", "method", "Foo", 12, 12), ("run", "method", "Foo", 13, 15), ("old", "function", None, 17, 17)]
    assert [(i["specifier"], i["names"], i["locals"], i["reexport"]) for i in imports] == [("./x", ["default", "b", "D"], ["a", "c", "D"], False), ("y", ["*"], ["ns"], False), ("side", [], [], False), ("../z", ["q"], [None], True), ("./all", ["*"], [None], True), ("mod", [], [], False)]


def resolved(spark, rows, paths, aliases=None):
    i = spark.createDataFrame(rows, "id long, path string, specifier string, name string")
    p = spark.createDataFrame([(x,) for x in paths], "path string")
    if aliases is not None:
        aliases = spark.createDataFrame([("", a, t) for a, t in aliases.items()] if isinstance(aliases, dict) else aliases, "dir string, alias string, targets array<string>")
    return {r.id: r.target for r in code.resolve_in_two_stages(i, p, aliases).collect()}


def test_imports_are_resolved_by_candidates_in_order(spark):
    paths = ["pkg/__init__.py", "pkg/mod.py", "pkg/sub/x.py", "src/lib.py", "web/a.ts", "web/b/index.tsx", "web/b.js", "web/deep/c.ts"]
    rows = [
        (1, "main.py", "pkg", "mod"), (2, "main.py", "pkg", "name"), (3, "pkg/sub/x.py", "..", "mod"), (4, "pkg/sub/x.py", "..mod", "f"), (5, "main.py", "lib", None), (6, "main.py", "numpy", None),
        (7, "web/deep/c.ts", "../b", "x"), (8, "web/a.ts", "./deep/c.ts", "x"), (9, "web/a.ts", "@/deep/c", "x"), (10, "web/a.ts", "react", "x"), (11, "pkg/mod.py", ".", "*"),
    ]
    assert resolved(spark, rows, paths, {"@/*": ["web/*"], "@/deep/*": ["web/deep/*"]}) == {1: "pkg/mod.py", 2: "pkg/__init__.py", 3: "pkg/mod.py", 4: "pkg/mod.py", 5: "src/lib.py", 6: None, 7: "web/b.js", 8: "web/deep/c.ts", 9: "web/deep/c.ts", 10: None, 11: "pkg/__init__.py"}


def test_roots_are_promoted_by_share_and_number(spark):
    paths = ["backend/app/a.py", "backend/app/b.py", "backend/app/c.py", "other/app/c.py", "backend/main.py"]
    rows = [(k, "backend/main.py", f"app.{m}", None) for k, m in enumerate("abc")] + [(9, "backend/main.py", "zlib", None)]
    assert resolved(spark, rows, paths) == {0: "backend/app/a.py", 1: "backend/app/b.py", 2: "backend/app/c.py", 9: None}
    assert resolved(spark, rows[:2], paths) == {0: None, 1: None}  # two imports don't promote a root


def test_kinds_by_the_strongest_use(spark):
    source = "from m import A, B, C, D, E\nfrom n import *\nclass X(A): pass\nB()\n" + "C\n" * 5 + "D\n"
    files = spark.createDataFrame([("p/a.py", source), ("tests/a.py", source), ("w/a.ts", "export { q } from './z';\nimport type { T } from './t';\n")], "path string, content string")
    facts = code.extract(files)
    kinds = code.classified(files, facts).join(code.imports_of(facts), "id")
    got = {(r.path, r.name): r.kind for r in kinds.collect()}
    assert [got["p/a.py", n] for n in ("A", "B", "C", "D", "E", "*")] == ["inherits", "calls", "heavy_use", "light_use", "type_only", "unresolvable_binding"]
    assert got["tests/a.py", "A"] == "test_edge" and got["w/a.ts", "q"] == "reexport" and got["w/a.ts", "T"] == "type_only"


def test_metrics():
    m = code.file_metrics('def f(a):\n    """Text\n    # no comment\n    """\n    # comment\n    if a and b or c:\n        pass\n    elif a:\n        for x in y:\n            pass\n    try:\n        pass\n    except Exception:\n        pass\n    except ValueError:\n        pass\n')
    assert (m["max_cyclomatic"], m["max_nesting"], m["max_operands"], m["nloc"], m["broad_handlers"]) == (8, 2, 3, 15, 1)
    assert code.file_metrics("def broken(:") is None


def test_unknown_languages_have_no_metrics(spark):
    d = spark.createDataFrame([("a.go", "x"), ("b.py", None), ("c.py", "x = 1\n")], "path string, content string")
    assert {r.path: r.nloc for r in code.code_metrics(d).collect()} == {"a.go": None, "b.py": None, "c.py": 1}


def test_paths_are_normalised(spark):
    d = spark.createDataFrame([("./a//b/../c/./d",), ("../x",), ("a/../../b",), ("",)], "p string")
    assert [r[0] for r in d.select(code.normal_path(F.col("p"))).collect()] == ["a/c/d", "../x", "../b", ""]


def test_nothing_inside_strings_templates_or_patterns_is_code():
    text = """const s = "require('fake')", t = `import a from 'b' ${require('real')} ${`deep ${x ? `}` : "`"} require('no')`} {`;
const r = /[`/]require('no')\\//.test(s) / 2;
// require('commented')
/* import y from 'y' */
import z, * as w from 'z'
"""
    assert [i["specifier"] for i in script_facts(text)[1]] == ["real", "z"]
    assert [(t.kind, t.text) for t in scan("a / b / c")[0]] == [("name", "a"), ("mark", "/"), ("name", "b"), ("mark", "/"), ("name", "c")]
    assert [t.kind for t in scan("x = /a[/]b/g; `a${`b${1}`}c`; 'open")[0]] == ["name", "mark", "pattern", "mark", "template", "template", "number", "template", "template", "mark", "string"]


def test_script_symbols_of_every_form():
    text = """export default function () { return 1 }
export default class extends Base {
  static async *go<T>(a: string, b = {}): Promise<T> { if (a) { return b } }
  #hidden() {}
  get value() { return 1 }
  field = () => { call() }
}
async function later(a, { b }) {}
export const typed: Fn = async (x: number): Promise<void> => { await x },
  other = y => y + 1;
let notAFunction = call(() => 1);
if (x) { function inner() {} }
"""
    got = [(x["name"], x["kind"], x["parent"]) for x in script_facts(text)[0]]
    assert got == [("default", "function", None), ("default", "class", None), ("go", "method", "default"), ("#hidden", "method", "default"), ("value", "method", "default"), ("later", "function", None), ("typed", "function", None)]


def test_script_metrics_by_function():
    text = """function a(x) { // noted
  if (x && (y || z)) { for (const k of x) { while (k) { k-- } } } else if (x) { go() } else go();
  do { x?.y ?? z } while (x);
  switch (x) { case 1: break; default: }
  const inner = (q) => q ? 1 : 2;
  try { x } catch { }
}

class B { m(p?: string) { try { p } catch (e) { log(e) } finally { } return p } }
"""
    m = script_metrics(text)
    # a: if, &&, ||, for, while, else's if, do, ??, case, catch; inner: the choice; m: catch
    assert (m["function_count"], m["max_cyclomatic"], m["max_nesting"], m["max_operands"], m["broad_handlers"]) == (3, 11, 3, 3, 1)
    assert (m["nloc"], m["max_function_nloc"], m["worst_symbol"], m["worst_line"]) == (7, 6, "a", 1)
    assert script_metrics("")["function_count"] == 0 and script_metrics("}}}((( `${")["max_cyclomatic"] == 0
    assert script_metrics("function f() { " + "if (a) {} else " * 3000 + "{} }")["max_cyclomatic"] == 3001


def test_the_nearest_settings_file_decides_an_alias(spark):
    paths = ["a/src/x.ts", "a/b/lib/x.ts", "a/b/lib/y/index.tsx", "src/x.ts", "src/z.js", "a/src/z.js"]
    configs = [("", "@/*", ["src/*"]), ("a", "@/*", ["a/src/*"]), ("a/b", "@/*", ["a/b/none/*", "a/b/lib/*"]), ("a/b", "@/y*", ["a/src/x*"]), ("c", None, None)]
    rows = [(1, "main.ts", "@/x", None), (2, "a/m.ts", "@/x", None), (3, "a/b/deep/m.tsx", "@/x", None), (4, "a/b/m.js", "@/y", None), (5, "a/b/m.js", "@/z", None), (6, "c/m.js", "@/x", None), (7, "ab/m.js", "@/z", None), (8, "a/b/m.js", "@/yz", None)]
    # 4: the longer beginning; 5: no way back to the settings above; 6: the nearest settings have no alias
    assert resolved(spark, rows, paths, configs) == {1: "src/x.ts", 2: "a/src/x.ts", 3: "a/b/lib/x.ts", 4: "a/src/x.ts", 5: None, 6: None, 7: "src/z.js", 8: None}


def test_fingerprints(spark):
    from graphloom.functions.text import fingerprint

    def plain(s):
        h, units = 2166136261, s.encode("utf-16-be")
        for a, b in zip(units[::2], units[1::2], strict=True):
            h = ((h ^ (a << 8 | b)) * 16777619) & 0xFFFFFFFF
        out = ""
        while h:
            h, d = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        return out.rjust(6, "0")[-6:]

    texts = ["", "a", "src/app/main.py", "é/ü.ts", "𝒳/日本.py"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fingerprint(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in got} == {t: plain(t) for t in texts}
