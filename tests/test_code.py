import pytest

from ledgerloom.operators.codegraph import EDGES, assemble, assembled, audit, graph_digest, module_candidates, resolve_module
from ledgerloom.operators.extract import extract, extract_files


def graph_of(files, names=None):
    return assemble("p", [extract(files[n].encode(), n) for n in (names or files)])


def edges(g, kind):
    by = {s.id: s for s in g.symbols}
    return sorted((by[e.source].qualified, by[e.target].path, by[e.target].qualified) for e in g.edges if e.kind == kind)


#: A kitchen that takes its tools from a cabinet, which has them from a shelf, which has them from where they are made.
KITCHEN = {
    "tools/measure.ts": """export const weigh = (grams: number) => grams * 2;
export function trim(grams: number) { return weigh(grams); }
function polish(grams: number) { return grams; }
export interface Tool { use(): void }
export abstract class Device implements Tool { use() {} rest() { this.use(); } }
""",
    "tools/shelf.ts": "import { weigh, trim as shorten, polish } from './measure';\nexport { weigh as scale, shorten, polish };\n",
    "tools/cabinet/index.ts": "import { scale as balance, shorten as cutter } from '../shelf';\nexport { balance };\nexport { cutter as knife };\n",
    "kitchen.ts": """import { balance, knife } from './tools/cabinet';
import { polish } from './tools/shelf';
import * as drawer from './tools/cabinet';
import { Device as Machine, Tool } from './tools/measure';
import kettle from 'kettle-lib';
export function bake() { return balance(3); }
export function chop() { return knife(2); }
export function reach() { return drawer.balance(1) + drawer.spoon(1); }
export function shine() { return polish(1); }
export function each(items: number[]) { return items.map((knife) => knife(1)); }
export function boil() { return kettle(); }
export function twice() { function once() { return bake(); } return once() + once(); }
export class Oven extends Machine implements Tool {
  use() { return this.open(); }
  open() { return this.light.on() + chop(); }
  light = { on() { return 1; } };
  static make() { return new Oven().open(); }
}
""",
    "unrelated/knife.ts": "export function knife() { return 0; }\nexport function balance() { return knife(); }\n",
}


def test_names_are_followed_through_two_re_exports():
    g = graph_of(KITCHEN)
    calls = edges(g, "CALLS")
    assert ("bake", "tools/measure.ts", "weigh") in calls and ("chop", "tools/measure.ts", "trim") in calls  # by cabinet, shelf and measure
    assert ("reach", "tools/measure.ts", "weigh") in calls and ("trim", "tools/measure.ts", "weigh") in calls
    assert ("twice", "kitchen.ts", "twice.once") in calls and ("twice.once", "kitchen.ts", "bake") in calls
    assert ("Oven.use", "kitchen.ts", "Oven.open") in calls and ("Oven.open", "kitchen.ts", "chop") in calls and ("Device.rest", "tools/measure.ts", "Device.use") in calls
    assert ("balance", "unrelated/knife.ts", "knife") in calls
    sources = [s for s, *_ in calls]
    assert not {"shine", "each", "boil", "Oven.make"} & set(sources)  # not exported, shadowed in a callback, of a package, of a made object
    assert sources.count("reach") == 1 and sources.count("Oven.open") == 1  # drawer has no spoon, and this.light.on() is a chain
    assert edges(g, "EXTENDS") == [("Oven", "tools/measure.ts", "Device")]
    assert edges(g, "IMPLEMENTS") == [("Device", "tools/measure.ts", "Tool"), ("Oven", "tools/measure.ts", "Tool")]
    assert any(d.code == "UNRESOLVED_IMPORT" and "kettle-lib" in d.message for d in g.diagnostics)
    assert len(g.imports_of("kitchen.ts")) == 5 and {"bake", "Oven"} <= {s.name for s in g.definitions("kitchen.ts")} and len(g.callers(g.named("weigh")[0].id)) == 3
    kinds = audit(g)["counts"]
    assert kinds["external_package"] >= 2 and kinds["namespace_member_ambiguity"] >= 1 and audit(g)["total"] == sum(kinds.values())
    assert graph_digest(graph_of(KITCHEN, list(KITCHEN)[::-1])) == graph_digest(g)


#: A Python package with relative imports on two levels.
HARBOUR = {
    "harbour/__init__.py": "",
    "harbour/cranes/__init__.py": "",
    "harbour/cranes/tall.py": """LIMIT = 40
class Crane:
    def lift(self, tons):
        return self.hook(tons)
    def hook(self, tons):
        return check(tons)
    @classmethod
    def spare(cls):
        return cls.hook(1)
    def odd(crane):
        return crane.hook(2)
def check(tons):
    return tons < LIMIT
""",
    "harbour/dock.py": """from .cranes.tall import Crane as Hoist, check
from harbour.cranes import tall
import numpy
class Dock(Hoist):
    def load(self, tons):
        def step(n):
            return check(n)
        return step(tons)
    def wait(self):
        return [check(n) for n in range(3)]
    def count(self):
        return numpy.sum(1) + tall.check(1)
def moor(check):
    return check(1)
def leave():
    moor = 3
    return moor(2)
def sign(): return 1
def sign(): return 2
def both(): return sign()
""",
}


def test_python_packages():
    g = graph_of(HARBOUR)
    calls = edges(g, "CALLS")
    assert ("Crane.lift", "harbour/cranes/tall.py", "Crane.hook") in calls and ("Crane.hook", "harbour/cranes/tall.py", "check") in calls
    assert ("Dock.load", "harbour/dock.py", "Dock.load.step") in calls and ("Dock.load.step", "harbour/cranes/tall.py", "check") in calls
    assert edges(g, "EXTENDS") == [("Dock", "harbour/cranes/tall.py", "Crane")]
    sources = {s for s, *_ in calls}
    # a receiver of another name, a comprehension, a parameter, a local name, and two functions of one name
    assert not {"Crane.odd", "Dock.wait", "moor", "leave", "both"} & sources
    assert not any(s == "Dock.count" and t.endswith("sum") for s, _, t in calls)
    assert {s.kind for s in g.named("LIMIT")} == {"constant"} and len({s.id for s in g.named("sign")}) == 2
    assert audit(g)["counts"]["missing_local_module"] + audit(g)["counts"]["external_package"] >= 1


@pytest.mark.parametrize("files", [
    {"lamp.ts": "function glow() {} function night() { try { dim(); } catch (glow) { glow(); } }\nfunction day() { { function shade() {} } shade(); }"},
    {"lamp.py": "def glow():\n    return 1\ndef night():\n    for glow in ():\n        glow()\nday = lambda glow: glow()\ndef noon():\n    import glow\n    return glow()\n"},
    {"door.ts": "class Door { lock() {} turn() { lock(); const key = () => { function deep() { this.lock(); } }; } }\nfunction knock(door: Door) { door.lock(); }"},
    {"a.ts": "import { spin as turn } from './b';\nexport { turn as spin };", "b.ts": "import { spin as turn } from './a';\nexport { turn as spin };", "c.ts": "import { spin } from './a';\nexport function go() { spin(); }"},
    {"paint.ts": "export function red() {}\nexport function red() {}", "wall.ts": "import { red } from './paint';\nexport function coat() { red(); }"},
    {"seed.ts": "export function grow() {}", "bed.ts": "import { grow as start } from './seed';\nstart = null;\nexport { start };", "farm.ts": "import { start } from './bed';\nexport function spring() { start(); }"},
    {"seed.ts": "export function grow() {}", "bed.ts": "import type { grow as kind } from './seed';\nimport { grow as live } from './seed';\nexport { kind };\nexport type { live as shape };", "farm.ts": "import { kind, shape } from './bed';\nexport function spring() { kind(); shape(); }"},
    {"seed.ts": "export function grow() {}", "bed.ts": "import * as all from './seed';\nexport { all };", "farm.ts": "import { all } from './bed';\nexport function spring() { all.grow(); }"},
    {"seed.ts": "export function grow() {}", "bed.ts": "import { grow as one } from './seed';\nimport { grow as one } from './seed';\nexport { one };", "farm.ts": "import { one } from './bed';\nexport function spring() { one(); }"},
])
def test_nothing_is_made_up(files):
    assert edges(graph_of(files), "CALLS") == []


def test_overloads_have_ids_of_their_own():
    g = graph_of({"shape.ts": "export function area(side: number): number;\nexport function area(width: number, height: number): number;\nexport function area(a: number, b = a) { return a * b; }\nfunction use() { return area(2); }"})
    assert len({s.id for s in g.named("area")}) == 3 and edges(g, "CALLS") == []


def test_modules():
    files = {"lib/index.ts", "main.ts", "pkg/util.py", "pkg/main.py", "pkg/__init__.py", "both.ts", "both.js"}
    assert resolve_module("main.ts", "typescript", "./lib", files) == "lib/index.ts"
    assert resolve_module("main.ts", "typescript", "./lib", files | {"lib.ts"}) is None
    assert resolve_module("main.ts", "typescript", "./both", files) is None and resolve_module("main.ts", "typescript", "./both.js", files) == "both.js"
    assert resolve_module("pkg/main.py", "python", ".util", files) == "pkg/util.py" and resolve_module("pkg/main.py", "python", "...util", files) is None
    assert module_candidates("a/b.ts", "typescript", "../../x") == [] and module_candidates("a.ts", "typescript", "pkg") == []


def test_spans_are_bytes():
    text = "﻿\r\n// 😀 ünï\r\nexport function größe() { return '😀'; }\r\n"
    ir = extract(text.encode(), "a.ts")
    s = next(s for s in ir.symbols if s.kind == "function")
    assert text.encode()[s.span.start : s.span.end].decode().startswith("function größe()") and s.span.start_line == 3
    py = "x = 'é😀'\ndef f():\n    return 'ü'\n"
    s = next(s for s in extract(py.encode(), "a.py").symbols if s.kind == "function")
    assert py.encode()[s.span.start : s.span.end].decode() == "def f():\n    return 'ü'"
    assert extract(b"def (", "b.py").diagnostics[0].code == "SYNTAX_ERROR" and extract(b"\xff", "b.ts").diagnostics[0].code == "SYNTAX_ERROR"


def test_in_spark(spark):
    rows = [(p, n, bytearray(t.encode())) for p in ("p", "q") for n, t in KITCHEN.items()] + [("p", "readme.md", bytearray(b"x")), ("p", "null.py", None)]
    irs = extract_files(spark.createDataFrame(rows, "project_id string, path string, content binary"))
    calls = assembled(irs, "edges").where("kind = 'CALLS'")
    n = len(edges(graph_of(KITCHEN), "CALLS"))
    assert {(r.project_id, r["count"]) for r in calls.groupBy("project_id").count().collect()} == {("p", n), ("q", n)}
    assert assembled(irs, "symbols").where("name = 'bake'").count() == 2 and EDGES.startswith("project_id")
