from __future__ import annotations

import posixpath
import random
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from affinis import Baseline, Engine, Snapshot, resolved
from affinis.operators import facts, graph, imports
from affinis.plans.engine import read_windows
from affinis.sources import files

TREE = {
    "server/main.go": 'package main\n\nfunc main() {\n\tr := NewRouter()\n\tr.GET("/api/users/:id", GetUser)\n}\n\nfunc NewRouter() int { return 1 }\n',
    "web/api.ts": 'import { User } from "./types";\n\nexport async function loadUser(id: string) {\n  return fetch(`/api/users/${id}`);\n}\n\nexport class Admin extends User implements Named {}\n',
    "web/types.ts": "export class User {}\nexport interface Named {}\n",
    "web/api.test.ts": 'import { loadUser } from "./api.js";\n\nfunction checkUser() {\n  loadUser("1");\n}\n',
    "app/api/orders/route.ts": "export async function GET() {}\nexport const POST = 1;\n",
    "py/jobs.py": "from py.tools import run\n\ndef sync_users():\n    run()\n",
    "py/tools.py": "def run():\n    return 1\n",
    "vendor/x.go": "package x\n",
    "bun.lockb": "x",
    "sub/inner/a.py": "def a():\n    pass\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    here = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        path = here / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(here)


@pytest.fixture(scope="module")
def engine(spark, root):
    return Engine.from_tree(spark, root)


def test_edges_of_a_tree(engine):
    got = {(r.src, r.dst, r.kind, round(r.w, 3)) for r in engine.edges.collect()}
    assert {
        ("file:web/api.ts", "loadUser@web/api.ts", "contains", 1.0), ("file:web/api.ts", "file:web/types.ts", "imports", 0.3), ("file:web/api.test.ts", "file:web/api.ts", "imports", 0.3),
        ("file:web/api.test.ts", "file:web/api.ts", "tests", 0.6), ("file:py/jobs.py", "file:py/tools.py", "imports", 0.3), ("sync_users@py/jobs.py", "run@py/tools.py", "invokes", 0.7),
        ("checkUser@web/api.test.ts", "loadUser@web/api.ts", "invokes", 0.7), ("main@server/main.go", "NewRouter@server/main.go", "invokes", 0.7), ("Admin@web/api.ts", "User@web/types.ts", "inherits", 0.9),
        ("Admin@web/api.ts", "Named@web/types.ts", "inherits", 0.9), ("anchor:GET /api/orders", "GET@app/api/orders/route.ts", "anchors", 1.0), ("anchor:POST /api/orders", "GET@app/api/orders/route.ts", "anchors", 1.0),
    } <= got
    assert any(k == "join" and {a, b} == {"main@server/main.go", "loadUser@web/api.ts"} for a, b, k, _ in got)
    assert not any("vendor" in x or "bun" in x for a, b, _, _ in got for x in (a, b))


def test_questions_to_a_tree(engine):
    status = engine.status()
    assert status["files"] == 8 and status["anchors"] == 3 and status["coverage"] == {"ok": 8}
    assert "⚑ GET /api/users/{*}" in engine.sketch().text
    focus = engine.focus("loadUser")
    assert "loadUser (function) web/api.ts:3 [focus]" in focus.text and "[← caller]" in focus.text
    assert "loadUser" not in engine.dwell().text.split("\n", 1)[-1].split("[focus]")[0] or engine.t == 4.0
    hit = engine.impact(["web/types.ts"], symbols=["run"])
    reasons = {r.file: r.reasons for r in hit.rows.collect()}
    assert "import" in reasons["web/api.ts"] and reasons["py/jobs.py"] == ["call", "import"] and "web/types.ts" not in reasons
    assert reasons["web/api.test.ts"] == ["import", "test"] and {r.key for r in hit.details["warmed"].collect()} >= {"function|sync_users@py/jobs.py"}
    engine.reset()
    assert engine.seeds is None and engine.disclosed is None


def test_git(spark, tmp_path):
    root = str(tmp_path)
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    assert files.tracked(spark, root) is None and files.status(spark, root)[1]
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("b.py\n")
    run("init", "-q", "-b", "main")
    run("add", ".")
    run("commit", "-q", "-m", "one")
    (tmp_path / "b.py").write_text("y = 1\n")
    (tmp_path / "c.py").write_text("z = 1\n")
    (tmp_path / "sub").mkdir()
    subprocess.run(["git", "init", "-q", str(tmp_path / "sub")], check=True)
    (tmp_path / "sub" / "d.py").write_text("z = 1\n")
    names = {r.file for r in files.tracked(spark, root).collect()}
    assert {"a.py", "c.py"} <= names and "b.py" not in names
    closed = files.submodules(spark, root)
    assert [r.folder for r in closed.collect()] == ["sub"] and files.submodules(spark, root, enrolled=("sub",)).count() == 0
    assert {r.file for r in files.manifest(spark, root, closed=closed).collect()} == {"a.py", "b.py", "c.py"}
    assert {r.file for r in files.contents(spark, root, listed=files.tracked(spark, root), closed=closed).collect()} == {"a.py", "c.py"}
    rows, odd = files.status(spark, root)
    assert not odd and ("??", "c.py") in {(r.code, r.file) for r in rows.collect()} and "c.py" in {r.file for r in files.uncommitted(spark, root).collect()}
    run("checkout", "-q", "-b", "side")
    run("add", "c.py")
    run("commit", "-q", "-m", "two")
    assert [r.file for r in files.since(spark, root, "main").collect()] == ["c.py"]
    assert {r.item for r in files.commits(spark, root).collect()} == {"a.py", ".gitignore", "c.py"}


def test_imports_of_all_families(spark):
    tree = ["src/a.ts", "src/b/index.ts", "lib/deep/c.ts", "pkg/m.py", "pkg/__init__.py", "go/x/one.go", "go/x/two.go", "go/y/x/z.go", "src/r.rs", "w/s/mod.rs", "v/t.rs", "u/t.rs", "main.rs"]
    asked = [("src/x.ts", "./a.js", "src/a.ts"), ("src/x.ts", "./b", "src/b/index.ts"), ("src/x.ts", "deep/c", "lib/deep/c.ts"), ("src/x.ts", "missing", None), ("q.py", "pkg.m", "pkg/m.py"), ("q.py", "pkg", "pkg/__init__.py"),
             ("m.go", "host/go/x", "go/x/one.go"), ("m.go", "x", None), ("l.rs", "crate::r", "src/r.rs"), ("l.rs", "self::s", "w/s/mod.rs"), ("l.rs", "t", None), ("a.rb", "b", "src/b/index.ts")]
    rows = spark.createDataFrame([(str(k), f, s) for k, (f, s, _) in enumerate(asked)], "site string, file string, spec string")
    got = {r.site: r.target for r in imports.resolve(rows, spark.createDataFrame([(f,) for f in tree], "file string")).collect()}
    assert [got.get(str(k)) for k in range(len(asked))] == [t for _, _, t in asked]


def test_imports_by_name_are_those_of_every_path_tried_in_order(spark):
    ends = {"ts": [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"], "py": [".py"], "rs": [".rs"]}
    of = {e[1:]: family for family, each in ends.items() for e in each}
    rng = random.Random(3)
    some = lambda: rng.choice(["a", "b", "index", "a.d", "é", ".ts", "mod"])
    tree = {"/".join(rng.choices(["a", "b", "src", "index"], k=rng.randrange(3)) + [some() + rng.choice([".ts", ".tsx", ".mts", ".js", ".cjs", ".py", ".rs", ".rb", ".TS", ""])]) for _ in range(400)}
    asked = []
    for k in range(1500):
        file = rng.choice(["", "a/", "src/b/"]) + "x" + rng.choice([".ts", ".jsx", ".TSX", ".py", ".rs", ".rb", ""])
        family = of.get(file.rpartition(".")[2].lower()) if "." in file else None
        up, rest = rng.choice(["./", "../", "./../b/"]), "/".join([*rng.choices(["a", "b", "index", "src"], k=rng.randrange(2)), some() + rng.choice(["", "", "", ".js", ".mjs", ".ts", ".py"])])
        if family == "py" and k % 2:
            spec = rest.replace("/", ".")
            tries = [spec.replace(".", "/") + e for e in (".py", "/__init__.py")]
        else:
            spec = up + rest
            base = re.sub(r"\.([cm]?js|jsx)$", "", posixpath.normpath(posixpath.join(posixpath.dirname(file), spec)))
            tries = [base + x for e in ends.get(family, []) for x in (e, "/index" + e)] + [base]
        asked.append((str(k), file, spec, next((t for t in tries if t in tree), None)))
    rows = spark.createDataFrame([x[:3] for x in asked] + [("null", None, "./a"), ("none", "a/x.ts", None)], "site string, file string, spec string")
    got = {r.site: r.target for r in imports.resolve(rows, spark.createDataFrame([(f,) for f in [*tree, None]], "file string")).collect()}
    assert len({t for _, _, _, t in asked}) > 40 and got == {site: t for site, _, _, t in asked if t}


def test_first_paths(spark):
    edges = spark.createDataFrame([("a", "b", "contains", 1.0), ("b", "c", "invokes", 0.7), ("a", "c2", "imports", 0.3), ("c2", "d", "tests", 0.6), ("c", "d", "invokes", 0.7), ("d", "e", "invokes", 0.2), ("x", "y", "join", 0.5)], "src string, dst string, kind string, w double")
    got = {r.node: (r.hop, r.reasons) for r in graph.path_reasons(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a": (0, []), "b": (1, []), "c2": (1, ["import"]), "c": (2, ["call"]), "d": (2, ["import", "test"]), "e": (3, ["import", "test", "call"])}


def test_windows():
    rows = [("a", 10, "x"), ("a", 100, "hot neighbor"), ("a", 30, "matched focus"), ("b", 0, "z"), ("b", 2, "y")]
    assert read_windows(rows) == [{"path": "a", "offset": 5, "limit": 45, "reason": "matched focus"}, {"path": "a", "offset": 95, "limit": 25, "reason": "hot neighbor"}, {"path": "b", "offset": 1, "limit": 25, "reason": "y"}]
    assert len(read_windows([("f", 100 * k, "r") for k in range(1, 9)])) == 5


def test_baseline(spark):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    shot = lambda v, files_, anchors=(), **more: Snapshot(v, rows(list(files_.items()), "file string, sha string"), rows(list(files_.items()), "file string, fingerprint string"), rows(list(anchors), "anchor string, file string, implicit boolean"), **more)
    b = Baseline()
    assert b.step(None).state == "indexing"
    assert b.step(shot("1", {"web/a.ts": "x"})).state == "established" and b.step(shot("1", {"web/a.ts": "x"})).state == "unchanged"
    quiet = b.step(shot("2", {"web/a.ts": "y"}), scopes=["server"])
    assert quiet.state == "outside" and quiet.details["ignored"] == 1
    warm = b.step(shot("3", {"web/a.ts": "z"}), 0.0, {"n": 0.2}, ["web"])
    assert (warm.state, warm.red, warm.delivery) == ("drift", True, "steer") and [r.file for r in warm.semantic.collect()] == ["web/a.ts"]
    assert not b.step(shot("4", {"web/a.ts": "w"}), 1.0, {"n": 0.2}).red
    new = b.step(shot("5", {"web/a.ts": "v"}, [("GET /x", "web/a.ts", False)]), 2.0, provenance="other")
    assert new.red and new.delivery == "next-prompt" and [r.change for r in new.deltas.collect()] == ["added"]
    suspect = b.step(shot("6", {"web/a.ts": "v", "web/b.ts": "1"}, [("GET /x", "web/a.ts", False), ("GET /y", "web/a.ts", False)]), 3.0)
    assert not suspect.red and b.step(shot("7", {}, checkout=True)).state == "established"
    assert b.step(shot("8", {"t.py": "1"})).state == "drift" and b.step(shot("9", {})).red


def test_options(monkeypatch):
    from affinis.config import env_int

    assert resolved({"default_budget": "x", "sync": {"mode": "hidden", "scope": "odd", "push_focus": False, "other": 1}}).sync.mode == "hidden"
    assert resolved({"sync": {"scope": "odd"}}).sync.scope == "session" and resolved().default_budget == 512 and not resolved({"sync": {"push_focus": False}}).sync.push_focus
    monkeypatch.setenv("AFFINIS_TEST_N", "7")
    assert env_int("AFFINIS_TEST_N", 1, 2, 5) == 5 and env_int("AFFINIS_TEST_NONE", 1, 2, 5) == 1


def test_symbols_of_many_languages(spark):
    text = {"a.c": "static int add(int a) {", "a.cpp": "class Box {", "a.php": "  public function run() {", "a.swift": "func go() {", "a.scala": "object Main {", "a.lua": "local function f(x)", "a.hs": "area :: Int -> Int", "a.sh": "build() {"}
    rows = spark.createDataFrame([(f, lang, t) for (f, t), lang in zip(text.items(), ["C", "C++", "Php", "Swift", "Scala", "Lua", "Haskell", "Bash"], strict=True)], "file string, lang string, text string")
    got = {r.file: r["name"] for r in files.pattern_facts(rows).where("fact = 'symbol'").collect()}
    go = spark.createDataFrame([("a.go", "Go", "func (s *Store) Load(id int) {\nfunc (Box) Size() int {\nfunc New() {\nfunc (m Map[K]) Get(k K) V {" + "x" * 200 + "\nfunc " + "y" * 200)], "file string, lang string, text string")
    rows_go = files.pattern_facts(go).orderBy("line").collect()
    assert [(r["name"], r.kind) for r in rows_go[:4]] == [("Store.Load", "method"), ("Box.Size", "method"), ("New", "function"), ("Map.Get", "method")]
    assert rows_go[3].sig == "func (m Map[K]) Get(k K) V { ... }" and len(rows_go[4].sig) == 140 and rows_go[4].sig.endswith("...")
    assert got == {"a.c": "add", "a.cpp": "Box", "a.php": "run", "a.swift": "go", "a.scala": "Main", "a.lua": "f", "a.hs": "area", "a.sh": "build"}
    assert facts.names(spark.createDataFrame([("A.b", "f")], "name string, file string")).orderBy("key").select("key").collect() == [("a.b",), ("b",)]
    assert spark.range(1).select(F.lit(1)).count() == 1
