from __future__ import annotations

import os
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from affinis import Engine
from affinis.plans.engine import Tree
from affinis.sources import files
from affinis.sources.store import FACTS, FactStore

TREE = {
    "web/api.ts": 'import { User } from "./types";\nexport async function loadUser(id: string) {\n  return fetch(`/api/users/${id}`);\n}\n',
    "web/types.ts": "export class User {}\n",
    "src/routes/[name]/+server.ts": "export async function GET() {}\n",
    "py/jobs.py": "from py.tools import run\n\ndef sync_users():\n    run()\n    client.get('/api/users/1')\n",
    "py/tools.py": "def run():\n    return 1\n",
    "py/broken.py": "def run(:\n",
    "web/app.min.js": "f('/x/y')\n",
    "notes.md": "see /docs/readme\n",
}


def write(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def content(engine):
    nodes = sorted(map(tuple, engine.nodes.select("node", "name", "kind", "file", "line", "sig", "lang").collect()), key=repr)
    edges = sorted((r.src, r.dst, r.kind, round(r.w, 9)) for r in engine.edges.collect())
    return nodes, edges, sorted(map(tuple, engine.index.collect()), key=repr)


def changed(df):
    return {r.file: r.change for r in df.collect()}


def run_files(store):
    number = store._numbers()[-1]
    return {r.file for r in store.spark.read.schema(FACTS + ", run int").parquet(f"{store.path}/run-{number:06d}").where(F.col("run") == number).collect()}


def test_refresh_equals_a_cold_build(spark, tmp_path):
    root, store = tmp_path / "tree", str(tmp_path / "store")
    for name, text in TREE.items():
        write(root, name, text)
    engine = Engine.from_tree(spark, str(root), store=store)
    tree = engine.tree
    assert {(r.file, r.status) for r in engine.left_out().collect()} == {("py/broken.py", "failed"), ("web/app.min.js", "generated")}
    assert tree.refresh().count() == 0 and run_files(tree.store) == set()

    write(root, ".affinis/rules.json", '{"rules": [{"id": "own", "langs": ["TypeScript"], "pattern": "$M($P)", "methods": "^(fetch|ask)$"}], "fileRoutes": [{"id": "docs", "re": "^(notes)\\\\.md$", "verbs": "suffix"}]}')
    done = changed(tree.refresh())
    assert set(done.values()) == {"anchored"} and "py/jobs.py" in done and "web/app.min.js" not in done

    write(root, "py/tools.py", "def run():\n    return helper()\n\ndef helper():\n    return 2\n")
    write(root, "web/new.ts", 'fetch("/api/new/thing");\n')
    (root / "web/types.ts").unlink()
    os.utime(root / "py/jobs.py", (time.time() + 60, time.time() + 60))
    write(root, "big.py", "x = 1\n" * 300_000)
    assert changed(engine.refresh()) == {"py/tools.py": "extracted", "web/new.ts": "added", "web/types.ts": "deleted", "py/jobs.py": "touched"}
    assert run_files(tree.store) == {"py/tools.py", "web/new.ts"}
    assert ("big.py", "oversized") in {tuple(r) for r in engine.left_out().collect()}
    assert {"anchor:ANY /notes", "anchor:GET /api/new/thing"} <= {r.node for r in engine.nodes.collect()}
    assert content(engine) == content(Engine.from_tree(spark, str(root)))
    assert Tree(spark, str(root), FactStore(spark, store)).refresh().count() == 0


def test_refresh_follows_git_and_closed_submodules(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", *a], check=True, capture_output=True)
    write(tmp_path, "a.py", "def a():\n    pass\n")
    write(tmp_path, "hidden.py", "def hidden():\n    pass\n")
    write(tmp_path, ".gitignore", "hidden.py\n")
    write(tmp_path, "sub/b.py", "def b():\n    pass\n")
    run("init", "-q", str(tmp_path))
    run("init", "-q", str(tmp_path / "sub"))
    store = FactStore(spark, str(tmp_path / ".store"))
    seen = lambda **more: changed(Tree(spark, str(tmp_path), store, **more).refresh())
    assert seen() == {"a.py": "added"} and seen(enrolled=("sub",)) == {"sub/b.py": "added"} and seen() == {"sub/b.py": "deleted"}


def extract(df):
    return df.select("file", F.lit("word").alias("fact"), F.lit(1).alias("line"), F.explode(F.split("text", " ")).alias("name"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("sig"))


def anchor(df):
    return extract(df).where("name like '/%'").withColumn("fact", F.lit("anchor"))


def step(spark, store, rows, rules="r"):
    seen = spark.createDataFrame([(f, len(t or ""), v) for f, v, t in rows], "file string, size long, version string")
    texts = spark.createDataFrame([(f, t) for f, _, t in rows], "file string, text string").where("text is not null")
    read = lambda asked: asked.select("file").join(texts, "file").select("file", F.sha1("text").alias("sha"), F.lit("x").alias("lang"), "text", F.col("text").startswith("gen").alias("generated"))
    return changed(store.refresh(seen, read, extract, anchor, rules, largest=20).changes)


def test_store_by_itself(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"), most_runs=2)
    told = lambda: sorted((r.file, r.fact, r["name"]) for r in store.facts().collect())
    assert told() == [] and store.manifest().count() == 0
    rows = [("a", "1", "p /q"), ("b", "1", "gen x"), ("c", "1", None), ("d", "1", "y" * 21), ("e", "1", "")]
    assert step(spark, store, rows) == {"a": "added", "b": "added", "e": "added"}
    assert told() == [("a", "anchor", "/q"), ("a", "word", "/q"), ("a", "word", "p"), ("e", "word", "")]
    assert {tuple(r) for r in store.report().collect()} == {("b", "generated"), ("c", "unreadable"), ("d", "oversized")}
    assert step(spark, store, rows) == {}
    rows = [("a", "2", "p /q"), ("b", "2", "now x"), ("c", "1", "z"), ("d", "1", "y" * 21)]
    assert step(spark, store, rows) == {"a": "touched", "b": "extracted", "c": "added", "e": "deleted"}
    before = told()
    assert before == [("a", "anchor", "/q"), ("a", "word", "/q"), ("a", "word", "p"), ("b", "word", "now"), ("b", "word", "x"), ("c", "word", "z")]
    assert step(spark, store, rows, "other") == {"a": "anchored", "b": "anchored", "c": "anchored"} and told() == before
    for k in range(2):
        rows[0] = ("a", f"v{k}", f"p /q{k}")
        assert step(spark, store, rows, "other") == {"a": "extracted"}
        assert ("a", "anchor", f"/q{k}") in told() and len(told()) == len(before)
        assert store.manifest().select("run").where("run is not null").distinct().count() <= 3
    assert FactStore(spark, store.path).facts().count() == len(before)
    assert step(spark, store, []) == {"a": "deleted", "b": "deleted", "c": "deleted", "d": "deleted"} and told() == []


def test_a_refresh_that_dies_changes_nothing(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"))
    step(spark, store, [("a", "1", "p")])

    def fails(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.refresh(spark.createDataFrame([("a", 1, "2")], "file string, size long, version string"), lambda x: x.select("file", F.lit("s").alias("sha"), F.lit("x").alias("lang"), F.lit("q").alias("text"), F.lit(False).alias("generated")), fails, anchor)
    store.spark.range(1).write.parquet(f"{store.path}/run-000002")
    store.spark.range(1).write.parquet(f"{store.path}/manifest-000009")
    os.unlink(f"{store.path}/manifest-000009/_SUCCESS")
    assert [r["name"] for r in store.facts().collect()] == ["p"]
    assert step(spark, store, [("a", "2", "q")]) == {"a": "extracted"} and [r["name"] for r in store.facts().collect()] == ["q"]
    assert files.FILES == 8000
