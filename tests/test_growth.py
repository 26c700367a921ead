"""What keeps tasks and the driver small on larger tables: the shape of plans and steps, on small ones."""

from __future__ import annotations

import pyarrow as pa

from affinis import keeping
from affinis.operators import anchors, cochange, facts, graph, heat, imports, structure
from affinis.plans import queries as plans


def plan(df, capsys) -> str:
    df.explain()
    return capsys.readouterr().out


def test_imports_never_broadcast_what_was_exploded(spark, capsys):
    asked = spark.range(10).selectExpr("concat('s', id) site", "concat('src/p', id, '.ts') file", "concat('./p', id + 1, '.js') spec")
    tree = spark.range(10).selectExpr("concat('src/p', id, '.ts') file")
    resolved = imports.resolve(asked, tree)
    assert "BroadcastExchange" not in plan(resolved, capsys) + plan(facts.tests(resolved), capsys)
    assert {(r.file, r.target) for r in resolved.collect()} == {(f"src/p{k}.ts", f"src/p{k + 1}.ts") for k in range(9)}


def test_edges_of_tests_never_broadcast(spark, capsys, tmp_path):
    spark.range(1, 50).selectExpr("id p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    got = plans.tests_edges(spark, str(tmp_path))
    assert "BroadcastExchange" not in plan(got, capsys)
    assert {(r.src, r.dst) for r in got.collect()} == {(f"file:src/p{k}.test.ts", f"file:src/p{k + 1}.ts") for k in range(1, 49) if (k + 1) % 7}


def test_edges_of_tests_resolve_what_tests_import_and_shuffle_two_keys_of_each(spark, monkeypatch, tmp_path):
    spark.range(1, 50).selectExpr("id p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    asked, dealt, kind = [], [], type(spark.range(0))
    resolve, repartition = imports.resolve, kind.repartition
    monkeypatch.setattr(imports, "resolve", lambda rows, tree: asked.extend(r.file for r in rows.collect()) or resolve(rows, tree))
    monkeypatch.setattr(kind, "repartition", lambda self, *a: (dealt.append(self.count()) if "site" in self.columns else None) or repartition(self, *a))
    assert plans.tests_edges(spark, str(tmp_path)).count() == 41
    assert sorted(asked) == sorted(f"src/p{k}.test.ts" for k in range(1, 50))
    assert dealt == [2 * 49]


def test_sources_are_lexed_once_and_many_to_a_batch(spark, capsys):
    rows = spark.createDataFrame([(f"f{k}", "TypeScript", f'@Controller("/c{k}")\nclass A {{\n @Get("/x")\n f() {{}}\n}}') for k in range(100)], "file string, lang string, text string")
    found = anchors.matches(rows)
    assert plan(found, capsys).count("MapInArrow") == 1
    assert {(r.file, r.verb, r.route) for r in found.collect()} == {(f"f{k}", "GET", f"/c{k}/x") for k in range(100)}
    batch = pa.RecordBatch.from_pylist([{"file": f"f{k}", "lang": "Go", "text": "f(1); g(2)", "line": 1} for k in range(100)])
    assert [b.num_rows for b in structure._batches(iter([batch]))] == [200]


def test_diffusion_of_large_graphs_writes_a_number_a_node_and_round(spark, monkeypatch, tmp_path):
    ids = spark.range(3000)
    edges = ids.selectExpr("id src", "(id * 7 + 3) % 3000 dst", "'a' kind", "0.7D w").unionByName(ids.selectExpr("id src", "(id * id) % 2999 dst", "'a' kind", "1.0D w"))
    both = keeping.kept(graph.conductance(edges))
    seeds = spark.createDataFrame([("a", 5, 1.0), ("b", 5, 0.5), ("b", 9, 1.0), ("c", 5000, 1.0)], "change string, node long, mass double")
    want = {(r.change, r.node): r.heat for r in heat.fields(both, seeds, 2.0).collect()}
    monkeypatch.setattr(heat, "KERNEL_EDGES", 0)
    monkeypatch.setattr(heat, "BLOCK_EDGES", 500)
    monkeypatch.setattr(heat, "TASK_VALUES", 7000)
    made = []
    monkeypatch.setattr(heat, "kept_path", lambda df: made.append(keeping.kept_path(df)) or made[-1])
    got = {(r.change, r.node): r.heat for r in heat.fields(both, seeds, 2.0).collect()}
    assert all(abs(v - want.get(k, 0.0)) < 1e-12 for k, v in got.items()) and want.keys() <= got.keys()
    assert {spark.read.parquet(p).selectExpr("sum(length(y)) n").first().n for p in made} == {3001 * 2 * 8, 3001 * 8}


def test_diffusion_tasks_read_the_values_of_a_part_of_the_nodes_at_a_time(spark, monkeypatch):
    ids = spark.range(1500)
    edges = ids.selectExpr("concat('n', id) src", "concat('n', (id * 7 + 3) % 1500) dst", "'a' kind", "0.7D w").unionByName(ids.selectExpr("concat('n', id) src", "concat('n', (id * id) % 1499) dst", "'a' kind", "1.0D w"))
    both = keeping.kept(graph.conductance(edges))
    seeds = spark.createDataFrame([("n5", 1.0), ("n9", 0.5), ("far", 1.0)], "node string, mass double")
    want = {r.node: r.heat for r in heat.heat(both, seeds, 0.5, 3, kernel=True).collect()}
    terms = {r.node: r.tk for r in heat.basis(both, seeds, 3).collect()}
    read = heat._values

    def bounded(*asked):
        got = read(*asked)
        assert sum(v.size for v in (got.values() if isinstance(got, dict) else [got])) <= 750
        return got

    monkeypatch.setattr(heat, "BLOCK_EDGES", 300)
    monkeypatch.setattr(heat, "KERNEL_EDGES", 0)
    monkeypatch.setattr(heat, "_values", bounded)
    got = {r.node: r.heat for r in heat.heat(both, seeds, 0.5, 3).collect()}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-12 for n in want)
    got = {r.node: r.tk for r in heat.basis(both, seeds, 3).collect()}
    assert got.keys() == terms.keys() and all(abs(x - y) < 1e-12 for n in terms for x, y in zip(got[n], terms[n], strict=True))


def test_rounds_take_changes_together_and_write_short_rows(spark, monkeypatch):
    ids = spark.range(600)
    both = keeping.kept(graph.conductance(ids.selectExpr("id src", "(id * 7 + 3) % 600 dst", "'a' kind", "0.7D w")))
    seeds = spark.createDataFrame([("a", 5, 1.0), ("b", 9, 1.0), ("c", 7, 1.0)], "change string, node long, mass double")
    want = {(r.change, r.node): r.heat for r in heat.fields(both, seeds, 0.5, 3).collect()}
    monkeypatch.setattr(heat, "KERNEL_EDGES", 0)
    monkeypatch.setattr(heat, "ROW_VALUES", 100)
    made = []
    monkeypatch.setattr(heat, "kept_path", lambda df: made.append(keeping.kept_path(df)) or made[-1])
    got = {(r.change, r.node): r.heat for r in heat.fields(both, seeds, 0.5, 3).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert [spark.read.parquet(p).selectExpr("sum(length(y)) n").first().n for p in made] == [600 * 8] + 5 * [3 * 600 * 8]
    assert {spark.read.parquet(p).selectExpr("max(length(y)) n").first().n for p in made} == {800}
    assert heat.TASK_VALUES >= 3 * 66_600_000, "warmed_fields on 360 copies of sf0.1: three changes of 66.6 million nodes"


def test_pairs_of_commits_take_no_join_with_themselves(spark, capsys, monkeypatch):
    commits = spark.createDataFrame([(c, c, i) for c in range(40) for i in range(c % 26 + 1)] + [(1, 99, None), (2, 50, 0)], "commit long, ts long, item long")
    monkeypatch.setattr(keeping, "tasks_for", lambda df, rows=0: 7)
    monkeypatch.setattr(cochange, "tasks_for", lambda df, rows=0: 7)
    got = cochange.pairs(commits)
    text = plan(got, capsys)
    assert text.count("Join") <= 2 and "14" in text
    rows = [(c, 50 if (c, i) == (2, 0) else c, i) for c in range(40) for i in range(c % 26 + 1) if 2 <= c % 26 + 1 <= 24]
    want = {}
    for c, ts, i in rows:
        for d, us, j in rows:
            if c == d and i < j:
                n, last = want.get((i, j), (0, 0))
                want[i, j] = (n + 1, max(last, ts, us))
    assert {(r.a, r.b): (r.n, r.last_ts) for r in got.collect()} == {k: v for k, v in want.items() if v[0] > 1}


def test_seed_literals_find_every_link(spark, tmp_path):
    spark.range(300).selectExpr("id page_id", "concat('https://x.org/p/', id) url", """'<a href="/shop/all">' html""").write.parquet(f"{tmp_path}/pages.parquet")
    got = plans.seed_literals(spark, str(tmp_path)).where("q = '/shop/all'")
    assert {(r.node, r.score) for r in got.collect()} == {(k, 1.0) for k in range(300)}


def test_seed_literals_find_the_route_of_every_page(spark, tmp_path):
    spark.range(30).selectExpr("id page_id", "concat('https://x.org/shop/all/p', id) url", """'<a href="/shop/all">' html""").write.parquet(f"{tmp_path}/pages.parquet")
    got = plans.seed_literals(spark, str(tmp_path)).where("q = '/shop/all' and node >= 1000000000")
    assert {(r.node, r.score) for r in got.collect()} == {(1000000000 + k, 0.9) for k in range(30)}


def test_heat_of_customers_is_made_once(spark, capsys):
    for name in ("impact_by_nation", "reveal_capped"):
        assert "MapIn" not in plan(plans.QUERIES[name](spark, "/root/testdata/sf0.001"), capsys)
