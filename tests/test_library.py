from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.functions import identifiers as I
from affinis.functions import literals as L
from affinis.functions import paths as P
from affinis.functions import scores as S
from affinis.operators import basins, bridge, cochange, discover, graph, heat, resolve, reveal
from affinis.plans.engine import Engine, fitted
from affinis.sources import files
from affinis.streaming import provenance, sync


def one(spark, *columns):
    return spark.range(1).select(*columns).collect()[0]


@pytest.mark.parametrize(("k", "t", "value"), [(0, 3.0, 4.880792585865), (1, 3.0, 3.953370217403), (5, 10.0, 777.188286403), (0, 0.0, 1.0), (3, 0.0, 0.0)])
def test_bessel(k, t, value):
    assert S.bessel_i(k, t) == pytest.approx(value, rel=1e-9)


def random_graph(n=60, p=0.08, seed=42):
    rng = np.random.default_rng(seed)
    pairs = [(i, j, 0.2 + rng.random()) for i in range(n) for j in range(i + 1, n) if rng.random() < p]
    src, dst, w = (np.array(x) for x in zip(*pairs, strict=True))
    return np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([w, w])


def by_eigenvalues(src, dst, w, x, t):
    n = len(x)
    a = np.zeros((n, n))
    a[src, dst] = w
    d = a.sum(1)
    s = np.divide(1, np.sqrt(d), out=np.zeros(n), where=d > 0)
    values, vectors = np.linalg.eigh(np.eye(n) - s[:, None] * a * s[None, :])
    return vectors @ (np.exp(-t * values) * (vectors.T @ x))


@pytest.mark.parametrize("t", [0.5, 2.0, 8.0, 16.0])
def test_diffusion_is_the_exponential(t):
    src, dst, w = random_graph()
    x = np.zeros(60)
    x[7], x[23] = 1, 0.5
    order = S.order_for(t)
    got = sum(c * v for c, v in zip(S.heat_coefficients(t), heat.polynomials(src, dst, w, x, order), strict=True))
    assert np.abs(got - by_eigenvalues(src, dst, w, x, t)).max() < 1e-8
    assert got.min() > -1e-9


def test_heat_kernel_equals_rounds(spark):
    src, dst, w = random_graph(20, 0.2)
    both = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(src, dst, w, strict=True)], "src long, dst long, w double")
    start = spark.createDataFrame([(3, 1.0), (900, 1.0)], "node long, mass double")
    a = {r.node: r.heat for r in heat.heat(both, start, 0.4, 4, kernel=True).collect()}
    b = {r.node: r.heat for r in heat.heat(both, start, 0.4, 4, kernel=False).collect()}
    c = {r.node: r.heat for r in heat.field(heat.basis(both, start, 9), 0.4, 4).collect()}
    assert a.keys() == b.keys() == c.keys() and all(abs(a[k] - b[k]) < 1e-9 and abs(a[k] - c[k]) < 1e-9 for k in a)
    assert heat.heat(both.limit(0), start.limit(0), 1.0, 3, kernel=True).count() == 0


@pytest.mark.parametrize(
    ("text", "kind", "key"),
    [("DATABASE_URL", "env", "DATABASE_URL"), ("/api/users/:id", "path", "/api/users/{*}"), ("https://x.org/api/users/{id}/", "path", "/api/users/{*}"), ("user.created", "word", "user.created"), ("ab", None, None), ("plainword", None, None)],
)
def test_literals(spark, text, kind, key):
    k = L.classify(F.lit(text))
    r = one(spark, k.alias("kind"), L.normalize(F.lit(text), k).alias("key"))
    assert (r.kind, r.key if kind else None) == (kind, key)


def test_bridges(spark):
    rows = [("a.go", "n0", 1, "/api/users/:id"), ("b.ts", "n1", 1, "/api/users/{id}"), ("c.rs", "n2", 2, "/api/users/${x}"), ("a.go", "n3", 5, "DATABASE_URL"), ("d.py", "n4", 1, "DATABASE_URL"), ("a.go", "n5", 9, "/lonely/path"), ("e", None, 1, None)]
    sites = spark.createDataFrame(rows, "file string, node string, line int, text string")
    got = {(r.a, r.b): r.w for r in bridge.bridges(sites).collect()}
    assert set(got) == {("n0", "n1"), ("n0", "n2"), ("n1", "n2"), ("n3", "n4")}
    wide = spark.createDataFrame([(f"f{i}", f"n{i}", 1, "/every/where") for i in range(49)], "file string, node string, line int, text string")
    assert bridge.bridges(wide).count() == 0 and bridge.index(wide).count() == 1
    assert bridge.bridges(sites.limit(0)).count() == 0


def test_identifiers(spark):
    r = one(spark, I.terms(F.lit("findUsersByHTTPStatuses the running_boxes")).alias("t"), I.dice(F.lit("night"), F.lit("nacht")).alias("d"), I.dice(F.lit("aa"), F.lit("aaaa")).alias("m"), I.same_terms(F.lit("user load"), F.lit("X.loadUser")).alias("s"), I.similarity(F.lit("load user"), F.lit("LoadUser")).alias("y"))
    assert r.t == ["user", "by", "http", "statuse", "runn", "box"] and r.d == 0.25 and r.m == 0.5 and r.s and r.y == 1.0


def test_scores(spark):
    r = one(spark, S.pair_score(F.lit(20), F.lit(20), F.lit(20)).alias("a"), S.pair_score(F.lit(0), F.lit(0), F.lit(0)).alias("z"), S.recency(F.lit(30.0)).alias("h"), S.decayed(F.lit(1.0), F.lit(-5.0)).alias("back"), S.decayed(F.lit(1.0), F.lit(96.0)).alias("q"))
    assert (r.a, r.z, r.h, r.back, r.q) == (0.5, 0.0, 0.5, 1.0, 0.25)


def test_cochange(spark):
    days = lambda d: 1_700_000_000 - d * 86400
    commits = [(c, days(d), f) for c, d, fs in ((1, 100, "ab"), (2, 90, "ab"), (3, 3, "ac"), (4, 2, "ac"), (5, 1, "a")) for f in fs] + [(9, days(1), f"f{i}") for i in range(25)] * 2
    rows = spark.createDataFrame(commits, "commit long, epoch long, item string").select("commit", F.timestamp_seconds("epoch").alias("ts"), "item")
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    pairs = cochange.kept(cochange.pairs(rows), now)
    got = {(r.a, r.b): r.eff for r in pairs.collect()}
    assert set(got) == {("a", "b"), ("a", "c")} and got["a", "c"] > 5 * got["a", "b"]
    out = cochange.reseed(spark.createDataFrame([("a",)], "item string"), pairs, now).collect()
    assert {r.partner for r in out} == {"b", "c"}


def test_resolution(spark):
    sites = spark.createDataFrame([("f", 5, "s1"), ("f", 1, "s0"), ("g", 9, "s2")], "file string, line int, site string")
    symbols = spark.createDataFrame([("f", 3, "x"), ("f", 5, "y"), ("f", 5, "z"), ("f", 8, "w")], "file string, line int, symbol string")
    assert {r.site: r.symbol for r in resolve.enclosing(sites, symbols).collect()} == {"s0": None, "s1": "z", "s2": None}
    assert {r.site: r.symbol for r in resolve.enclosing(sites, symbols, last=False).collect()} == {"s0": None, "s1": "y", "s2": None}
    paths = spark.createDataFrame([("web/api.ts",), ("lib/util/index.ts",), ("a/x.ts",), ("b/x.ts",)], "file string")
    imports = spark.createDataFrame([(1, "api"), (2, "util"), (3, "x")], "site int, spec string")
    assert {r.site: r.target for r in resolve.by_suffix(imports, paths, [".ts", "/index.ts"]).collect()} == {1: "web/api.ts", 2: "lib/util/index.ts"}
    near = spark.createDataFrame([(1, "web/deep/m.ts", "../api"), (2, "a/y.ts", "./x.js")], "site int, file string, spec string")
    assert {r.site: r.target for r in resolve.relative(near, paths, [".ts"]).collect()} == {1: "web/api.ts", 2: "a/x.ts"}


def cliques(spark, size, bridge_w=0.05):
    rows = [(f"{c}{i}", f"{c}{j}", "invokes", 1.0) for c in "ab" for i in range(size) for j in range(i + 1, size)] + [("a0", "b0", "invokes", bridge_w)]
    return spark.createDataFrame(rows, "src string, dst string, kind string, w double")


def test_basins(spark):
    edges = cliques(spark, 5)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().select("node", F.lit(True).alias("eligible"), F.lit(True).alias("include"))
    got: dict = {}
    for r in basins.detect(edges, nodes).collect():
        got.setdefault(r.basin, set()).add(r.node)
    assert len(got) == 2 and all(len({n[0] for n in b}) == 1 for b in got.values())
    star = spark.createDataFrame([("h", f"l{i}", "invokes", 1.0) for i in range(6)], "src string, dst string, kind string, w double")
    leaves = star.select(F.col("src").alias("node")).union(star.select("dst")).distinct().select("node", (F.col("node") != "h").alias("eligible"), F.lit(True).alias("include"))
    assert basins.detect(star, leaves).count() == 0


def test_graph(spark):
    edges = cliques(spark, 3).withColumn("ord", F.monotonically_increasing_id())
    tri = {r.node: r.tri for r in graph.triangle_density(graph.neighbours(edges)).collect()}
    assert tri["a1"] == 1.0 and tri["a0"] == pytest.approx(1 / 3)
    got = {r.node: r.hop for r in graph.hops(edges, spark.createDataFrame([("a1",)], "node string")).collect()}
    assert got == {"a1": 0, "a0": 1, "a2": 1, "b0": 2, "b1": 3, "b2": 3}
    both = graph.conductance(edges.unionByName(edges.withColumn("w", F.lit(9.0))))
    assert both.count() == 14 and both.agg(F.max("w")).collect()[0][0] == 9.0


def test_discovery(spark):
    rows = [("wire", f"f{i % 5}", i < 17) for i in range(20)] + [("assertEquals", f"f{i % 9}", i < 61) for i in range(235)] + [("rare", "f0", True)] * 5
    hist = discover.histogram(spark.createDataFrame(rows, "key string, file string, is_path boolean"))
    assert [r.key for r in discover.promoted(hist).collect()] == ["wire"]
    rule = discover.synthesized(spark.createDataFrame([("Python", "recv", "sched.ule", 1)], "lang string, shape string, callee string, arg int")).collect()[0]
    assert rule.patterns == ["$R.$M($X0, $P)", "$R.$M($X0, $P, $$$H)"] and rule.methods == r"^(?i:sched\.ule)$"


@pytest.mark.parametrize("budget", [20, 60, 300])
def test_budget(spark, budget):
    lines = [f"line {i} " + "x" * (i % 7) for i in range(100)]
    rows = spark.createDataFrame(list(enumerate(lines, 1)), "rank int, line string")
    got = [r.line for r in reveal.fit(rows, budget, "head").where("shown").orderBy("rank").collect()]
    text, tokens, shown = fitted(lines, "head", budget, "more results")
    assert tokens <= budget and got == lines[:shown] and math.ceil(len(text) / 4) == tokens


def test_drift_and_gate(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file string, sha string")
    after = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "file string, sha string")
    assert {r.file: r.change for r in sync.drift(before, after).collect()} == {"b": "changed", "c": "removed", "d": "added"}
    ledger = sync.Ledger()
    verdicts = [ledger.step(h * 0.01, {"x": 0.06, "y": 0.05}, False, theta=0.05) for h in range(6)]
    assert [v["red"] for v in verdicts] == [True, False, False, False, False, False] and all(v["surprise"] < 0.005 for v in verdicts[1:])
    rows = spark.createDataFrame([("s", k, float(k), n, 0.2, False) for k in range(3) for n in ("x", "y")], "session string, step long, hours double, node string, mass double, structural boolean")
    assert [r.red for r in sync.gate(rows).orderBy("step").collect()] == [True, False, False]


def test_stream_gate(spark, tmp_path):
    schema = "session string, step long, hours double, node string, mass double, structural boolean"
    for k in range(3):
        spark.createDataFrame([("s", k, float(k), n, 0.2, False) for n in ("x", "y")], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).json(str(tmp_path / "in"))
    q = sync.stream_gate(stream).writeStream.format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.step, r.red) for r in spark.table("verdicts").collect()) == [(0, True), (1, False), (2, False)]


def test_provenance(spark):
    rows = spark.createDataFrame([("f", "0", "1", "me", "t1", 1, 100), ("f", "1", "2", "you", "t2", 2, 100), ("g", "0", "5", "you", "t3", 1, 100), ("h", "3", "3", "me", "t4", 1, 100)], "file string, before_sha string, after_sha string, owner string, tool_call_id string, commit_order long, at long")
    changes = spark.createDataFrame([("f", "0", "2"), ("g", "0", "5"), ("k", "0", "1")], "file string, before_sha string, after_sha string")
    got = {r.file: (r.owners, r.kind) for r in provenance.attribute(provenance.journal(rows, 200), changes, "me").collect()}
    assert got == {"f": (["me", "you"], "mixed"), "g": (["you"], "other"), "k": ([], "unattributed")}


def test_paths(spark):
    r = one(spark, P.is_junk(F.lit("a/node_modules/b.js")).alias("j"), P.is_test_scope(F.lit("web/api.test.ts")).alias("t"), P.folder2(F.lit("a/b/c.py")).alias("f"), P.resolve(F.lit("a/./b/../c")).alias("r"), P.file_route(F.lit("(shop)/reports/[id]/index")).alias("route"), P.verb(F.lit("GetMapping")).alias("v"), P.verb_in_path(F.lit("GET /x")).alias("p"), P.join_route(F.lit("/api/"), F.lit("users")).alias("jr"), P.in_scope(F.lit("web/api.ts"), "web").alias("s"))
    assert r.j and r.t and r.s and (r.f, r.r, r.route, r.v, r.jr) == ("a/b/", "a/c", "/reports/{*}", "GET", "/api/users") and (r.p.verb, r.p.path) == ("GET", "/x")


def test_sources_and_engine(spark, tmp_path):
    (tmp_path / "web").mkdir()
    (tmp_path / "web/api.py").write_text('import os\n\nclass Api:\n    def load(self):\n        return os.getenv("DATABASE_URL")\n')
    (tmp_path / "main.go").write_text('package main\n\nfunc Main() {\n}\n')
    (tmp_path / "conf.yaml").write_text('url: /api/users\nkey: "DATABASE_URL"\n')
    (tmp_path / "x.min.js").write_text("a")
    c = files.contents(spark, str(tmp_path))
    assert {r.file: r.status for r in c.collect()} == {"web/api.py": "ok", "main.go": "ok", "conf.yaml": "ok", "x.min.js": "generated"}
    assert {(r.fact, r.name) for r in files.python_facts(c).collect()} >= {("symbol", "Api"), ("symbol", "Api.load"), ("import", "os"), ("call", "getenv")}
    assert ("symbol", "Main") in {(r.fact, r.name) for r in files.pattern_facts(c).collect()}
    assert {r.text for r in files.config_literals(files.lines(c)).where("file = 'conf.yaml'").collect()} == {"/api/users", "DATABASE_URL"}
    edges = cliques(spark, 5).withColumn("ord", F.monotonically_increasing_id())
    names = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    nodes = names.select("node", F.concat(F.lit("get"), F.upper("node")).alias("name"), F.lit("function").alias("kind"), F.concat(F.left("node", F.lit(1)), F.lit(".py")).alias("file"), F.lit(3).alias("line"), F.lit("").alias("sig"))
    engine = Engine(nodes, edges)
    first = engine.focus("getA0", 300)
    assert "getA0" in first.text and first.tokens <= 300
    more = engine.dwell(2.0, 300)
    assert more.tokens <= 300 and engine.t == 4.0
    assert engine.focus("nothing like it").details["seeds"] == 0
    assert engine.sketch(300).tokens <= 300


def test_anchors(spark, tmp_path):
    rows = [
        ("main.go", 10, '  r.GET("/api/users/:id", GetUser)', "Go"), ("mux.go", 7, '  mux.HandleFunc("GET /healthz", h)', "Go"), ("mux.go", 9, '  r.Method("GET", "/x/y", h)', "Go"), ("App.kt", 5, '  get("/health") {', "Kotlin"),
        ("U.java", 3, '@RequestMapping("/api/users")', "Java"), ("U.java", 6, '  @GetMapping("/{id}")', "Java"), ("a.ts", 4, "@Controller('airports')", "TypeScript"), ("a.ts", 8, "  @Get(':code')", "TypeScript"), ("urls.py", 12, '    path("jobs/", view),', "Python"),
        ("routes.rb", 2, '  get "/rails/x", to: "a#b"', "Ruby"), ("web.ts", 2, "fetch(`/api/users/${id}`)", "TypeScript"), ("x.py", 1, 'd.get("not a path")', "Python"),
    ]
    lines = spark.createDataFrame(rows, "file string, line int, text string, lang string")
    from affinis.operators import anchors

    got = {(r.file, r.verb, r.route) for r in anchors.matches(lines).collect()}
    assert got == {
        ("main.go", "GET", "/api/users/{*}"), ("mux.go", "GET", "/healthz"), ("mux.go", "GET", "/x/y"), ("App.kt", "GET", "/health"), ("U.java", "GET", "/api/users/{*}"), ("a.ts", "GET", "/airports/{*}"), ("urls.py", "ANY", "/jobs"), ("routes.rb", "GET", "/rails/x"), ("web.ts", "GET", "/api/users/{*}"),
    }
    assert anchors.collapse(anchors.labelled(anchors.matches(lines))).where("label = 'GET /api/users/{*}'").collect()[0].files == 3
    calls = spark.createDataFrame([("print",), ("LoadUser",), ("x",), ("toString",)], "callee string")
    assert [r.callee for r in anchors.telling_calls(calls).collect()] == ["LoadUser"]
    (tmp_path / "rules.json").write_text('{"rules": [{"id": "own", "langs": ["Python"], "form": "recv", "methods": "schedule"}, {"id": 3}]}')
    assert [r.id for r in anchors.user_rules(str(tmp_path / "rules.json"))] == ["own"] and anchors.user_rules("/nowhere") == []
    jobs = spark.createDataFrame([(f"f{k % 2}.py", k, f'jobm.schedule(x, "/jobs/{k}")', "Python") for k in range(6)], "file string, line int, text string, lang string")
    hist = discover.histogram(anchors.call_signatures(jobs))
    assert [r.key for r in discover.promoted(hist).collect()] == ["Python|recv|schedule|1"]
    r = one(spark, sync.channel(F.array(F.lit("literal"), F.lit("call"))).alias("a"), sync.channel(F.array(F.lit("?"))).alias("b"))
    assert (r.a, r.b) == (1.0, 0.5) and sync.assembled(["a" * 40, "b" * 400, "c"], 20) == "a" * 40 + "\nc"


def test_read_windows():
    from affinis.plans.engine import read_windows

    got = read_windows([("a", 10, "x"), ("a", 30, "y"), ("b", 2, "z"), ("b", 0, "none"), ("a", 200, "w")])
    assert [(w["path"], w["offset"], w["limit"]) for w in got] == [("a", 5, 45), ("b", 1, 25), ("a", 195, 25)]


def test_suggestions_of_many_queries_equal_the_full_scan(spark):
    from affinis.functions import identifiers as names
    from affinis.operators import seeds

    known = ["loadUser", "saveUser", "Admin.loadUsers", "x", "HTTPServer", "parseLine", "user", "aa", "the", "load_user_profile", "pars", "UserS", "run2"]
    nodes = spark.createDataFrame([(k, n, "file" if n == "pars" else "function", f"f{k % 3}") for k, n in enumerate(known)], "node long, name string, kind string, file string")
    asked = spark.createDataFrame([(q,) for q in ("load the users", "parse", "zzz", "", "http server", "user", "aaa", "a b")], "q string")
    scored = asked.crossJoin(nodes.where("kind <> 'file'")).withColumn("score", names.similarity(F.col("q"), F.col("name"))).where(F.col("score") >= seeds.ALIKE)
    want: dict = {}
    for r in scored.collect():
        want.setdefault(r.q, []).append((-round(r.score, 12), r["name"], r.file, r.node))
    want = {q: [(n, -s) for s, n, _, _ in sorted(v)[: seeds.SUGGESTIONS]] for q, v in want.items()}
    got: dict = {}
    for r in seeds.suggestions(asked, nodes).collect():
        got.setdefault(r.q, []).append((r["name"], round(r.score, 12)))
    assert got == want and len(want) > 4
