from __future__ import annotations

import pytest

from affinis.operators import anchors, discover, structure


def calls(text, lang, line=1):
    return [(r[0], r[2], r[3], r[4], r[5], [a["content"] if a["content"] is not None else a["text"] for a in r[7]]) for r in structure.Source(text, lang, line).calls()]


@pytest.mark.parametrize(("lang", "text", "want"), [
    ("TypeScript", 'app\n  .get(\n    "/a/b",\n    (req) => { send("x, y", [1, 2]) },\n  );', [(4, "send", "call", None, False, ["x, y", "[1, 2]"]), (1, "get", "call", "app", False, ["/a/b", '(req) => { send("x, y", [1, 2]) }'])]),
    ("TypeScript", '// f("no")\n/* g("no") */ f("a"); const s = "h(1)"; a.b(1).c(`t${x}`)', [(2, "f", "call", None, False, ["a"]), (2, "b", "call", "a", False, ["1"]), (2, "c", "call", "a.b(1)", False, ["t${x}"])]),
    ("TypeScript", "@Get(':x')\nfind(@Param('y') y: string) {}", [(1, "Get", "call", None, True, [":x"]), (2, "Param", "call", None, True, ["y"]), (2, "find", "call", None, False, ["@Param('y') y: string"])]),
    ("Python", 'def f(a):\n    """g(1)"""\n    return h(\n        r"x\\d", k=1)  # i()\n', [(3, "h", "call", None, False, ["x\\d", "k=1"])]),
    ("Python", '@app.route("/x", methods=["GET"])\nasync def view(): pass', [(1, "route", "call", "app", True, ["/x", 'methods=["GET"]'])]),
    ("Go", "func (s *T) Run(x int) { r := mux.New(); go r.GET(\"/a\", h) }", [(1, "New", "call", "mux", False, []), (1, "GET", "call", "r", False, ["/a", "h"])]),
    ("Java", 'public String ping() { return call("a"); }', [(1, "call", "call", None, False, ["a"])]),
    ("Rust", "let c = 'x'; fn f<'a>(b: &'a str) {} Router::new().route(\"/a\", get(h))", [(1, "new", "call", "Router", False, []), (1, "get", "call", None, False, ["h"]), (1, "route", "call", "Router::new()", False, ["/a", "get(h)"])]),
    ("Ruby", 'get "/up", to: "a#b",\n  via: :all\nx = get "no"\n', [(1, "get", "macro", None, False, ["/up", 'to: "a#b"', "via: :all"])]),
    ("Elixir", 'scope "/api" do\n  get "/h", C, :show\nend', [(1, "scope", "macro", None, False, ["/api"]), (2, "get", "macro", None, False, ["/h", "C", ":show"])]),
    ("Kotlin", 'get("/p") { call.respond("pong") }', [(1, "get", "call", None, False, ["/p"]), (1, "respond", "call", "call", False, ["pong"])]),
    ("C", "int main(void) { if (x) { puts(\"a\"); } }", [(1, "puts", "call", None, False, ["a"])]),
    ("Go", ")]} f( (", []), ("Bash", "", []),
])
def test_calls(lang, text, want):
    assert calls(text, lang) == want


def test_long_chains_and_deep_brackets_stay_linear():
    chain = "a" + ".b(1)" * 20_000
    assert len(calls(chain, "TypeScript")) == 20_000
    assert len(calls("f(" * 20_000 + ")" * 20_000, "Go")) == 20_000


SOURCES = {
    "server/main.go": ("Go", 'func Routes() {\n\tr.GET("/api/users/:id", Get); r.POST(\n\t\t"/api/users",\n\t\tCreate,\n\t)\n}\n'),
    "server/mux.go": ("Go", 'func f() {\n mux.HandleFunc("GET /healthz", h)\n mux.HandleFunc("POST /v2/shutdown", s)\n r.Method("GET", "/api/metrics", m)\n r.Method("FOO", "/none", m)\n}\n'),
    "server/App.kt": ("Kotlin", 'fun R() {\n  get("/ktor-ping") { call.respond("pong") }\n  post("/ktor-hook") { x() }\n}\n'),
    "server/U.java": ("Java", '@RequestMapping("/api/spring")\npublic class U {\n    @GetMapping("/ping")\n    public String ping() { return "pong"; }\n    @PostMapping("/save")\n    public void save() {}\n}\n'),
    "server/router.ex": ("Elixir", 'scope "/api" do\n    get "/elixir-health", H, :show\n    post "/elixir-events", E, :create\n  end\n  forward "/ops", OpsRouter\n'),
    "server/routes.rb": ("Ruby", 'get "/up", to: "health#show"\nmatch "/webhook", to: "h#r", via: [:post]\nroot "home#index"\n'),
    "worker/urls.py": ("Python", 'urlpatterns = [\n    path("jobs/", view, name="jobs"),\n    re_path(r"^legacy/(?P<pk>[0-9]+)/$", old),\n]\n'),
    "web/a.controller.ts": ("TypeScript", "@Controller('api/airports')\nexport class A {\n  @Get('search')\n  search() {}\n\n  @Get(':iata')\n  find() {}\n}\n"),
    "web/api.ts": ("TypeScript", 'const r = await fetch(`/api/users/${id}`);\nawait fetch("/api/users", { method: "POST" });\naxios.get(`/api/orders/${id}`);\n// fetch("/no/comment")\nlog("fetch(\'/no/text\')");\n'),
    "worker/scheduler.py": ("Python", 'def boot():\n    jobm.schedule("/ops/defrag", defrag)\n    jobm.schedule(\n        "/ops/canonicalize",\n        canonicalize)\n    jobm.schedule("/ops/reindex", reindex)\n    jobm.schedule("/ops/logdigest", d)\n'),
    "worker/reports.py": ("Python", 'def nightly():\n    jobm.schedule("/ops/reports/churn", churn)\n    jobm.schedule("/ops/reports/weasel", weasel)\n'),
}


@pytest.fixture(scope="module")
def scanned(spark):
    files = spark.createDataFrame([(f, lang, text) for f, (lang, text) in SOURCES.items()], "file string, lang string, text string")
    return structure.calls(files).cache()


def test_rules(scanned):
    got = {(r.file, r.line, f"{r.verb} {r.route}") for r in anchors.matches(scanned).collect()}
    assert got == {
        ("server/main.go", 2, "GET /api/users/{*}"), ("server/main.go", 2, "POST /api/users"), ("server/mux.go", 2, "GET /healthz"), ("server/mux.go", 3, "POST /v2/shutdown"), ("server/mux.go", 4, "GET /api/metrics"),
        ("server/App.kt", 2, "GET /ktor-ping"), ("server/App.kt", 3, "POST /ktor-hook"), ("server/U.java", 3, "GET /api/spring/ping"), ("server/U.java", 5, "POST /api/spring/save"),
        ("server/router.ex", 2, "GET /elixir-health"), ("server/router.ex", 3, "POST /elixir-events"), ("server/router.ex", 5, "ANY /ops"), ("server/routes.rb", 1, "GET /up"), ("server/routes.rb", 2, "ANY /webhook"),
        ("worker/urls.py", 2, "ANY /jobs"), ("web/a.controller.ts", 3, "GET /api/airports/search"), ("web/a.controller.ts", 6, "GET /api/airports/{*}"),
        ("web/api.ts", 1, "GET /api/users/{*}"), ("web/api.ts", 2, "GET /api/users"), ("web/api.ts", 3, "GET /api/orders/{*}"),
    }


def test_discovered_rules_act(spark, scanned):
    hist = discover.histogram(anchors.call_signatures(scanned))
    new = discover.promoted(hist, anchors.covered(hist))
    assert [(r.key, r.n, r.path_n, r.files) for r in new.collect()] == [("Python|recv|schedule|0", 6, 6, 2)]
    got = {(r.file, r.line, r.verb, r.route) for r in anchors.discovered(scanned, new).collect()}
    assert {x[3] for x in got} == {"/ops/defrag", "/ops/canonicalize", "/ops/reindex", "/ops/logdigest", "/ops/reports/churn", "/ops/reports/weasel"} and {x[2] for x in got} == {"SCHEDULE"}
    assert ("worker/scheduler.py", 3, "SCHEDULE", "/ops/canonicalize") in got
    rule = discover.synthesized(new).collect()[0]
    own = anchors.Rule(rule.id, ("Python",), tuple(rule.patterns), rule.methods, implicit=True)
    assert {(r.file, r.line, r.verb, r.route) for r in anchors.matches(scanned, [own]).collect()} == got
    assert anchors.covered(spark.createDataFrame([("Java", "dec", "GetMapping", 0), ("Java", "recv", "GetMapping", 0), ("Go", "recv", "GET", 0), ("Python", "bare", "path", 0), ("Kotlin", "dec", "Get", 0)], "lang string, shape string, callee string, arg int")).count() == 3


def test_rules_of_a_repository(scanned):
    text = """{"rules": [{"id": "jobs", "langs": ["Python"], "pattern": "$R.$M($P, $$$H)", "methods": "^schedule$"}, {"id": "bad", "langs": ["Go"], "pattern": "a b c (", "methods": "x"}, {"id": 3}, 7,
      {"id": "two", "langs": ["Go"], "patterns": ["mux.$M($P, h)"], "methods": "^(?i:handlefunc)$"}], "fileRoutes": [{"id": "x", "re": "^pages/(.+)\\\\.vue$", "verbs": "suffix"}, {"re": "(", "verbs": "suffix"}, {"re": "a(b)", "verbs": "?"}]}"""
    rules, routes, digest = anchors.rules_of(text)
    assert [r.id for r in rules[len(anchors.RULES) :]] == ["jobs", "two"] and [r.id for r in routes[-1:]] == ["x"] and len(routes) == 8
    assert digest != anchors.rules_of(None)[2] and digest != anchors.rules_of(text + " ")[2]
    got = [(r.file, r.line, r.rule) for r in anchors.matches(scanned, rules[len(anchors.RULES) :]).collect()]
    assert sorted(got)[0] == ("server/mux.go", 2, "two") and len(got) == 7
    assert anchors.rules_of("{")[0] == anchors.RULES and anchors.rules_of("[]")[1] == anchors.rules_of(None)[1]


@pytest.mark.parametrize("text", ["$M", "f($$$A, $B)", "f(a + b)", "f(g(x))", "", "if x"])
def test_patterns_that_are_no_calls(text):
    assert anchors.rule_of({"id": "x", "langs": ["Go"], "pattern": text, "methods": "m"}) is None or text == "if x"


def test_odd_sources(spark):
    rows = spark.createDataFrame([("a", "Cobol", "f(1)"), ("b", "Go", None), ("c", "Go", ""), ("d", None, "f(1)"), ("e", "Go", "f(" + "x, " * 40 + '"' + "y" * 900 + '")')], "file string, lang string, text string")
    out = structure.calls(rows).collect()
    assert [(r.file, r.callee, len(r.args)) for r in out] == [("e", "f", structure.ARGUMENTS)]
    assert structure.calls(rows.limit(0)).count() == 0
