"""Feature anchors: rules for call sites that declare or use routes, as patterns of calls, and call hygiene."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.functions import literals as L
from affinis.functions import paths as P

from . import structure

@dataclass(frozen=True)
class Rule:
    """Call sites that declare or use routes: languages, patterns with the path in $P, and the callee's names.

    ``prefixes`` are patterns of what stands before all routes of a file, ``verb_from`` names the hole of a verb, and paths
    of a ``mount_root`` rule begin at the root.
    """

    id: str
    langs: tuple[str, ...]
    patterns: tuple[str, ...]
    methods: str
    kind: str = "route"
    prefixes: tuple[str, ...] = ()
    verb_from: str | None = None
    mount_root: bool = False
    implicit: bool = False


TS, JS = ("TypeScript", "Tsx"), ("TypeScript", "Tsx", "JavaScript")
# The default rules, in their order of precedence.
RULES = [
    Rule("http-route-call", (*JS, "Go"), ("$R.$M($P, $$$H)",), "^(?i:get|post|put|delete|patch|head|options|all|use|any|handle|handlefunc|route|group)$"),
    Rule("http-verb-single-arg", JS, ("$R.$M($P)",), "^(?i:get|post|put|delete|patch)$"),
    Rule("http-verb-single-arg-py", ("Python",), ("$R.$M($P)",), "^(get|post|put|delete|patch|head|options)$"),
    Rule("python-route-call", ("Python",), ("$R.$M($P, $$$H)",), "^(?:add_)?(?:get|post|put|delete|patch|head|options|route)$"),
    Rule("ts-http-decorator", TS, ("@$M($P)",), "^(?i:get|post|put|delete|patch|options|head)$", prefixes=("@Controller($P)",)),
    Rule("python-decorator-route", ("Python",), ("@$R.$M($P)",), "^(get|post|put|delete|patch|route|websocket)$"),
    Rule("verb-as-argument", ("Go", "Python", *JS), ('$R.$M("$V", "$P", $$$H)',), "^(?i:method|methodfunc|add_route|add_view|route)$", verb_from="V"),
    Rule("verb-as-argument-norecv", ("Python",), ('$M("$V", "$P", $$$H)',), "^route$", verb_from="V"),
    Rule("django-url", ("Python",), ('$M("$P", $$$H)',), "^(path|re_path|url)$", mount_root=True),
    Rule("rails-route-macro", ("Ruby",), ('$M "$P", $$$R',), "^(get|post|put|delete|patch|match|redirect|mount|root|head|options)$"),
    Rule("phoenix-route-macro", ("Elixir",), ('$M "$P", $$$R',), "^(get|post|put|delete|patch|head|options|forward|resources)$"),
    Rule("phoenix-route-call", ("Elixir",), ('$M("$P", $$$R)',), "^(get|post|put|delete|patch|head|options|forward|resources)$"),
    Rule("ktor-routing-dsl", ("Kotlin",), ('$M("$P") { $$$B }',), "^(get|post|put|delete|patch|head|options|route)$"),
    Rule("spring-mapping-annotation", ("Java", "Kotlin"), ('@$M("$P")',), "^(Get|Post|Put|Delete|Patch)Mapping$", prefixes=('@RequestMapping("$P")',)),
    Rule("flask-add-url-rule", ("Python",), ("$R.add_url_rule($P, $$$H)",), "^add_url_rule$"),
    Rule("fetch-bare", JS, ("$M($P, $$$H)",), "^fetch$"),
    Rule("ktor-respond-redirect", ("Kotlin",), ("$R.$M($P, $$$H)",), "^respondRedirect$"),
    Rule("rust-router-chain", ("Rust",), ('$R.route("$P", $$$H)',), "^route$"),
]
# Verbs, a placeholder alone, and which patterns cover a way of calling.
VERB, PLACEHOLDER = "(?i)^(?:get|post|put|delete|patch|head|options)$", r"^(:[A-Za-z_]\w*|\{[A-Za-z_]\w*\}|\[[A-Za-z_]\w*\])$"
COVERS = {"recv": r"\$R\.\$M\(", "bare": r"\$M[(\s]", "dec": r"@\$(R\.)?M\("}
#: How a rule that names a form instead of a pattern is written.
FORMS = {"recv": "$R.$M($P, $$$H)", "bare": "$M($P, $$$H)", "dec": "@$M($P)", "dec-recv": "@$R.$M($P)", "macro": '$M "$P", $$$R'}
# Callees that say nothing about a program's own structure.
WARDS = [
    "log", "info", "warn", "debug", "trace", "close", "flush", "tostring", "valueof", "tolowercase", "touppercase", "printf", "sprintf", "fprintf", "errorf", "fatal", "fatalf", "panic", "panicf", "println", "print",
    "require", "console", "settimeout", "setinterval", "cleartimeout", "clearinterval", "queuemicrotask", "parseint", "parsefloat", "isnan", "isfinite",
    "it", "describe", "test", "expect", "xit", "xdescribe", "beforeeach", "aftereach", "beforeall", "afterall", "jest", "vitest", "vi", "mock", "spyon",
    "str", "int", "float", "bool", "bytes", "bytearray", "list", "dict", "set", "tuple", "frozenset", "super", "isinstance", "issubclass", "getattr", "setattr", "hasattr", "delattr", "open", "range", "enumerate", "zip",
    "sorted", "next", "all", "any", "sum", "abs", "round", "format", "chr", "ord", "hex", "oct", "bin", "id", "input", "vars", "dir", "callable", "hash", "object", "property", "staticmethod", "classmethod", "memoryview",
    "slice", "type", "repr", "len", "append", "cap", "clear", "delete", "make", "new", "copy", "complex", "real", "imag", "recover", "min", "max",
    "unwrap", "clone", "into", "from", "collect", "iter", "eprintln", "vec", "assert", "asserteq", "assertne", "dbg",
]
# Callees whose path arguments are files, not routes.
DENIED = ["join", "resolve", "dirname", "basename", "expand_path", "readFile", "readFileSync", "existsSync", "open", "load", "loads", "import", "require", "startsWith", "endsWith", "contains", "includes", "equals", "equalsIgnoreCase", "matches", "matchesPattern", "useParams", "matchPath"]


def telling_calls(calls: DataFrame) -> DataFrame:
    """Calls (callee, ...) but those of built-ins, loggers and test frameworks, and of one letter."""
    wards = calls.sparkSession.createDataFrame([(w,) for w in WARDS], "ward string")
    kept = calls.where(F.length("callee") > 1)
    return kept.join(F.broadcast(wards), F.lower("callee") == F.col("ward"), "left_anti")


def scanned(rows: DataFrame) -> DataFrame:
    """Calls as ``structure.calls`` has them, of those or of sources (file, text, lang)."""
    return rows if "args" in rows.columns else structure.calls(rows)


def quoted(rows: DataFrame) -> DataFrame:
    """(key, lang, shape, callee, arg, file, line, content, is_path) of each quoted argument of a call in calls or sources.

    A call is decorated (dec), has a receiver (recv) or neither (bare).
    """
    shape = F.when(F.col("decorated"), "dec").when(F.col("receiver").isNotNull(), "recv").otherwise("bare")
    each = scanned(rows).where("form = 'call'").where(~F.col("callee").isin(DENIED)).select("file", "line", "lang", shape.alias("shape"), "callee", F.posexplode("args").alias("arg", "x")).where("x.content <> ''")
    key = F.concat_ws("|", "lang", "shape", "callee", F.col("arg").cast("string"))
    return each.select(key.alias("key"), "lang", "shape", "callee", "arg", "file", "line", F.col("x.content").alias("content"), F.coalesce(L.classify(F.col("x.content")) == "path", F.lit(False)).alias("is_path"))


def call_signatures(rows: DataFrame) -> DataFrame:
    """(key, lang, shape, callee, arg, file, is_path) of ``quoted``, for ``discover.histogram``."""
    return quoted(rows).drop("line", "content")


def covered(signatures: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Those of the signatures (lang, shape, callee, ...) that a rule binds already: its language, its names and its way of calling."""
    said = F.lit(False)
    for r in RULES if rules is None else rules:
        shapes = [k for k, p in COVERS.items() if any(re.match(p, x) for x in r.patterns)]
        said = said | (F.col("lang").isin(*r.langs) & F.col("shape").isin(*shapes) & F.col("callee").rlike(r.methods))
    return signatures.where(said)


def rule_of(entry: object) -> Rule | None:
    """A rule from its JSON form; None if it is not well formed or not the pattern of a call."""
    if not (isinstance(entry, dict) and isinstance(entry.get("id"), str) and isinstance(entry.get("methods"), str) and isinstance(entry.get("langs"), list)):
        return None
    given = entry.get("patterns") if isinstance(entry.get("patterns"), list) else [entry.get("pattern", FORMS.get(entry.get("form")))]
    prefixes = entry.get("prefixPattern") or []
    try:
        for p in [*given, *prefixes]:
            structure.Pattern(p).parts()
        re.compile(entry["methods"])
    except (TypeError, AttributeError, ValueError, re.error):
        return None
    return Rule(entry["id"], tuple(map(str, entry["langs"])), tuple(given), entry["methods"], str(entry.get("kind", "route")), tuple(prefixes), entry.get("verbFrom"), bool(entry.get("mountRoot")), bool(entry.get("implicit")))


def route_of(entry: object) -> P.FileRoute | None:
    if not (isinstance(entry, dict) and isinstance(entry.get("re"), str) and entry.get("verbs") in ("exports", "suffix")):
        return None
    try:
        one = re.compile(entry["re"]).groups == 1
    except re.error:
        return None
    return P.FileRoute(str(entry.get("id", entry["re"])), entry["re"], entry["verbs"] == "exports", str(entry.get("pathPrefix", "")), str(entry.get("kind", "route"))) if one else None


def rules_of(text: str | None) -> tuple[list[Rule], list[P.FileRoute], str]:
    """(rules, file routes, digest) of the defaults and a JSON text {"rules": [...], "fileRoutes": [...]}.

    Entries that are not well formed are left out; the digest is of the defaults and the text, so either's change shows.
    """
    defaults = json.dumps([[list(map(str, vars(r).values())) for r in RULES], [list(map(str, vars(r).values())) for r in P.FILE_ROUTES]])
    digest = hashlib.sha1((defaults + (text or "")).encode()).hexdigest()
    try:
        given = json.loads(text) if text else {}
    except ValueError:
        given = {}
    listed = lambda name: given.get(name) if isinstance(given, dict) and isinstance(given.get(name), list) else []
    return [*RULES, *filter(None, map(rule_of, listed("rules")))], [*P.FILE_ROUTES, *filter(None, map(route_of, listed("fileRoutes")))], digest


def user_rules(path: str) -> list[Rule]:
    """Rules of a JSON file beside the defaults; none if it can't be read."""
    try:
        with open(path, encoding="utf-8") as f:
            return rules_of(f.read())[0][len(RULES) :]
    except OSError:
        return []


def _told(found: DataFrame) -> DataFrame:
    """(file, line, rule, verb, route) of found (file, line, rule, rank, method, given, path, prefix, mount): what is a route."""
    raw = P.unquote(F.col("path"))
    joined = F.when(F.coalesce(F.col("prefix"), F.lit("")) != "", P.join_route(F.col("prefix"), raw)).otherwise(raw)
    own = P.verb_in_path(F.when(F.col("mount") & ~joined.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined))
    verb = F.coalesce(F.upper("given"), own["verb"], P.verb(F.col("method")))
    out = found.withColumns({"verb": verb, "route": own["path"]}).where(F.col("route").rlike(L.PATH) | F.col("route").rlike(PLACEHOLDER))
    first = out.withColumn("route", L.normalize(F.col("route"), F.lit("path"))).groupBy("file", "line", "verb", "route").agg(F.min(F.struct("rank", "rule")).alias("best"))
    return first.select("file", "line", F.col("best.rule").alias("rule"), "verb", "route")


def matches(rows: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(file, line, rule, verb, route): anchors in calls or sources, with the prefixes of their files joined on.

    One pass over the calls. A route has to look like a path or be a placeholder, a verb that a hole gives has to be one,
    and the first prefix of a file and rule counts. Of rules that say the same of a line the first one is named.
    """
    rules = RULES if rules is None else rules
    calls = scanned(rows)
    none = F.lit(None).cast("string")
    tried, heads = [], []
    for rank, r in enumerate(rules):
        inside = F.col("lang").isin(*r.langs)
        for text in r.patterns:
            p = structure.Pattern(text)
            given = p.hole(r.verb_from) if r.verb_from else F.lit(None).cast("string")
            right = F.coalesce(given.rlike(VERB), F.lit(False)) if r.verb_from else F.lit(True)
            tried.append(F.when(inside & F.col("callee").rlike(r.methods) & p.matched() & right, F.struct(F.lit(r.id).alias("rule"), F.lit(rank).alias("rank"), F.col("callee").alias("method"), given.alias("given"), p.hole("P").alias("path"), F.lit(r.mount_root).alias("mount"), none.alias("prefix"), F.lit(False).alias("head"))))
        heads += [F.when(inside & structure.Pattern(x).matched(), F.struct(F.lit(r.id).alias("rule"), F.lit(rank).alias("rank"), F.col("callee").alias("method"), none.alias("given"), none.alias("path"), F.lit(r.mount_root).alias("mount"), P.unquote(structure.Pattern(x).hole("P")).alias("prefix"), F.lit(True).alias("head"))) for x in r.prefixes]
    each = calls.select("file", "line", "place", F.explode(F.array_compact(F.array(*tried, *heads))).alias("x")).select("file", "line", "place", "x.*")
    each = each.where(F.col("head") | F.col("path").isNotNull())
    if heads:
        each = each.withColumn("prefix", F.min_by("prefix", F.when(F.col("head"), F.col("place"))).over(Window.partitionBy("file", "rule")))
    return _told(each.where(~F.col("head")))


def discovered(rows: DataFrame, signatures: DataFrame) -> DataFrame:
    """(file, line, rule, verb, route): what the rules of promoted signatures (lang, shape, callee, arg) find in calls or sources.

    A signature's rule takes calls of its language, its way and its name in any case, whose argument ``arg`` is the path and
    may be the last; signatures are joined on, however many there are.
    """
    shape = F.when(F.col("decorated"), "dec").when(F.col("receiver").isNotNull(), "recv").otherwise("bare")
    named = signatures.select("lang", "shape", F.lower("callee").alias("low"), "arg", F.concat_ws(":", F.lit("implicit"), F.lower("lang"), "shape", "callee", F.col("arg").cast("string")).alias("rule"))
    calls = scanned(rows).where("form = 'call'").withColumns({"shape": shape, "low": F.lower("callee")})
    found = calls.join(named, ["lang", "shape", "low"]).where(F.size("args") > F.col("arg"))
    none = F.lit(None).cast("string")
    return _told(found.select("file", "line", "rule", F.lit(0).alias("rank"), F.col("callee").alias("method"), none.alias("given"), F.get("args", F.col("arg"))["text"].alias("path"), none.alias("prefix"), F.lit(False).alias("mount")))


def signed(rows: DataFrame) -> DataFrame:
    """(file, line, rule, verb, route) of quoted arguments (file, line, rule, callee, sig) that promoted signatures make routes."""
    none = F.lit(None).cast("string")
    return _told(rows.select("file", "line", "rule", F.lit(0).alias("rank"), F.col("callee").alias("method"), none.alias("given"), F.col("sig").alias("path"), none.alias("prefix"), F.lit(False).alias("mount")))


def collapse(sites: DataFrame) -> DataFrame:
    """(label, file, line, sites, files, implicit) over (label, file, line, implicit): one anchor at its first site.

    It is implicit only if all its sites are.
    """
    return sites.groupBy("label").agg(F.min(F.struct("line", "file")).alias("first"), F.count("*").alias("sites"), F.count_distinct("file").alias("files"), F.bool_and("implicit").alias("implicit")).select("label", "first.file", "first.line", "sites", "files", "implicit")


def labelled(found: DataFrame, implicit: bool = False) -> DataFrame:
    """(label, file, line, implicit) of matches (file, line, verb, route)."""
    return found.select(F.concat_ws(" ", "verb", "route").alias("label"), "file", "line", F.lit(implicit).alias("implicit"))
