"""Paths, languages, test scope, routes and verbs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders and names that are never sources, the shapes of test files, extensions and verbs.
JUNK_DIRS = [".git", "node_modules", "dist", "vendor", ".venv", "venv", "target", "coverage", ".next", "build", "__pycache__", "deps", "_build", ".tox", "Pods", ".cargo"]
JUNK_NAMES = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock", "bun.lockb", "pipfile.lock", "poetry.lock", "cargo.lock", "composer.lock", "gemfile.lock", "go.sum"]
BINARY = ["beam", "pyc", "o", "obj", "so", "a", "d"]
FAMILIES = {"ts": ["ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"], "py": ["py"], "rs": ["rs"], "go": ["go"]}
TEST_FILE = r"(^|/)(test_|conftest)|\.(test|spec)\.[tj]sx?$|_test\.go$"
TEST_FOLDER = r"(?i)(^|/)(tests?|__tests__|fixtures?)(/|$)"
LANGUAGES = {
    "ts": "TypeScript", "tsx": "Tsx", "mts": "TypeScript", "cts": "TypeScript", "js": "JavaScript", "jsx": "Tsx", "mjs": "JavaScript", "cjs": "JavaScript",
    "py": "Python", "go": "Go", "rs": "Rust", "ex": "Elixir", "exs": "Elixir", "rb": "Ruby", "c": "C", "h": "C", "cc": "C++", "cpp": "C++", "cxx": "C++", "hpp": "C++", "hh": "C++",
    "java": "Java", "kt": "Kotlin", "kts": "Kotlin", "lua": "Lua", "php": "Php", "swift": "Swift", "scala": "Scala", "hs": "Haskell", "sh": "Bash",
}
CONFIG = ["yaml", "yml", "json", "toml", "env", "tf", "hcl", "md"]
VERB_ALIASES = {
    "PATH": "ANY", "RE_PATH": "ANY", "URL": "ANY", "MATCH": "ANY", "ROOT": "ANY", "REQUESTMAPPING": "ANY", "RESOURCES": "ANY", "FORWARD": "ANY",
    "FETCH": "GET", "REDIRECT": "GET", "RESPONDREDIRECT": "GET", "REDIRECT_TO": "GET",
}


def lookup(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    """Language by extension, null where it has none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), extension(path))


def is_junk(path: Column) -> Column:
    parts = F.split(path, "/")
    name = F.lower(F.element_at(parts, -1))
    return F.arrays_overlap(parts, F.array(*map(F.lit, JUNK_DIRS))) | name.isin(JUNK_NAMES) | name.endswith(".lock")


def is_supported(path: Column) -> Column:
    """Sources and configurations by extension, and files that are routes by convention; never binary files."""
    ends = extension(path)
    return (~ends.isin(BINARY) & (language(path).isNotNull() | ends.isin(CONFIG))) | F.coalesce(*(F.when(path.rlike(r.pattern), True) for r in FILE_ROUTES), F.lit(False))


def family(path: Column) -> Column:
    """Languages that import from each other by one rule; the extension itself for all others."""
    ends = extension(path)
    return F.coalesce(*(F.when(ends.isin(members), F.lit(name)) for name, members in FAMILIES.items()), ends)


@dataclass(frozen=True)
class FileRoute:
    """A file convention: group 1 is the route's stem; verbs are the handlers exported, or a suffix of the stem."""

    id: str
    pattern: str
    exported: bool
    prefix: str = ""
    kind: str = "route"


# File conventions that are routes, and how handlers are exported.
FILE_ROUTES = [
    FileRoute("next-app-route", r"(?:^|/)app/(.+)/route\.(?:ts|tsx|js|jsx|mjs)$", True),
    FileRoute("next-app-page", r"(?:^|/)app/(?:(.+)/)?page\.(?:tsx|jsx|mdx)$", False, kind="page"),
    FileRoute("next-pages-api", r"(?:^|/)pages/api/(.+)\.(?:ts|tsx|js|jsx)$", False, "/api"),
    FileRoute("sveltekit-server", r"(?:^|/)src/routes/(?:(.+)/)?\+server\.(?:ts|js)$", True),
    FileRoute("sveltekit-page", r"(?:^|/)src/routes/(?:(.+)/)?\+page\.(?:svelte|md)$", False, kind="page"),
    FileRoute("nuxt-server-api", r"(?:^|/)server/api/(.+)\.(?:ts|js|mjs)$", False, "/api"),
    FileRoute("astro-endpoint", r"(?:^|/)src/pages/(.+)\.(?:ts|js|mjs)$", True),
]
EXPORTED = r"\bexport\s+(?:(?:async\s+)?function\s+|const\s+)(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b"
SUFFIX = r"(?i)\.(get|post|put|delete|patch|head|options)$"
# How a route's placeholder is written in a file's name, and a verb before a path; names of generated files.
PLACEHOLDER = r"^@?\[+(?:\.\.\.)?[^\]]+\]+$"
VERB_FIRST = r"^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(/\S*)$"
GENERATED_NAME = r"(?i)\.(?:min|bundle)\.(?:[cm]?js|[cm]?ts|jsx|tsx|mjs|cjs)$"


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST_FILE)


def is_test_scope(path: Column) -> Column:
    return path.rlike(TEST_FILE) | path.rlike(TEST_FOLDER)


def is_generated(path: Column, text: Column, longest: int = 4000) -> Column:
    """Minified or bundled by the end of its name, in any case, or with a line of ``longest`` characters or more."""
    return path.rlike(GENERATED_NAME) | F.exists(F.split(text, "\n"), lambda line: F.length(line) >= longest)


def in_scope(path: Column, scope: str) -> Column:
    """Equal to the scope or below it as a folder; a scope may begin with @ or ./ and end with a slash."""
    scope = scope.removeprefix("@").removeprefix("./").removesuffix("/")
    return (path == scope) | path.startswith(scope + "/")


def top_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), 1)


def folder2(path: Column) -> Column:
    """The first two folders of a path, (root) for a file without one."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n == 1, "(root)").when(n == 2, F.concat(parts[0], F.lit("/"))).otherwise(F.concat(parts[0], F.lit("/"), parts[1], F.lit("/")))


def slashed(path: Column) -> Column:
    """The path with slashes alone."""
    return F.translate(path, "\\", "/")


def resolved_parts(path: Column, absolute: Column) -> Column:
    """Segments without empty ones and ``.``; ``..`` takes the one before away, and stays where a relative path has none."""
    up = lambda acc: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(absolute, acc).otherwise(F.array_append(acc, F.lit("..")))
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", up(acc)).otherwise(F.array_append(acc, s))
    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)


def resolve(path: Column) -> Column:
    """A relative path without empty, . and needless .. segments; what leads out of it stays as leading ``..``."""
    return F.array_join(resolved_parts(path, F.lit(False)), "/")


def resolve_in(root: Column, path: Column) -> Column:
    """The path seen from root, with slashes of either kind, drives and shares; an absolute one is itself."""
    plain = slashed(path)
    whole = F.when(plain.rlike("^(?:/|[A-Za-z]:/)"), plain).otherwise(F.concat(slashed(root), F.lit("/"), plain))
    drive = F.regexp_extract(whole, "^[A-Za-z]:", 0)
    share = (drive == "") & whole.startswith("//")
    absolute = (drive != "") | whole.startswith("/")
    head = F.when(drive != "", F.concat(drive, F.lit("/"))).when(share, F.lit("//")).when(absolute, F.lit("/")).otherwise(F.lit(""))
    body = F.substring(whole, F.length(drive) + 1, F.length(whole))
    return F.concat(head, F.array_join(resolved_parts(body, absolute), "/"))


def join_route(prefix: Column, child: Column) -> Column:
    """Both parts under one leading slash."""
    trimmed = F.filter(F.array(F.regexp_replace(F.coalesce(prefix, F.lit("")), "^/+|/+$", ""), F.regexp_replace(F.coalesce(child, F.lit("")), "^/+|/+$", "")), lambda s: s != "")
    return F.concat(F.lit("/"), F.array_join(trimmed, "/"))


def file_route(path: Column) -> Column:
    """Route of a file by convention: no groups in brackets, no index, [x], [...x], [[...x]] and @[x] as a placeholder."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.rlike(r"^\(.+\)$") & (s != "index"))
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda s: F.when(s.rlike(PLACEHOLDER), F.lit("{*}")).otherwise(s)), "/"))


def git_relative(path: Column, prefix: str) -> Column:
    """A path that git tells, relative to a folder of the checkout; null outside of it."""
    path = slashed(path)
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 20)) if prefix else path


def within(path: Column, root: str) -> Column:
    """The path relative to a root, null if it lies outside or is the root; below drives and shares in any case."""
    base = resolve_in(F.lit(root), F.lit("."))
    whole = resolve_in(F.lit(root), path)
    plain = lambda c: F.when(base.rlike("^(?:[A-Za-z]:/|//)"), F.lower(c)).otherwise(c)
    below = F.when(base.endswith("/"), base).otherwise(F.concat(base, F.lit("/")))
    inner = F.regexp_replace(F.substring(whole, F.length(base) + 1, F.length(whole)), "^/+", "")
    return F.when(plain(whole).startswith(plain(below)), F.nullif(inner, F.lit("")))


def unquote(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(text), "^[rRbBuUfF]{0,2}(?=[\"'`])", ""), "^[\"'`]+|[\"'`]+$", "")


def verb(method: Column) -> Column:
    """HTTP verb of a method's name: upper case, without MAPPING, by alias."""
    v = F.regexp_replace(F.upper(method), "MAPPING$", "")
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in VERB_ALIASES.items() for x in kv)), v), v)


def verb_in_path(text: Column) -> Column:
    """(verb, path) of a text such as "GET /x"; verb is null without one."""
    v = F.regexp_extract(text, VERB_FIRST, 1)
    return F.struct(F.nullif(v, F.lit("")).alias("verb"), F.when(v == "", text).otherwise(F.regexp_extract(text, r"^\S+\s+(/.*)$", 1)).alias("path"))
