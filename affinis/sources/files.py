"""Source trees as tables: manifest, contents, facts that patterns find, and history."""

from __future__ import annotations

import ast
import os
import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions import literals as L
from affinis.functions import paths as P

#: Bytes of the largest file that is read, files of a tree, commits of history.
LARGEST, FILES, COMMITS, DEPTH = 1 << 20, 8000, 400, 4
KEYWORDS = ["if", "for", "while", "switch", "return", "catch", "function", "func", "typeof", "sizeof", "match", "when", "with", "await", "elif", "print", "assert"]
QUOTED = "\"([^\"\\n]{2,200})\"|'([^'\\n]{2,200})'"
TEMPLATE = "`([^`\\n]{2,200})`"
BARE = r"(?:^|[:=\s])(/[\w.~+\-{}*]+(?:/[\w.~+\-{}*]+)+|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)(?=$|[:=\s])"


def relative_to(root: str):
    """The column path of a reader, relative to root."""
    return F.regexp_replace(F.col("path"), "^.*" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in root.rstrip("/")) + "/", "")


def manifest(spark: SparkSession, root: str, most: int = FILES, listed: DataFrame | None = None, closed: DataFrame | None = None) -> DataFrame:
    """(file, path, size, version) of supported files below root that are no junk, the first ``most`` by name; nothing is read.

    With ``listed`` (file), such as ``tracked``, only those; nothing below a folder of ``closed`` (folder).
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    rows = rows.select(relative_to(root).alias("file"), "path", F.col("length").alias("size"), F.col("modificationTime").cast("string").alias("version"))
    rows = rows.where(P.is_supported(F.col("file")) & ~P.is_junk(F.col("file")))
    if listed is not None:
        rows = rows.join(listed.select("file").distinct(), "file", "left_semi")
    if closed is not None:
        rows = outside(rows, closed)
    return rows.orderBy("file").limit(most)


def outside(rows: DataFrame, closed: DataFrame) -> DataFrame:
    """Rows (file, ...) that no folder of ``closed`` (folder) holds: each path is looked up by all folders above it."""
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    inside = rows.select("file", F.explode(above).alias("folder")).join(closed.select("folder").distinct(), "folder").select("file").distinct()
    return rows.join(inside, "file", "left_anti")


def contents(spark: SparkSession, root: str, largest: int = LARGEST, most: int = FILES, listed: DataFrame | None = None, closed: DataFrame | None = None) -> DataFrame:
    """(file, size, sha, text, lang, status) of the files; status is ok, oversized or generated, and only ok has a text.

    Oversized files are listed, not read: the reader itself leaves them out by their length.
    """
    seen = manifest(spark, root, most, listed, closed)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= largest).select("path", "content")
    rows = seen.join(read, "path", "left")
    text = F.decode("content", "UTF-8")
    status = F.when(F.col("size") > largest, "oversized").when(P.is_generated(F.col("file"), text), "generated").otherwise("ok")
    rows = rows.select("file", "size", F.sha1("content").alias("sha"), text.alias("text"), P.language(F.col("file")).alias("lang"), status.alias("status"))
    return rows.withColumn("text", F.when(F.col("status") == "ok", F.col("text")))


def read(spark: SparkSession, asked: DataFrame) -> DataFrame:
    """(file, sha, lang, text, generated) of files (file, path); those alone are opened, and a tree has FILES at most."""
    opened = ["".join("\\" + c if c in "\\[]{}*?" else c for c in r["path"]) for r in asked.select("path").limit(FILES).collect()]
    if not opened:
        return spark.createDataFrame([], "file string, sha string, lang string, text string, generated boolean")
    text = F.decode("content", "UTF-8")
    rows = asked.select("file", "path").join(spark.read.format("binaryFile").load(opened).select("path", "content"), "path")
    return rows.select("file", F.sha1("content").alias("sha"), P.language(F.col("file")).alias("lang"), text.alias("text"), P.is_generated(F.col("file"), text).alias("generated"))


def lines(files: DataFrame) -> DataFrame:
    """(file, line, text) of each line, from 1."""
    return files.where("text is not null").select("file", F.posexplode(F.split("text", "\n")).alias("k", "text")).select("file", (F.col("k") + 1).alias("line"), "text")


def config_literals(rows: DataFrame) -> DataFrame:
    """(file, line, text) of quoted strings and bare paths and keys in lines (file, line, text)."""
    each = lambda pattern, k: F.regexp_extract_all("text", F.lit(pattern), k)
    found = F.filter(F.concat(each(QUOTED, 1), each(QUOTED, 2), each(BARE, 1)), lambda x: x != "")
    return rows.select("file", "line", F.explode(F.array_distinct(found)).alias("text"))


def template_literals(rows: DataFrame) -> DataFrame:
    """(file, line, text) of what stands between backticks in lines."""
    return rows.select("file", "line", F.explode(F.regexp_extract_all("text", F.lit(TEMPLATE), 1)).alias("text"))


def _python_symbols(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in parts:
        out: list[tuple] = []
        for file, text in zip(rows["file"], rows["text"], strict=True):
            try:
                tree = ast.parse(text)
            except (SyntaxError, ValueError, RecursionError):
                out.append((file, "failed", 0, None, None, None))
                continue
            head = text.split("\n")

            def visit(node: ast.AST, owner: str, file: str = file, head: list[str] = head) -> None:
                for x in ast.iter_child_nodes(node):
                    if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                        kind = "class" if isinstance(x, ast.ClassDef) else "method" if owner else "function"
                        name = f"{owner}.{x.name}" if owner else x.name
                        out.append((file, "symbol", x.lineno, name, kind, head[x.lineno - 1].strip()[:140]))
                        visit(x, x.name if isinstance(x, ast.ClassDef) else owner)
                        continue
                    if isinstance(x, ast.Import):
                        out.extend((file, "import", x.lineno, a.name, None, None) for a in x.names)
                    elif isinstance(x, ast.ImportFrom):
                        out.append((file, "import", x.lineno, "." * x.level + (x.module or ""), None, None))
                    elif isinstance(x, ast.Call) and isinstance(x.func, ast.Name | ast.Attribute):
                        out.append((file, "call", x.lineno, x.func.id if isinstance(x.func, ast.Name) else x.func.attr, None, None))
                    visit(x, owner)

            visit(tree, "")
        yield pd.DataFrame(out, columns=["file", "fact", "line", "name", "kind", "sig"])


def python_facts(files: DataFrame) -> DataFrame:
    """(file, fact, line, name, kind, sig): symbols, imports and calls of Python sources by the language's own parser.

    A source that it can't read gives one row of the fact ``failed``.
    """
    return files.where("lang = 'Python' and text is not null").select("file", "text").mapInPandas(_python_symbols, "file string, fact string, line int, name string, kind string, sig string")


def clean_sig(line: Column) -> Column:
    """A line as it is shown: at most 140 characters, without the body where there is one."""
    s = F.trim(line)
    brace = F.instr(s, "{")
    s = F.when((F.length(s) > 140) & (brace > 1), F.concat(F.rtrim(F.substring(s, F.lit(1), brace - 1)), F.lit(" { ... }"))).otherwise(s)
    return F.when(F.length(s) > 140, F.concat(F.left(s, F.lit(137)), F.lit("..."))).otherwise(s)


#: How other languages write a definition and an import, one line each; a method's pattern may name its type first.
SYMBOLS = {
    "Go": [(r"^func\s+\(\s*(?:\w+\s+)?\*?([A-Za-z_]\w*)[^)]*\)\s*([A-Za-z_]\w*)", "method"), (r"^func\s+([A-Za-z_]\w*)", "function"), (r"^type\s+([A-Za-z_]\w*)\s+(?:struct|interface)", "type")],
    "TypeScript": [(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)", "function"), (r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)", "class"), (r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)", "interface"), (r"^\s*(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\s*=", "type"), (r"^\s*(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\(", "function")],
    "Rust": [(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)", "function"), (r"^\s*(?:pub\s+)?(?:struct|enum|trait)\s+([A-Za-z_]\w*)", "type")],
    "Java": [(r"^\s*(?:public|private|protected)\s+(?:static\s+)?(?:final\s+)?(?:class|interface|enum)\s+([A-Za-z_]\w*)", "class"), (r"^\s*(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\],? ]+\s+([a-z]\w*)\s*\(", "method")],
    "Ruby": [(r"^\s*def\s+(?:self\.)?([a-z_]\w*[?!]?)", "function"), (r"^\s*class\s+([A-Z]\w*)", "class")],
    "C": [(r"^(?:static\s+|inline\s+|extern\s+)*[A-Za-z_][\w\s*]*?\b([A-Za-z_]\w*)\s*\([^;]*$", "function"), (r"^(?:typedef\s+)?(?:struct|enum|union)\s+([A-Za-z_]\w*)", "type")],
    "Php": [(r"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?([A-Za-z_]\w*)", "function"), (r"^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait)\s+([A-Za-z_]\w*)", "class")],
    "Swift": [(r"^\s*(?:\w+\s+)*func\s+([A-Za-z_]\w*)", "function"), (r"^\s*(?:\w+\s+)*(?:class|struct|enum|protocol|extension)\s+([A-Z]\w*)", "class")],
    "Scala": [(r"^\s*(?:\w+\s+)*def\s+([A-Za-z_]\w*)", "function"), (r"^\s*(?:\w+\s+)*(?:class|object|trait)\s+([A-Z]\w*)", "class")],
    "Lua": [(r"^\s*(?:local\s+)?function\s+([A-Za-z_][\w.:]*)", "function")],
    "Haskell": [(r"^([a-z_][\w']*)\s*::", "function"), (r"^(?:data|newtype|class|type)\s+([A-Z]\w*)", "type")],
    "Bash": [(r"^\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)", "function")],
}
SYMBOLS |= {"C++": [*SYMBOLS["C"], (r"^\s*class\s+([A-Za-z_]\w*)", "class")]}
SYMBOLS |= {"Tsx": SYMBOLS["TypeScript"], "JavaScript": SYMBOLS["TypeScript"], "Kotlin": [(r"^\s*(?:\w+\s+)*fun\s+([A-Za-z_]\w*)", "function"), (r"^\s*(?:\w+\s+)*class\s+([A-Z]\w*)", "class")], "Elixir": [(r"^\s*defp?\s+([a-z_]\w*[?!]?)", "function"), (r"^\s*defmodule\s+([A-Z][\w.]*)", "class")]}
IMPORTS = {"Go": r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$", "TypeScript": r"(?:from|import|require\()\s*['\"]([^'\"]+)['\"]", "Rust": r"^\s*(?:use|mod)\s+([\w:]+)", "Java": r"^\s*import\s+(?:static\s+)?([\w.]+)", "Ruby": r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]"}
IMPORTS |= {"C": r"^\s*#include\s+[\"<]([^\">]+)", "C++": r"^\s*#include\s+[\"<]([^\">]+)", "Php": r"^\s*(?:use|require(?:_once)?|include(?:_once)?)\s*\(?['\"]?([\w./\\\\-]+)", "Swift": r"^\s*import\s+([\w.]+)", "Scala": r"^\s*import\s+([\w.]+)", "Lua": r"require\s*\(?\s*['\"]([^'\"]+)", "Haskell": r"^import\s+(?:qualified\s+)?([A-Z][\w.]*)", "Bash": r"^\s*(?:source|\.)\s+(\S+)"}
IMPORTS |= {"Tsx": IMPORTS["TypeScript"], "JavaScript": IMPORTS["TypeScript"], "Kotlin": IMPORTS["Java"], "Elixir": r"^\s*(?:alias|import|use)\s+([A-Z][\w.]*)"}


def pattern_facts(files: DataFrame) -> DataFrame:
    """(file, fact, line, name, kind, sig) of other languages' definitions and imports, line by line with patterns.

    One pass over the lines: each language's patterns are tried on its own lines alone.
    """
    rows = lines(files).join(files.select("file", "lang"), "file")
    one = lambda pattern, k: F.regexp_extract("text", pattern, k)
    found_name = lambda p: F.when(one(p, 2) != "", F.concat_ws(".", one(p, 1), one(p, 2))).otherwise("") if re.compile(p).groups == 2 else one(p, 1)
    found = F.lit(None).cast("array<struct<fact:string,name:string,kind:string>>")
    for lang, patterns in SYMBOLS.items():
        each = [*(("symbol", p, k) for p, k in patterns), *([("import", IMPORTS[lang], None)] if lang in IMPORTS else [])]
        found = F.when(F.col("lang") == lang, F.array(*(F.struct(F.lit(fact).alias("fact"), found_name(pattern).alias("name"), F.lit(kind).cast("string").alias("kind")) for fact, pattern, kind in each))).otherwise(found)
    rows = rows.where(F.col("lang").isin(*SYMBOLS)).select("file", "line", "text", F.explode(F.filter(found, lambda x: x["name"] != "")).alias("x"))
    return rows.select("file", "x.fact", "line", "x.name", "x.kind", clean_sig(F.col("text")).alias("sig"))


def file_routes(files: DataFrame, routes: list[P.FileRoute] | None = None) -> DataFrame:
    """(file, rule, kind, verb, route) of files (file, text) that are routes by convention; ANY without a verb of their own."""
    found = []
    for r in P.FILE_ROUTES if routes is None else routes:
        stem = F.coalesce(F.regexp_extract("file", r.pattern, 1), F.lit(""))
        suffix = F.upper(F.regexp_extract(stem, P.SUFFIX, 1))
        verbs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(P.EXPORTED), 1) if r.exported else F.when(suffix != "", F.array(suffix)).otherwise(F.array().cast("array<string>"))
        verbs = F.when(F.size(verbs) > 0, F.array_distinct(verbs)).otherwise(F.array(F.lit("ANY")))
        route = L.normalize(F.concat(F.lit(r.prefix), P.file_route(F.regexp_replace(stem, P.SUFFIX, ""))), F.lit("path"))
        found.append(F.when(F.col("file").rlike(r.pattern), F.struct(F.lit(r.id).alias("rule"), F.lit(r.kind).alias("kind"), verbs.alias("verbs"), route.alias("route"))))
    rows = files.select("file", F.explode(F.array_compact(F.array(*found))).alias("x"))
    return rows.select("file", "x.rule", "x.kind", F.explode("x.verbs").alias("verb"), "x.route")


def calls(rows: DataFrame) -> DataFrame:
    """(file, line, callee) of calls in lines (file, line, text) of languages without a parser here."""
    found = F.regexp_extract_all("text", F.lit(r"(?<![\w$])(?:func |function |def |fn |fun |class |new )?([A-Za-z_$][\w$]*)\s*\("), 1)
    defined = F.regexp_extract_all("text", F.lit(r"\b(?:func|function|def|fn|fun|class)\s+([A-Za-z_$][\w$]*)\s*\("), 1)
    return rows.select("file", "line", F.explode(F.array_except(found, defined)).alias("callee")).where(~F.col("callee").isin(KEYWORDS))


def _git(root: str, *args: str) -> str | None:
    said = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
    return said.stdout if said.returncode == 0 else None


def _relative(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    prefix = (_git(root, "rev-parse", "--show-prefix") or "").strip()
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    return rows.select(P.git_relative(F.col("name"), prefix).alias("file")).where("file is not null")


def tracked(spark: SparkSession, root: str, enrolled: tuple[str, ...] = ()) -> DataFrame | None:
    """(file) of what git follows or does not ignore, relative to root; None where root is no checkout.

    Of checkouts within it, those enrolled are listed by their own rules.
    """
    said = _git(root, "ls-files", "-co", "--exclude-standard", "-z")
    if said is None:
        return None
    names = [n for n in said.split("\0") if n]
    for folder in enrolled:
        inner = _git(os.path.join(root, folder), "ls-files", "-co", "--exclude-standard", "-z")
        names += [f"{folder}/{n}" for n in (inner or "").split("\0") if n]
    return spark.createDataFrame([(n,) for n in names], "file string")


def submodules(spark: SparkSession, root: str, depth: int = DEPTH, enrolled: tuple[str, ...] = ()) -> DataFrame:
    """(folder) of checkouts within root, at most ``depth`` deep, that are not enrolled: boundaries for ``manifest``."""
    found = []
    for here, folders, files in os.walk(root):
        level = 0 if here == root else os.path.relpath(here, root).count(os.sep) + 1
        folders[:] = [] if level >= 4 * depth else [f for f in folders if f != ".git" and f not in P.JUNK_DIRS]
        if here != root and (".git" in files or os.path.isdir(os.path.join(here, ".git"))):
            name = os.path.relpath(here, root).replace(os.sep, "/")
            if name not in enrolled:
                found.append((name,))
                folders[:] = []
    return spark.createDataFrame(found, "folder string")


def status(spark: SparkSession, root: str) -> tuple[DataFrame, bool]:
    """((code, file) of what differs from the checkout, whether an odd record asks for listing anew)."""
    said = _git(root, "status", "--porcelain=v1", "-z", "--untracked-files=normal", "--no-renames", "--", ".")
    records = [] if said is None else [x for x in said.split("\0") if x]
    odd = said is None or any(len(x) < 4 or set(x[:2]) - set(" MARCUD?!") for x in records)
    prefix = (_git(root, "rev-parse", "--show-prefix") or "").strip()
    rows = spark.createDataFrame([(x[:2], x[3:]) for x in records if len(x) >= 4], "code string, name string")
    return rows.select("code", P.git_relative(F.col("name"), prefix).alias("file")).where("file is not null"), odd


def uncommitted(spark: SparkSession, root: str) -> DataFrame:
    """(file) that differs from the last commit, or that git does not follow."""
    return status(spark, root)[0].select("file")


def since(spark: SparkSession, root: str, base: str) -> DataFrame:
    """(file) that differs between the common ancestor with ``base`` and the last commit."""
    said = _git(root, "diff", "--name-only", f"{base}...HEAD", "--", ".") or ""
    return _relative(spark, root, [x.strip() for x in said.split("\n") if x.strip()])


def commits(spark: SparkSession, root: str, most: int = COMMITS) -> DataFrame:
    """(commit, ts, item) of the last ``most`` commits of a git checkout; the bound is what reaches the driver."""
    said = subprocess.run(["git", "-C", root, "log", "--numstat", "-n", str(most), "--no-renames", "--diff-filter=AMR", "--format=%x01%H %ct", "--", "."], capture_output=True, text=True, check=True).stdout
    rows, head = [], ("", 0)
    for line in said.split("\n"):
        if line.startswith("\x01"):
            sha, ts = line[1:].split(" ")
            head = (sha, int(ts))
        elif line.count("\t") == 2:
            rows.append((*head, line.split("\t")[2]))
    return spark.createDataFrame(rows, "commit string, epoch long, item string").select("commit", F.timestamp_seconds("epoch").alias("ts"), "item")


def spill(rows: DataFrame, path: str) -> str:
    """Writes a full list (line) that did not fit an output, and returns where."""
    rows.select("line").write.mode("overwrite").text(path)
    return path
