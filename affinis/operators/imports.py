"""Imports resolved to files, by the rule of each family of languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.functions import paths as P
from affinis.keeping import tasks_for

#: Endings that a relative import may leave out, in order, and folders that a Go path may end in.
ENDINGS = {"ts": [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"], "py": [".py"], "rs": [".rs"], "go": []}
GO_FOLDERS = 3
#: More than a path has ranks among the endings of its family.
PLACE = 50


def folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def tail(path: Column, k: Column | int) -> Column:
    """The last k segments of a path."""
    return F.substring_index(path, "/", -k) if isinstance(k, int) else F.array_join(F.slice(F.split(path, "/"), -k, k), "/")


def exact_keys(imports: DataFrame) -> DataFrame:
    """(site, place, key): the keys of ``path_keys`` that an import may name outright, the likeliest first; two at most."""
    near = F.col("spec").rlike(r"^\.\.?/")
    base = F.regexp_replace(P.resolve(F.concat(folder(F.col("file")), F.lit("/"), F.col("spec"))), r"\.(?:[cm]?js|jsx)$", "")
    imports = imports.select("site", "family", "spec", near.alias("near"), F.when(near, base).alias("base"))
    path = lambda *parts: F.concat(F.lit("=:"), *parts)
    dotted, module = F.regexp_replace("spec", r"\.", "/"), F.regexp_replace(F.regexp_replace("spec", "^crate::|^self::", ""), "::", "/")
    named = (
        F.when(F.col("family") == "py", F.array(path(dotted, F.lit(".py")), path(dotted, F.lit("/__init__.py"))))
        .when(F.col("family") == "rs", F.array(path(F.lit("src/"), module, F.lit(".rs")), path(module, F.lit(".rs"))))
        .otherwise(F.array().cast("array<string>"))
    )
    relative = F.array(F.concat("family", F.lit(":"), "base"), path("base"))
    return imports.select("site", F.posexplode(F.when(F.col("near"), relative).otherwise(named)).alias("place", "key")).where("key IS NOT NULL")


def path_keys(files: DataFrame) -> DataFrame:
    """(key, rank, target): each file by its path, and for its family without its ending, or without its index and ending.

    The endings are taken from the files: added to the imports, they would make seventeen paths of every TypeScript one.
    """
    short = lambda ending: F.left("file", F.length("file") - len(ending))
    keys = [F.struct(F.concat(F.lit("=:"), "file").alias("key"), F.lit(0).alias("rank"))]
    for family, endings in ENDINGS.items():
        for k, ending in enumerate(x for e in endings for x in (e, "/index" + e)):
            keys.append(F.when(F.endswith("file", F.lit(ending)), F.struct(F.concat(F.lit(family + ":"), short(ending)).alias("key"), F.lit(k).alias("rank"))))
    return files.select(F.col("file").alias("target"), F.explode(F.array_compact(F.array(*keys))).alias("x")).select("x.key", "x.rank", "target")


def go_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(site, priority, target): the first file of the only folder that ends as the import does, by fewest segments."""
    folders = files.groupBy(folder(F.col("file")).alias("folder")).agg(F.min("file").alias("target")).where("folder <> '.'")
    ends = folders.select("folder", "target", F.explode(F.sequence(F.lit(1), F.least(F.size(F.split("folder", "/")), F.lit(GO_FOLDERS)))).alias("k"))
    only = ends.groupBy(tail(F.col("folder"), F.col("k")).alias("suffix"), "k").agg(F.count("*").alias("n"), F.min("target").alias("target")).where("n = 1")
    parts = F.filter(F.split("spec", "/"), lambda s: s != "")
    asked = imports.where((F.col("family") == "go") & (F.size(parts) > 0) & ~F.col("spec").rlike(r"^\.\.?/")).select("site", parts.alias("parts"))
    asked = asked.select("site", "parts", F.explode(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(GO_FOLDERS)))).alias("k")).select("site", "k", F.array_join(F.slice("parts", -F.col("k"), F.col("k")), "/").alias("suffix"))
    return asked.join(only.hint("merge"), ["suffix", "k"]).select("site", F.col("k").alias("priority"), "target")


def only_tails(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(site, priority, target): Rust modules by name, and bare imports of other languages by the end of a path.

    A name that several files could have resolves nothing.
    """
    stem = F.regexp_replace("file", r"\.\w+$", "")
    rust = files.where(F.col("file").endswith(".rs")).select("file", F.explode(F.array_distinct(F.array(tail(stem, 1), F.when(F.col("file").endswith("/mod.rs"), tail(folder(F.col("file")), 1)).otherwise(tail(stem, 1))))).alias("key"))
    rust = rust.where(F.col("file").endswith(F.concat(F.col("key"), F.lit(".rs"))) | F.col("file").endswith(F.concat(F.lit("/"), "key", F.lit("/mod.rs")))).select(F.concat(F.lit("rs:"), "key").alias("key"), "file")
    whole = F.when(F.col("file").endswith("/index.ts"), F.regexp_replace("file", r"/index\.ts$", "")).otherwise(F.regexp_replace("file", r"\.ts$", ""))
    script = files.where(F.col("file").endswith(".ts")).select("file", F.split(whole, "/").alias("parts"), F.col("file").endswith("/index.ts").alias("index"))
    script = script.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("parts", -k, k), "/").alias("tail")))).alias("x"), F.size("parts").alias("n"))
    script = script.where("x.k < n").select(F.concat(F.lit("ts:"), "x.tail").alias("key"), "file")
    keys = rust.unionByName(script).groupBy("key").agg(F.min("file").alias("target"), F.max("file").alias("last")).where("target = last").select("key", "target")
    module = F.regexp_replace(F.regexp_replace("spec", "^crate::|^self::", ""), "::", "/")
    bare = F.array_join(F.filter(F.split("spec", "/"), lambda s: s != ""), "/")
    asked = imports.where(~F.col("spec").rlike(r"^\.\.?/") & ~F.col("family").isin("py", "go"))
    asked = asked.select("site", F.when(F.col("family") == "rs", F.concat(F.lit("rs:"), F.substring_index(module, "/", -1))).otherwise(F.concat(F.lit("ts:"), bare)).alias("key"))
    return asked.join(keys.hint("merge"), "key").select("site", F.lit(100).alias("priority"), "target")


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(site, file, target) of imports (site, file, spec) that name another of the files (file), each at most once.

    ``./`` and ``../`` are relative to the importing file, tried with each ending of its family and its index; Python
    names are dotted paths; Go paths end as exactly one folder does, the shortest end first; Rust modules are files of
    ``src`` or have a name that one file alone has; any other name is the end of one TypeScript file's path alone.

    Joins are merges: imports and paths are made by exploding, which Spark's estimates of size do not see, so left to
    itself it sends whole tables through the driver.
    """
    tasks = tasks_for(imports, 100_000)
    imports = imports.select("site", "file", "spec", P.family(F.col("file")).alias("family"))
    files = files.select("file").distinct()
    found = exact_keys(imports).repartition(tasks, "key").join(path_keys(files).hint("merge"), "key").select("site", (F.col("place") * PLACE + F.col("rank")).alias("priority"), "target")
    found = found.unionByName(go_targets(imports, files)).unionByName(only_tails(imports, files))
    best = found.groupBy("site").agg(F.min_by("target", F.struct("priority", "target")).alias("target"))
    return imports.join(best.hint("merge"), "site").where("file <> target").select("site", "file", "target")
