"""References resolved to what they mean: by position, by tiers of nearness, and by unique path suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def enclosing(sites: DataFrame, symbols: DataFrame, last: bool = True) -> DataFrame:
    """As-of join: each site (file, line, site) with the symbol (file, line, symbol) last begun before it, or null.

    Both sides are one stream sorted by line within a file, so nothing is paired. Among symbols on one line the last
    in order of symbol wins, or the first if not ``last``.
    """
    pick = F.max("symbol") if last else F.min("symbol")
    begun = symbols.groupBy("file", "line").agg(pick.alias("symbol")).select("file", "line", F.lit(0).alias("order"), F.lit(None).cast(sites.schema["site"].dataType).alias("site"), "symbol")
    asked = sites.select("file", "line", F.lit(1).alias("order"), "site", F.lit(None).cast(symbols.schema["symbol"].dataType).alias("symbol"))
    order = Window.partitionBy("file").orderBy("line", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = begun.unionByName(asked).withColumn("found", F.last("symbol", ignorenulls=True).over(order))
    return both.where("order = 1").select("file", "line", "site", F.col("found").alias("symbol"))


def tiered(calls: DataFrame, names: DataFrame, tiers: list[str], most: int = 48, chosen: int = 3) -> DataFrame:
    """Calls (call, key, ...) to candidates (key, target, ...): those of the nearest tier that has any.

    ``tiers`` are conditions over both sides' columns, nearest first; a candidate that meets none is not near. A key
    with more than ``most`` candidates resolves nothing, nor does a tier with more than ``chosen``. The weight falls
    with the number of candidates. The bound on candidates comes before the join.
    """
    few = names.groupBy("key").agg(F.count("*").alias("candidates")).where(F.col("candidates") <= most)
    found = calls.join(names.join(few, "key"), "key")
    tier = F.coalesce(*(F.when(F.expr(c), F.lit(k)) for k, c in enumerate(tiers)))
    found = found.withColumn("tier", tier).where("tier is not null")
    call = Window.partitionBy("call")
    found = found.withColumn("nearest", F.min("tier").over(call)).where("tier = nearest").withColumn("chosen", F.count("*").over(call)).where(F.col("chosen") <= chosen)
    weight = F.when(F.col("candidates") <= 8, 0.7).when(F.col("candidates") <= 24, 0.45).otherwise(0.25)
    return found.select("call", "target", "tier", "candidates", weight.alias("w"))


def suffixes(files: DataFrame, most: int = 3) -> DataFrame:
    """(suffix, file): the last 1 to ``most`` segments of each path (file)."""
    parts = F.split("file", "/")
    each = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most))), lambda k: F.array_join(F.slice(parts, -k, k), "/"))
    return files.select("file", F.explode(each).alias("suffix"))


def by_suffix(imports: DataFrame, files: DataFrame, endings: list[str], most: int = 3) -> DataFrame:
    """Imports (site, spec) to the file that alone ends in the spec with one of ``endings``, the first ending that has one."""
    tails = suffixes(files, most).groupBy("suffix").agg(F.count("*").alias("n"), F.min("file").alias("target")).where("n = 1").drop("n")
    tries = imports.select("site", "spec", F.posexplode(F.array(*(F.concat("spec", F.lit(e)) for e in endings))).alias("priority", "suffix"))
    return tries.join(tails, "suffix").groupBy("site", "spec").agg(F.min(F.struct("priority", "target")).alias("best")).select("site", "spec", "best.target")


def relative(imports: DataFrame, files: DataFrame, endings: list[str]) -> DataFrame:
    """Imports (site, file, spec) relative to the importing file: ./ and ../ resolved, endings tried in order."""
    from affinis.functions import paths as P

    folder = F.regexp_replace("file", "[^/]*$", "")
    base = F.regexp_replace(P.resolve(F.concat(folder, F.col("spec"))), r"\.[cm]?jsx?$", "")
    tries = imports.where(F.col("spec").startswith(".")).select("site", "spec", F.posexplode(F.array(*(F.concat(base, F.lit(e)) for e in endings))).alias("priority", "path"))
    found = tries.join(files.select(F.col("file").alias("path")).distinct(), "path")
    return found.groupBy("site", "spec").agg(F.min(F.struct("priority", "path")).alias("best")).select("site", "spec", F.col("best.path").alias("target"))
