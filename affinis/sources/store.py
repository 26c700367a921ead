"""Facts of files that last between jobs: immutable runs, and a manifest that says which run holds what of each file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.keeping import kept, paths

FACTS = "file string, fact string, line int, name string, kind string, sig string"
MANIFEST = "file string, size long, version string, sha string, lang string, status string, run int, rules string, rules_run int"
#: Facts that follow from the rules too, and so are made anew when those move.
BY_RULE = ("anchor", "route")
#: Runs beyond which a refresh merges them.
MOST_RUNS = 8


@dataclass
class Refreshed:
    """What a refresh did: (file, change), where change is added, extracted, touched, anchored or deleted.

    A file that was read and had to be extracted is added or extracted; touched ones were read, but their contents were
    known; anchored ones were read for their rules alone. What is not named was not read.
    """

    number: int
    changes: DataFrame


class FactStore:
    """A log-structured table of facts under a folder, which any later session opens again.

    Each refresh leaves one run of facts, of the files that it had to read, and a new manifest; a manifest counts from
    when it is whole, so a refresh that dies leaves the one before in force, and its run is written over. Files are told
    apart by size and version first; only those that differ are read, and only those whose digest differs are extracted.
    A file of which a part could not be extracted is not tried again before its digest changes; what was found counts.
    """

    def __init__(self, spark: SparkSession, path: str, most_runs: int = MOST_RUNS):
        self.spark, self.path, self.most_runs = spark, path.rstrip("/"), most_runs

    def _numbers(self) -> list[int]:
        fs, at = paths(self.spark, self.path)
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[9:]) for n in names if n.startswith("manifest-") and fs.exists(paths(self.spark, f"{self.path}/{n}/_SUCCESS")[1]))

    def manifest(self) -> DataFrame:
        """The last whole manifest; without rows where there is none."""
        numbers = self._numbers()
        if not numbers:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest-{numbers[-1]:06d}")

    def facts(self, manifest: DataFrame | None = None) -> DataFrame:
        """The facts in force, of FACTS: of each file those of the runs that the manifest names."""
        manifest = self.manifest() if manifest is None else manifest
        own = manifest.select("file", F.explode(F.array(F.struct(F.lit(False).alias("by_rule"), F.col("run").alias("run")), F.struct(F.lit(True).alias("by_rule"), F.col("rules_run").alias("run")))).alias("x")).select("file", "x.*").where("run is not null")
        runs = [r["run"] for r in own.select("run").distinct().collect()]
        if not runs:
            return self.spark.createDataFrame([], FACTS)
        rows = self.spark.read.schema(FACTS + ", run int").parquet(*(f"{self.path}/run-{r:06d}" for r in sorted(runs)))
        rows = rows.withColumn("by_rule", F.col("fact").isin(*BY_RULE))
        return rows.where("fact <> 'failed'").join(own, ["file", "by_rule", "run"], "left_semi").drop("run", "by_rule")

    def report(self) -> DataFrame:
        """(file, status) of what has no facts or not all: oversized, unreadable, generated or failed."""
        return self.manifest().where("status <> 'ok'").select("file", "status")

    def refresh(self, seen: DataFrame, read: Callable[[DataFrame], DataFrame], extract: Callable[[DataFrame], DataFrame], anchor: Callable[[DataFrame], DataFrame], rules: str = "", largest: int = 1 << 62) -> Refreshed:
        """Brings the facts up to what is there: seen (file, size, version, ...).

        read gives (file, sha, lang, text, generated) of rows of seen, extract and anchor the facts of (file, lang, text)
        that follow from contents, and from contents and rules, whose digest is ``rules``. A row of the fact ``failed``
        says that a file could not be extracted whole.
        """
        numbers = self._numbers()
        number = (numbers[-1] if numbers else 0) + 1
        old = self.manifest()
        was = old.select("file", *(F.col(c).alias(f"old_{c}") for c in ("size", "version", "sha", "lang", "status", "run", "rules", "rules_run")))
        both = kept(seen.join(was, "file", "left").withColumn("known", F.col("old_sha").isNotNull() & F.col("old_status").isin("ok", "generated", "failed")))
        large = F.col("size") > largest
        alike = F.col("known") & (F.col("size") == F.col("old_size")) & (F.col("version") == F.col("old_version"))
        asked = both.where(~large & ~alike)
        got = kept(asked.join(read(asked.select(*seen.columns)), "file", "left"))
        same = F.col("known") & (F.col("sha") == F.col("old_sha"))
        dirty = got.where(F.col("sha").isNotNull() & ~same)
        clean = kept(both.where(~large & alike).select("file", "size", "version", *(F.col(f"old_{c}").alias(c) for c in ("sha", "lang", "status", "run", "rules", "rules_run")), F.lit(False).alias("touched")).unionByName(
            got.where(same).select("file", "size", "version", *(F.col(f"old_{c}").alias(c) for c in ("sha", "lang", "status", "run", "rules", "rules_run")), F.lit(True).alias("touched"))
        ))
        moved = clean.where(F.col("run").isNotNull() & (F.col("rules") != rules)).select("file")
        fresh = dirty.where(~F.col("generated")).select("file", "lang", "text")
        again = read(seen.join(moved, "file", "left_semi")).where("text is not null").select("file", "lang", "text")
        found = self.spark.createDataFrame([], FACTS)
        for rows, makers in ((fresh, (extract, anchor)), (again, (anchor,))):
            if rows is not again and not rows.isEmpty() or rows is again and not moved.isEmpty():
                for make in makers:
                    found = found.unionByName(make(rows))
        found.select("file", "fact", "line", "name", "kind", "sig", F.lit(number).alias("run")).write.mode("overwrite").parquet(f"{self.path}/run-{number:06d}")
        run = self.spark.read.schema(FACTS + ", run int").parquet(f"{self.path}/run-{number:06d}")
        failed = run.where("fact = 'failed'").select("file", F.lit(True).alias("bad")).distinct()
        status = F.when(F.col("generated"), "generated").when(F.coalesce("bad", F.lit(False)), "failed").otherwise("ok")
        made = F.when(~F.col("generated"), F.lit(number))
        now = dirty.join(failed, "file", "left").select("file", "size", "version", "sha", "lang", status.alias("status"), made.alias("run"), F.lit(rules).alias("rules"), made.alias("rules_run"))
        anchored = clean.join(moved.withColumn("moved", F.lit(True)), "file", "left")
        held = anchored.select("file", "size", "version", "sha", "lang", "status", "run", F.lit(rules).alias("rules"), F.when(F.col("moved"), F.lit(number)).otherwise(F.col("rules_run")).alias("rules_run"))
        none = lambda kind: F.lit(None).cast(kind)
        left = both.where(large).select("file", "size", "version", none("string").alias("sha"), none("string").alias("lang"), F.lit("oversized").alias("status"), none("int").alias("run"), F.lit(rules).alias("rules"), none("int").alias("rules_run"))
        left = left.unionByName(got.where("sha is null").select("file", "size", "version", none("string").alias("sha"), none("string").alias("lang"), F.lit("unreadable").alias("status"), none("int").alias("run"), F.lit(rules).alias("rules"), none("int").alias("rules_run")))
        manifest = kept(now.unionByName(held).unionByName(left))
        deleted = kept(old.join(seen.select("file"), "file", "left_anti").select("file", F.lit("deleted").alias("change")))
        changes = dirty.select("file", F.when(F.col("known"), "extracted").otherwise("added").alias("change")).unionByName(deleted)
        changes = changes.unionByName(anchored.where("touched or moved").select("file", F.when(F.col("moved"), "anchored").otherwise("touched").alias("change")))
        changes = kept(changes)
        if manifest.select(F.explode(F.array("run", "rules_run")).alias("run")).where("run is not null").distinct().count() > self.most_runs:
            manifest = self._merged(manifest, number)
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifest-{number:06d}")
        self._forget(numbers[:-1])
        return Refreshed(number, changes)

    def _merged(self, manifest: DataFrame, number: int) -> DataFrame:
        """All facts in force as one run, which takes the place of this refresh's own."""
        rows = kept(self.facts(manifest).withColumn("run", F.lit(number)))
        rows.write.mode("overwrite").parquet(f"{self.path}/run-{number:06d}")
        one = lambda c: F.when(F.col(c).isNotNull(), F.lit(number)).alias(c)
        return manifest.select("file", "size", "version", "sha", "lang", "status", one("run"), "rules", one("rules_run"))

    def _forget(self, numbers: list[int]) -> None:
        """Removes manifests before the last two, and runs that neither of those names."""
        fs, at = paths(self.spark, self.path)
        for n in numbers:
            fs.delete(paths(self.spark, f"{self.path}/manifest-{n:06d}")[1], True)
        named = {n for n in self._numbers()}
        for n in self._numbers():
            named |= {r["run"] for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest-{n:06d}").select(F.explode(F.array("run", "rules_run")).alias("run")).distinct().collect()}
        for s in fs.listStatus(at):
            name = s.getPath().getName()
            if name.startswith("run-") and int(name[4:]) not in named:
                fs.delete(s.getPath(), True)
