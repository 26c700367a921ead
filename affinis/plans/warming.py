"""Fields of changes, kept by the version of the graph and by what changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.keeping import exists, kept, paths
from affinis.operators import heat


def keys(seeds: DataFrame) -> DataFrame:
    """(change, key) of seeds (change, node, mass): a digest of the nodes and their masses, whatever the change is called."""
    each = seeds.groupBy("change", "node").agg(F.sum("mass").cast("double").alias("mass"))
    said = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", F.col("node").cast("string"), F.col("mass").cast("string")))), "\n")
    return each.groupBy("change").agg(F.sha1(said.cast("binary")).alias("key"))


class Warming:
    """A table (node, heat) under a folder, partitioned by version and by the key of the seeds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, version: str, key: str) -> DataFrame | None:
        at = f"{self.path}/{version}"
        if not exists(self.spark, f"{at}/key={key}"):
            return None
        return self.spark.read.parquet(at).where(F.col("key") == key).select("node", "heat")

    def field(self, version: str, seeds: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
        """(node, heat) of seeds (node, mass): what is kept for them, else what ``make`` gives, which is kept then."""
        key = keys(seeds.withColumn("change", F.lit(""))).first()
        if key is None:
            return make()
        known = self._read(version, key["key"])
        if known is None:
            make().select("node", "heat", F.lit(key["key"]).alias("key")).write.mode("append").partitionBy("key").parquet(f"{self.path}/{version}")
            known = self._read(version, key["key"])
        return known

    def fill(self, version: str, both: DataFrame, seeds: DataFrame, t: float) -> int:
        """Keeps the fields at time t of many changes' seeds (change, node, mass), those that are not kept yet, made at once."""
        self.forget(version)
        named = kept(keys(seeds))
        have = self.spark.read.parquet(f"{self.path}/{version}").select("key").distinct() if exists(self.spark, f"{self.path}/{version}") else None
        new = named if have is None else named.join(have, "key", "left_anti")
        new = kept(new.groupBy("key").agg(F.min("change").alias("change")))
        n = new.count()
        if n:
            made = heat.fields(both, seeds.join(new, "change").select(F.col("key").alias("change"), "node", "mass"), t)
            made.select("node", "heat", F.col("change").alias("key")).write.mode("append").partitionBy("key").parquet(f"{self.path}/{version}")
        return n

    def forget(self, version: str) -> None:
        """Removes the fields of other versions."""
        fs, at = paths(self.spark, self.path)
        if fs.exists(at):
            for s in fs.listStatus(at):
                if s.getPath().getName() != version:
                    fs.delete(s.getPath(), True)
