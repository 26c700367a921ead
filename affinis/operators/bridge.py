"""Bridges between items that share rare literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.functions import literals as L


def keyed(sites: DataFrame) -> DataFrame:
    """Sites (file, node, line, text) that hold a literal, with kind and key."""
    kind = L.classify(F.col("text"))
    return sites.withColumn("kind", kind).where("kind is not null").withColumn("key", L.normalize(F.col("text"), F.col("kind")))


def document_frequency(keys: DataFrame) -> DataFrame:
    """(key, kind, df, spec): distinct files of each key and its specificity among all (key, file) pairs."""
    df = keys.groupBy("key").agg(F.min("kind").alias("kind"), F.count_distinct("file").cast("long").alias("df"))
    total = df.agg(F.sum("df").alias("total"))
    return df.crossJoin(F.broadcast(total)).withColumn("spec", L.specificity(F.col("total"), F.col("df"))).drop("total")


def bridges(sites: DataFrame, most: int = L.MOST_FILES) -> DataFrame:
    """(a, b, w): undirected edges between nodes that share a key found in 2 to ``most`` files, the strongest of each pair.

    The limit comes before the self-join, so no key makes more than ``most`` squared pairs. A key counts once in a file,
    at its first site.
    """
    keys = keyed(sites)
    stats = document_frequency(keys).where((F.col("df") >= 2) & (F.col("df") <= most))
    once = keys.groupBy("key", "file").agg(F.min(F.struct("line", "node")).alias("s")).select("key", "file", F.col("s.node").alias("node"))
    once = once.join(stats.select("key", L.bridge_weight(F.col("kind"), F.col("spec"), F.col("df")).alias("w")), "key")
    a, b = once.alias("a"), once.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.file") < F.col("b.file"))).where("a.node <> b.node")
    return pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"), F.col("a.w").alias("w")).groupBy("a", "b").agg(F.max("w").alias("w"))


def index(sites: DataFrame, most: int = L.MOST_OCCURRENCES) -> DataFrame:
    """(key, kind, df, spec, occ): the literal index, with the first ``most`` occurrences of each key in order of file and line."""
    keys = keyed(sites)
    rank = F.row_number().over(Window.partitionBy("key").orderBy("file", "line", "node"))
    numbered = keys.withColumn("rank", rank).where(F.col("rank") <= most).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("file", "line", "node"))).alias("occ"))
    return document_frequency(keys).join(numbered, "key")
