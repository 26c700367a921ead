"""Call signatures that carry paths often enough to become rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.functions.scores import posterior

#: Sites, files and rate that a promotion needs.
SITES, FILES, RATE = 4, 2, 0.55


def histogram(sites: DataFrame) -> DataFrame:
    """(key, n, path_n, files, rate) over sites (key, file, is_path); rate is the posterior of path_n in n.

    Sites that have their lang, shape, callee and arg keep them.
    """
    told = [c for c in ("lang", "shape", "callee", "arg") if c in sites.columns]
    out = sites.groupBy("key", *told).agg(F.count("*").alias("n"), F.sum(F.col("is_path").cast("long")).alias("path_n"), F.count_distinct("file").alias("files"))
    return out.withColumn("rate", posterior(F.col("path_n"), F.col("n")))


def promoted(histograms: DataFrame, covered: DataFrame | None = None, rate: float = RATE) -> DataFrame:
    """Signatures with enough sites, files and rate, but those that rules cover (key) already."""
    out = histograms.where((F.col("n") >= SITES) & (F.col("files") >= FILES) & (F.col("rate") >= rate))
    return out.join(covered.select("key").distinct(), "key", "left_anti") if covered is not None else out


def synthesized(signatures: DataFrame) -> DataFrame:
    """(id, patterns, methods) of promoted signatures (lang, shape, callee, arg): the proven slot is $P, others are holes."""
    slots = F.transform(F.sequence(F.lit(0), F.col("arg")), lambda i: F.when(i == F.col("arg"), F.lit("$P")).otherwise(F.concat(F.lit("$X"), i.cast("string"))))
    head = F.when(F.col("shape") == "recv", "$R.$M(").when(F.col("shape") == "bare", "$M(").otherwise("@$M(")
    inner = F.array_join(slots, ", ")
    quoted = F.regexp_replace("callee", r"([.*+?^${}()|\[\]\\])", r"\\$1")
    name = F.concat_ws(":", F.lit("implicit"), F.lower("lang"), "shape", "callee", F.col("arg").cast("string"))
    return signatures.select(name.alias("id"), F.array(F.concat(head, inner, F.lit(")")), F.concat(head, inner, F.lit(", $$$H)"))).alias("patterns"), F.concat(F.lit("^(?i:"), quoted, F.lit(")$")).alias("methods"))
