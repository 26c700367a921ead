"""Items that change together, scored and cooled by time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.functions import scores as S
from affinis.keeping import dealt, tasks_for

#: Sizes of commits that say something, joint commits of a pair, and pairs an item keeps.
SMALLEST, LARGEST, SHARED, KEPT = 2, 24, 2, 16


def pairs(commits: DataFrame, largest: int = LARGEST, shared: int = SHARED) -> DataFrame:
    """(a, b, n, w, last_ts) from commits (commit, ts, item): pairs seen together at least ``shared`` times.

    Commits of fewer than 2 or more than ``largest`` distinct items count for nothing; that bound comes before items are
    listed by commit and paired, so a commit makes at most 276 pairs and nothing is joined with itself. Pairs are dealt to
    tasks that grow in number with the commits and counted there, so no task's counts grow.
    """
    tasks = tasks_for(commits)
    items = commits.where("item is not null").groupBy("commit", "item").agg(F.max("ts").alias("ts"))
    sized = items.withColumn("size", F.count("*").over(Window.partitionBy("commit"))).where(F.col("size").between(SMALLEST, largest))
    members = sized.groupBy("commit").agg(F.sort_array(F.collect_list(F.struct("item", "ts"))).alias("m"))
    solo = members.select(F.explode("m.item").alias("item")).groupBy("item").agg(F.count("*").alias("solo"))
    after = lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x["item"].alias("a"), y["item"].alias("b"), F.greatest(x["ts"], y["ts"]).alias("ts")))
    both = dealt(members.select(F.explode(F.flatten(F.transform("m", after))).alias("p")).select("p.*"), "a", "b", tasks=2 * tasks)
    both = both.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).where(F.col("n") >= shared)
    scored = both.join(solo.select(F.col("item").alias("a"), F.col("solo").alias("sa")), "a").join(solo.select(F.col("item").alias("b"), F.col("solo").alias("sb")), "b")
    return scored.withColumn("w", S.pair_score(F.col("n"), F.col("sa"), F.col("sb"))).where("w > 0").select("a", "b", "n", "w", "last_ts")


def age_days(last_ts: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(last_ts.cast("timestamp"))) / 86_400_000_000)


def effective(w: Column, last_ts: Column, now: Column) -> Column:
    """Weight today; time that has not come yet does not warm it."""
    return w * S.recency(age_days(last_ts, now))


def kept(scored: DataFrame, now: Column, most: int = KEPT) -> DataFrame:
    """Pairs among the ``most`` strongest of either end, by weight today; ties go to the smaller partner.

    Weights are compared as logarithms, so old history keeps its order when all of it has cooled to nothing.
    """
    log = F.ln("w") - age_days(F.col("last_ts"), now) * math.log(2) / S.HISTORY_DAYS
    eff = scored.withColumns({"eff": effective(F.col("w"), F.col("last_ts"), now), "log": F.round(log, 9)})
    ends = eff.select("*", F.explode(F.array(F.struct(F.col("a").alias("item"), F.col("b").alias("partner")), F.struct(F.col("b").alias("item"), F.col("a").alias("partner")))).alias("e"))
    rank = F.row_number().over(Window.partitionBy("e.item").orderBy(F.desc("log"), "e.partner"))
    return ends.withColumn("rank", rank).where(F.col("rank") <= most).drop("e", "log", "rank").dropDuplicates(["a", "b"])


def reseed(seeds: DataFrame, history: DataFrame, now: Column) -> DataFrame:
    """(partner, w) of the seeds' (item) partners that are no seeds, each at the most that any seed gives it."""
    both = history.select(F.col("a").alias("item"), F.col("b").alias("partner"), "w", "last_ts").unionByName(history.select(F.col("b").alias("item"), F.col("a").alias("partner"), "w", "last_ts"))
    out = both.join(seeds.select("item").distinct(), "item").join(seeds.select(F.col("item").alias("partner")).distinct(), "partner", "left_anti")
    out = out.groupBy("partner").agg(F.max(effective(F.col("w"), F.col("last_ts"), now)).alias("w"))
    return out.where("w > 1e-6")
