"""Queries resolved to seed nodes, or to suggestions where nothing matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.functions import identifiers as I
from affinis.functions import literals as L
from affinis.keeping import dealt, tasks_for

#: How many seeds and suggestions there are, and how alike a suggestion is.
SEEDS, SUGGESTIONS, ALIKE = 16, 5, 0.34


def with_ancestors(rows: DataFrame, path: str) -> DataFrame:
    """rows once for each path above theirs, and for theirs itself: (..., above, own)."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return rows.withColumn("above", F.explode(F.filter(above, lambda a: a != ""))).withColumn("own", F.col("above") == F.col(path))


def literal_matches(query: DataFrame, index: DataFrame, routes: DataFrame) -> DataFrame:
    """(q, node, score) of queries (q): its key's nodes 1, keys below a path 0.8, anchors (node, route) at or below it 0.9.

    Every path is told by all paths above it, and those are joined with the queries' keys; so any number of queries is
    one join, and no query meets a key that is not its own or below it.
    """
    q = query.withColumn("q_kind", L.classify(F.col("q"))).where("q_kind is not null").withColumn("norm", L.normalize(F.col("q"), F.col("q_kind"))).select("q", "q_kind", "norm").distinct()
    keys = index.select("key", F.col("kind").alias("key_kind"), F.col("occ.node").alias("nodes"))
    same = keys.join(q, F.col("key") == F.col("norm")).select("q", F.explode("nodes").alias("node"), F.lit(1.0).alias("score"))
    paths = q.where("q_kind = 'path'")
    below = with_ancestors(keys.where("key_kind = 'path'"), "key").where("not own").join(paths, F.col("above") == F.col("norm")).select("q", F.explode("nodes").alias("node"), F.lit(0.8).alias("score"))
    by_route = with_ancestors(routes, "route").join(paths, F.col("above") == F.col("norm")).select("q", "node", F.lit(0.9).alias("score"))
    return same.unionByName(below).unionByName(by_route)


def name_matches(query: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, score, tier) of nodes (node, name, kind, file) by the query's (q) terms.

    Tier 0 is an exact name; 1 an equal, beginning or contained one (1, 0.8, 0.5); 2 a name of the same terms (0.7).
    A file that is the query or ends in it counts in every tier (tier -1).
    """
    terms = query.select("q", F.explode(F.filter(F.split(F.trim("q"), r"\s+"), lambda t: F.length(t) > 1)).alias("term")).withColumn("term", F.lower("term"))
    low = F.lower("name")
    symbol = ~F.col("kind").isin("file", "anchor")
    by_term = nodes.crossJoin(F.broadcast(terms)).withColumn("low", low)
    exact = by_term.where("low = term").select("node", F.lit(1.0).alias("score"), F.lit(0).alias("tier"))
    loose = F.when(F.col("low") == F.col("term"), 1.0).when(F.col("low").startswith(F.col("term")), 0.8).when(F.contains("low", "term"), 0.5)
    part = by_term.where(symbol).withColumn("score", loose).where("score is not null").select("node", "score", F.lit(1).alias("tier"))
    whole = nodes.crossJoin(F.broadcast(query.select("q")))
    same = whole.where(symbol & I.same_terms(F.col("q"), F.col("name"))).select("node", F.lit(0.7).alias("score"), F.lit(2).alias("tier"))
    file = whole.where((F.col("kind") == "file") & ((F.col("file") == F.col("q")) | F.col("file").endswith(F.concat(F.lit("/"), F.col("q"))))).select("node", F.lit(1.0).alias("score"), F.lit(-1).alias("tier"))
    return exact.unionByName(part).unionByName(same).unionByName(file)


def resolve(query: DataFrame, nodes: DataFrame, literal: DataFrame | None = None, most: int = SEEDS) -> DataFrame:
    """(node, score): the first tier with a match, after literals (node, score); best first, then by file and name."""
    found = name_matches(query, nodes)
    if literal is not None:
        found = found.unionByName(literal.select("node", "score", F.lit(0).alias("tier")))
    first = found.where("tier >= 0").agg(F.min("tier").alias("first"))
    found = found.crossJoin(F.broadcast(first)).where("tier = -1 or tier = first").groupBy("node").agg(F.max("score").alias("score"))
    return found.join(nodes, "node").orderBy(F.desc("score"), "file", "name", "node").limit(most)


def suggestions(query: DataFrame, nodes: DataFrame, most: int = SUGGESTIONS) -> DataFrame:
    """(q, node, name, file, score): for each query (q) the names most like it, by ``identifiers.similarity``.

    Names are looked up by their terms and by their character pairs (those too short for a pair by all they have), so a
    query meets only names that share one of those, which every name as much alike as ALIKE does; what is shared is
    counted in the same joins. Any number of
    queries is one job.
    """
    joined = lambda terms: F.array_join(terms, "")
    q = query.select("q").distinct().select("q", I.terms(F.col("q")).alias("terms"))
    tasks = tasks_for(nodes, 50_000)
    c = dealt(nodes.where(~F.col("kind").isin("file", "anchor")), "node", "name", "file", tasks=tasks).select(F.struct("node", "name", "file").alias("id"), I.terms(I.short_name(F.col("name"))).alias("terms"))
    pairs = lambda s: F.when(F.length(s) > 1, F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    counted = lambda rows, key: rows.select(key, F.explode(pairs(joined("terms"))).alias("pair")).groupBy(key, "pair").agg(F.count("*").alias(f"n_{key}"))
    by_pair = counted(q, "q").join(counted(c, "id"), "pair").groupBy("q", "id").agg(F.sum(F.least("n_q", "n_id")).alias("pairs"), F.lit(0).cast("long").alias("shared"))
    by_term = q.select("q", F.explode("terms").alias("term")).join(c.select("id", F.explode("terms").alias("term")), "term").groupBy("q", "id").agg(F.lit(0).cast("long").alias("pairs"), F.count("*").alias("shared"))
    short = lambda rows, key: rows.select(key, joined("terms").alias("whole")).where(F.length("whole") < 2)
    by_whole = short(q, "q").join(short(c, "id"), "whole").select("q", "id", F.lit(0).cast("long").alias("pairs"), F.lit(0).cast("long").alias("shared"))
    both = dealt(by_pair.unionByName(by_term).unionByName(by_whole), "q", "id", tasks=tasks).groupBy("q", "id").agg(F.max("pairs").alias("pairs"), F.max("shared").alias("shared"))
    rows = both.join(q.withColumnRenamed("terms", "tq"), "q").join(c.withColumnRenamed("terms", "tc"), "id")
    part = lambda n, weight: F.when(F.size(n) > 0, weight * F.col("shared") / F.size(n)).otherwise(0.0)
    a, b = joined("tq"), joined("tc")
    dice = F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(2.0 * F.col("pairs") / (F.length(a) + F.length(b) - 2))
    rows = rows.select("q", "id.*", F.greatest(part("tq", 0.72) + part("tc", 0.28), dice).alias("score")).where(F.col("score") >= ALIKE)
    order = Window.partitionBy("q").orderBy(F.desc(F.round("score", 12)), "name", "file", "node")
    return rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).orderBy("q", "k").drop("k")
