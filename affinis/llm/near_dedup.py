"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .textkernel import LOWER, U64, Words, begin, chunks, gram_hashes, long_lists, sequence_hash, splitmix
from .workspace import Workspace

#: Shingles whose signature is computed together, so that they stay in the processor's cache.
BLOCK = 1 << 15


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    if len(data):
        data = LOWER[data]
    found = Words(data, offsets)
    hashes, first = found.hashes(), found.first
    grams = gram_hashes(hashes, words)
    out = []
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            out.append(np.array([sequence_hash(hashes[a:b])], U64))
        else:
            out.append(np.empty(0, U64))
    return out


def permute(x: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of the 32-bit universe, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Circulant MinHash: row i has the ``size`` coordinates of set i, none of which may be empty.

    The first permutation scatters shingles over 2**32 places. Coordinate k is the least value of the second
    permutation shifted circularly by k, over the places of the set.
    """
    out = np.empty((len(sets), size), np.uint32)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= BLOCK):
            n += len(sets[j])
            j += 1
        places = (splitmix(np.concatenate(sets[i:j]) ^ U64(0xA0761D6478BD642F)) >> U64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[i : j - 1])])
        for k in range(size):
            out[i:j, k] = np.minimum.reduceat(permute(places - np.uint32(k)), starts)
        i = j
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of coordinates, told from the other bands' by the band's number."""
    n, size = signature.shape
    parts = signature.reshape(n, bands, size // bands).astype(U64)
    keys = np.broadcast_to(splitmix(np.arange(1, bands + 1, dtype=U64)), (n, bands)).copy()
    for r in range(size // bands):
        keys = splitmix(keys * U64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return keys


def signature_batches(words: int, bands: int, rows: int):
    """mapInArrow function: (id, text) to (id, n, f1, f2, keys); f1 and f2 identify the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("near")
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                sets = shingle_sets(data, offsets, words)
                sizes = np.array([len(s) for s in sets])
                full = [s for s in sets if len(s)]
                prints, keys = np.zeros((len(sets), 2), U64), np.empty((0, bands), U64)
                if full:
                    every, starts = np.concatenate(full), np.cumsum([0, *map(len, full[:-1])])
                    for c in range(2):
                        prints[sizes > 0, c] = np.add.reduceat(splitmix(every ^ U64(0x2545F4914F6CDD1D * (c + 1) & (1 << 64) - 1)), starts)
                    keys = band_keys(signatures(full, bands * rows), bands)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(prints[:, 0].view(np.int64)), pa.array(prints[:, 1].view(np.int64)), long_lists(keys.ravel(), np.where(sizes > 0, bands, 0))],
                    ["id", "n", "f1", "f2", "keys"],
                )

    return run


def set_batches(words: int):
    """mapInArrow function: (id, text) to (id, grams), the sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("near")
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                sets = shingle_sets(data, offsets, words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), long_lists(np.concatenate(sets), np.array([len(s) for s in sets]))], ["id", "grams"])

    return run


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, total): sizes of the intersection and the union of the full sets of each pair."""
    a, b = (sets.select(F.col("id").alias(c), F.col("grams").alias(f"g{c}")) for c in "ab")
    both = F.size(F.array_intersect("ga", "gb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("both"), (F.size("ga") + F.size("gb")).alias("total")).select("a", "b", "both", (F.col("total") - F.col("both")).alias("total"))


def strays(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The members but the pivot of buckets of more than two, with their components and the pivot's."""
    label = labels.select(F.col("node").alias("id"), "label")
    pivot_label = labels.select(F.col("node").alias("pivot"), F.col("label").alias("pivot_label"))
    return buckets.where("members > 2 and id <> pivot").join(label, "id").join(pivot_label, "pivot")


def with_pivots(ws: Workspace, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, id, members, pivot) of the buckets of two members or more, and (id, mass), the members of its buckets.

    A bucket's pivot is its member with the most mass. What a family of documents was made from agrees with the most
    of them on a band, so its buckets are the largest.
    """
    shared = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    held = ws.table(keys.join(shared, "key"), "held")
    mass = ws.table(held.groupBy("id").agg(F.sum("members").alias("mass")), "mass")
    pivots = held.join(mass, "id").groupBy("key").agg(F.max_by("id", F.struct("mass", -F.col("id"))).alias("pivot"))
    return ws.table(held.join(pivots, "key"), "buckets"), mass


def far_pairs(ws: Workspace, rest: DataFrame, labels: DataFrame, mass: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): every pair of one bucket and two components that may be linked, a being apart from the pivot's component.

    With P the set of the pivot's component that has the most mass, a set A that is not linked with P and a set B have
    at most the similarity of A and P if they share nothing outside P and B is at least as large as P. So linked ones
    share a shingle that P has not, which is what the first join is on; or B is smaller than P, and of P's shingles
    that B has not, fewer than percent / (100 + percent) of the difference in size are in A. So one of any that many of
    them is missing in A too, which is what the second join is on. As linked sets share percent % of each, those that
    share something outside P share one of the rarest such shingles of each, of which (100 - percent) % of its size and
    one more are looked at. In a group that was made from P, or around it, neither join grows with the square, since
    what its members add is their own or stands behind what is.
    """
    groups = rest.select(F.col("pivot_label").alias("whole"), "id", "label").distinct()
    groups = groups.join(groups.where("label <> whole").select("whole").distinct(), "whole", "left_semi")
    heavy = labels.join(mass.withColumnRenamed("id", "node"), "node").groupBy(F.col("label").alias("whole")).agg(F.max_by("node", F.struct("mass", -F.col("node"))).alias("pivot"))
    p, g = sets.select(F.col("id").alias("pivot"), F.col("grams").alias("gp")), sets.select("id", "grams")
    deltas = groups.join(heavy, "whole").where("id <> pivot").join(p, "pivot").join(g, "id").select(
        "pivot", "id", "label", (F.col("label") != F.col("whole")).alias("odd"), F.size("grams").alias("n"), F.size("gp").alias("np"), F.array_except("grams", "gp").alias("added"), F.array_except("gp", "grams").alias("removed")
    )
    deltas = ws.table(deltas, "deltas")
    one, two = (deltas.select("pivot", F.col("id").alias(c), F.col("label").alias(f"l{c}"), F.col("odd").alias(f"o{c}"), F.col("n").alias(f"n{c}"), F.size("removed").alias(f"r{c}"), "np", "removed") for c in "ab")
    one = one.where("oa")
    each = deltas.select("pivot", "id", F.explode("added").alias("g"))
    shared = each.groupBy("pivot", "g").agg(F.count("*").alias("c")).where("c > 1")
    ordered = each.join(shared, ["pivot", "g"]).groupBy("pivot", "id").agg(F.sort_array(F.collect_list(F.struct("c", "g"))).alias("shared"))
    least = F.least(F.size("added"), F.floor(F.lit(100 - percent) * F.col("n") / 100) + 1) - F.size("added") + F.size("shared")
    front = ws.table(deltas.join(ordered, ["pivot", "id"]).select("pivot", "id", "label", "odd", F.explode(F.slice("shared", F.lit(1), F.greatest(least, F.lit(0)).cast("int"))).alias("x")).select("pivot", "id", "label", "odd", "x.g"), "front")
    x, y = (front.select("pivot", "g", F.col("id").alias(c), F.col("label").alias(f"l{c}"), F.col("odd").alias(f"o{c}")) for c in "ab")
    by_added = x.where("oa").join(y, ["pivot", "g"]).where("la <> lb and (not ob or a < b)")
    few = F.slice("removed", 1, F.ceil(F.lit(percent) * (F.col("np") - F.col("nb")) / F.lit(100 + percent)).cast("int"))
    less = two.where("nb < np").select("pivot", "b", "lb", "ob", "nb", "rb", "np", F.explode(few).alias("g"))
    by_removed = one.select("pivot", "a", "la", "na", "ra", F.explode("removed").alias("g")).join(less, ["pivot", "g"]).where(f"la <> lb and {100 + percent} * (np - greatest(ra, rb)) >= {percent} * (na + nb)")
    return by_added.select("a", "b").unionByName(by_removed.select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = 40, rows: int = 6, rounds: int = 2) -> DataFrame:
    """Classes of documents whose sets of ``words``-word shingles have a Jaccard similarity of ``percent`` % or more.

    Returns a row for each input row: the id, n_shingles (size of the set), component_id (least id reachable
    over links, itself included) and kept (whether it is that least id).

    Words are runs of characters other than ASCII white space, with A-Z lower-cased. A null or wordless text
    has an empty set and is linked with nothing; a text of fewer words than a shingle has its whole sequence as
    its only shingle. Rows with the same id are one document, linked if one of its texts is. A row with a null
    id is kept with a null component. Other columns are ignored, whatever their names.

    Copies with equal sets are one representative from the start. Representatives that agree on all ``rows``
    coordinates of one of ``bands`` bands are candidates; at the default sizes a pair at exactly 80 % is missed
    with probability 5e-6. Candidates are not expanded into all pairs. Each bucket first compares its members
    with its pivot, on full sets. In ``rounds`` rounds, members that are in another component than the pivot are
    compared with one more member of that component. Those left are compared with the members of the bucket that
    are in a component other than their own and that ``far_pairs`` does not rule out by what they share outside the
    pivot's set; so every link between components is found.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "near-dedup")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sigs = ws.table(base.mapInArrow(signature_batches(words, bands, rows), "id long, n long, f1 long, f2 long, keys array<long>"), "signatures")
    groups = sigs.where("n > 0 and id is not null").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"))
    copies = ws.table(sigs.where("n > 0").select("id", "f1", "f2", "n").join(groups, ["f1", "f2", "n"]).select("id", "rep").where("id is not null").distinct(), "copies")
    heads = copies.where("id = rep").select("id")
    buckets, mass = with_pivots(ws, sigs.where("n > 0").join(heads, "id").select("id", F.explode("keys").alias("key")).distinct())
    stars = ws.table(buckets.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), "stars")
    needed = stars.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = ws.table(base.join(needed.hint("merge"), "id").mapInArrow(set_batches(words), "id long, grams array<long>"), "sets")
    tried = ws.table(verified(stars, sets), "tried")
    link = F.expr(f"100 * both >= {percent} * total")
    nodes = buckets.select(F.col("id").alias("node")).distinct()
    labels = ws.table(nodes.join(connected_components(ws, tried.where(link).select("a", "b"), "stars"), "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")

    for k in range(rounds + 1):
        rest = strays(buckets, labels)
        odd = ws.table(rest.where("label <> pivot_label"), f"odd{k}")
        if odd.isEmpty():
            break
        if k < rounds:
            mask = F.lit(int(splitmix(np.array([k + 1], U64))[0]) >> 2)
            another = rest.where("label = pivot_label").groupBy("key").agg(F.min(F.col("id").bitwiseXOR(mask)).bitwiseXOR(mask).alias("b"))
            again = odd.select("key", F.col("id").alias("a")).join(another, "key").select("a", "b").distinct()
        else:
            again = far_pairs(ws, rest, labels, mass, sets, percent)
        done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        again = again.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(done, ["a", "b"], "left_anti")
        new = ws.table(verified(again, sets), f"tried{k}")
        la, lb = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        bridges = new.where(link).join(la, "a").join(lb, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        merged = connected_components(ws, bridges, f"bridges{k}").select(F.col("node").alias("label"), F.col("label").alias("lower"))
        labels = ws.table(labels.join(merged, "label", "left").select("node", F.coalesce("lower", "label").alias("label")), f"labels{k}")
        tried = tried.unionByName(new)

    classes = copies.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("label", "rep")).alias("component_id"))
    out = sigs.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles")).join(classes.withColumnRenamed("id", id_col), id_col, "left")
    out = out.withColumn("component_id", F.coalesce("component_id", id_col))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that ``near_duplicates`` keeps, with all their columns."""
    gone = near_duplicates(docs, id_col, text_col, words, percent).where("not kept").select(F.col(id_col).alias("gone_id")).distinct()
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of ``documents`` on two-word shingles at 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)
