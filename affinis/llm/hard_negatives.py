"""Hard negatives by vantage-point trees over norm-augmented vectors: windows of scores are annuli of distances."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernel import begin
from .workspace import Workspace

#: Rows of a tree's leaf, and most rows of the upper tree's sample by its components.
LEAF, SAMPLE_VALUES = 256, 4_000_000
#: Squared length up to which scores surely fit a long.
LONGEST = 2.0**62
#: Part of the largest length that distances may be off by, through rounding.
SLACK = 1e-6
ROW = "row long, id long, label long, dim int, v array<long>"
FOUND = "row long, slot int, id long, score long"


def matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def augmented(v: np.ndarray, bound: float) -> np.ndarray:
    """The vectors with one component more, which brings all of them to the length sqrt(bound)."""
    x = v.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(bound - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def distances(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    d = x - point
    return np.sqrt((d * d).sum(axis=1))


class UpperTree:
    """Vantage points of a bounded sample, in the order of a complete binary tree; its leaves are places for rows.

    At each node the left side holds what is within the radius. A row goes to one place; what can lie in a place is
    bounded by the triangle inequality along the path to it.
    """

    def __init__(self, sample: np.ndarray, bound: float, places: int):
        self.bound, self.depth = bound, max(0, math.ceil(math.log2(max(places, 1))))
        self.vantage, self.radius = np.zeros((2**self.depth - 1, sample.shape[1] + 1)), np.zeros(2**self.depth - 1)
        parts = [augmented(sample, bound)]
        for node in range(len(self.vantage)):
            part = parts[node]
            if not len(part):
                parts += [part, part]
                continue
            self.vantage[node] = part[len(part) // 2]
            d = distances(part, self.vantage[node])
            self.radius[node] = np.median(d)
            parts += [part[d <= self.radius[node]], part[d > self.radius[node]]]

    def place(self, v: np.ndarray) -> np.ndarray:
        x, node = augmented(v, self.bound), np.zeros(len(v), np.int64)
        for _ in range(self.depth):
            for k in np.unique(node):
                own = node == k
                node[own] = 2 * k + 1 + (distances(x[own], self.vantage[k]) > self.radius[k])
        return node - len(self.vantage)

    def bounds(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most distance of each query from what each place can hold."""
        x = np.concatenate([v.astype(np.float64), np.zeros((len(v), 1))], axis=1)
        low, high = np.zeros((len(v), 1)), np.full((len(v), 1), np.inf)
        for level in range(self.depth):
            first = 2**level - 1
            low, high = np.repeat(low, 2, axis=1), np.repeat(high, 2, axis=1)
            for k in range(first, 2 * first + 1):
                d, r, at = distances(x, self.vantage[k]), self.radius[k], 2 * (k - first)
                low[:, at] = np.maximum(low[:, at], d - r)
                high[:, at] = np.minimum(high[:, at], d + r)
                low[:, at + 1] = np.maximum(low[:, at + 1], r - d)
        return low, high


class VantageTree:
    """A vantage-point tree over the rows of one cell, its rows reordered so that each node's stand together."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, bound: float, seed: int = 5):
        x, rng = augmented(v, bound), np.random.default_rng(seed)
        order = np.arange(len(x))
        #: Of each node: first row, row after the last, vantage (or -1), children, and their least and most distance from it.
        self.nodes: list[list] = [[0, len(x), -1, -1, -1, 0.0, 0.0, 0.0, 0.0]]
        points: list[int] = []
        todo = [0]
        while todo:
            k = todo.pop()
            a, b = self.nodes[k][:2]
            if b - a <= LEAF:
                continue
            point = int(order[a + int(rng.integers(b - a))])
            d = distances(x[order[a:b]], x[point])
            rank = np.argsort(d, kind="stable")
            order[a:b], d = order[a:b][rank], d[rank]
            m = (b - a) // 2
            self.nodes[k][2:] = [len(points), len(self.nodes), len(self.nodes) + 1, d[0], d[m - 1], d[m], d[-1]]
            points.append(point)
            for c, e in ((a, a + m), (a + m, b)):
                todo.append(len(self.nodes))
                self.nodes.append([c, e, -1, -1, -1, 0.0, 0.0, 0.0, 0.0])
        self.row, self.id, self.label = row[order], ids[order], labels[order]
        most = float(np.abs(v).max(initial=0))
        # Products of doubles are exact as long as their sums stay below 2**53.
        self.exact = most * most * max(v.shape[1], 1) < 2**53
        self.v = v[order].astype(np.float64) if self.exact else v[order]
        self.vantages = v[points].astype(np.float64)
        self.bound = bound
        self.only = [self.label[a] if b > a and (self.label[a:b] == self.label[a]).all() else None for a, b, *_ in self.nodes]

    def search(self, q: np.ndarray, row: int, label: int, same: bool, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each window (low, high) of scores the k first (score, id) of the rows but ``row`` that have the label, or have not.

        Nodes are taken from a queue, nearest first. One is passed over if every window has its annulus elsewhere, or has
        found k rows that are nearer than anything in the node.
        """
        squares, slack = float((q.astype(np.float64) ** 2).sum()), SLACK * math.sqrt(self.bound) + 1e-9
        far = lambda score: math.sqrt(max(squares + self.bound - 2.0 * score, 0.0))  # noqa: E731  the distance of that score
        q = q.astype(np.float64) if self.exact and float(np.abs(q).max(initial=0)) * float(np.abs(self.v).max(initial=0)) * max(len(q), 1) < 2**53 else q
        rows = self.v if q.dtype == self.v.dtype else self.v.astype(np.int64)
        to_vantage = np.sqrt(np.maximum(squares + self.bound - 2.0 * (self.vantages @ q.astype(np.float64)), 0))
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        inner, outer = [far(high) - slack for _, high in windows], [far(low) + slack if low <= high else -math.inf for low, high in windows]
        floor, ceiling = [low if low <= high else math.inf for low, high in windows], max((high for _, high in windows), default=0)
        queue = [(0.0, 0, math.inf)]
        while queue:
            low, n, high = heapq.heappop(queue)
            if not any(low <= outer[w] and high >= inner[w] for w in range(len(windows))):
                continue
            a, b, vantage, *rest = self.nodes[n]
            if self.only[n] is not None and (self.only[n] == label) != same:
                continue
            if vantage >= 0:
                d, (left, right, l0, l1, r0, r1) = to_vantage[vantage], rest
                heapq.heappush(queue, (max(low, d - l1, l0 - d), left, min(high, d + l1)))
                heapq.heappush(queue, (max(low, d - r1, r0 - d), right, min(high, d + r1)))
                continue
            # What no window can take, being outside of all or behind what they have, goes before labels are looked at.
            scores = rows[a:b] @ q
            at = np.flatnonzero((scores >= min(floor)) & (scores <= ceiling))
            at = at[((self.label[a + at] == label) == same) & (self.row[a + at] != row)] if len(at) else at
            if not len(at):
                continue
            scores, ids = scores[at].astype(np.int64), self.id[a + at]
            rank = np.lexsort((ids, -scores))
            scores, ids = scores[rank], ids[rank]
            falling = -scores
            for w, (least, most) in enumerate(windows):
                i = int(np.searchsorted(falling, -most))
                j = min(i + k, int(np.searchsorted(falling, -least, side="right")))
                if j > i:
                    found[w] = heapq.nsmallest(k, found[w] + [(-s, x) for s, x in zip(scores[i:j].tolist(), ids[i:j].tolist(), strict=True)])
                    if len(found[w]) == k:
                        floor[w] = -found[w][-1][0]
                        outer[w] = min(outer[w], far(floor[w]) + slack)
        return [[(-s, x) for s, x in f] for f in found]


def score_windows(scores: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """The whole scores n with low * s <= 100 * n <= high * s for each s."""
    return [(-(-low * s // 100), high * s // 100) for s in scores]


def search_batches(bound: float, same: bool, k: int, low: int, high: int):
    """mapInArrow function: rows of cells, each cell's indexed ones (kind 0) before its queries (kind 1), to (row, slot, id, score).

    A query has the scores of its positives or, if the same label is wanted, the least score of use, if there is one. A tree is built when a cell's first query comes, and the queries of that cell run through it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("hard-negatives")
        cell, held, tree = None, [], None
        for batch in batches:
            cells, kind, row, ids, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            edges = [0, *(np.flatnonzero((np.diff(cells) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(cells)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if cells[a] != cell:
                    cell, held, tree = cells[a], [], None
                v = matrix(batch.column(5).slice(a, b - a))
                if kind[a] == 0:
                    held.append((row[a:b], ids[a:b], label[a:b], v))
                    continue
                if not held and tree is None:
                    continue
                if tree is None:
                    tree, held = VantageTree(*(np.concatenate(x) for x in zip(*held, strict=True)), bound), []
                out: list[tuple[int, int, int, int]] = []
                for i, scores in zip(range(a, b), batch.column(6).slice(a, b - a).to_pylist(), strict=True):
                    windows = [(scores[0] if scores else -(2**62), 2**62)] if same else score_windows(scores, low, high)
                    for slot, best in enumerate(tree.search(v[i - a], int(row[i]), int(label[i]), same, windows, k)):
                        out += [(int(row[i]), slot, x, s) for s, x in best]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind_) for x, kind_ in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["row", "slot", "id", "score"])

    return run


def place_batches(tree: UpperTree | None, dim: int):
    """mapInArrow function: rows to rows with their place; rows of another length than the tree's are in place 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.zeros(batch.num_rows, np.int64)
            own = np.flatnonzero(batch.column(3).to_numpy() == dim)
            if tree and len(own):
                place[own] = tree.place(matrix(batch.column(4).take(pa.array(own))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "place"])

    return run


def route_batches(tree: UpperTree | None, dim: int, bound: float, same: bool, low: int, high: int):
    """mapInArrow function: (row, dim, v, scores, reach) to (row, place) of each place that may hold what is asked for.

    reach is the k-th best score found so far, or null; for different labels the windows of ``scores`` say where to look.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, dims = batch.column(0), batch.column(1).to_numpy()
            out: list[tuple[np.ndarray, np.ndarray]] = []
            own = np.flatnonzero(dims == dim) if tree else np.empty(0, np.int64)
            for i in np.setdiff1d(np.arange(len(dims)), own):
                out.append((np.array([i]), np.array([0])))
            if len(own):
                v = matrix(batch.column(2).take(pa.array(own)))
                least, most = tree.bounds(v)
                squares, slack = (v.astype(np.float64) ** 2).sum(axis=1), SLACK * math.sqrt(bound) + 1e-9
                for k, i in enumerate(own.tolist()):
                    far = lambda s, n=squares[k]: math.sqrt(max(n + bound - 2.0 * s, 0.0))
                    if same:
                        reach = batch.column(4)[i].as_py()
                        wanted = least[k] <= (math.inf if reach is None else far(reach) + slack)
                    else:
                        wanted = np.zeros(least.shape[1], bool)
                        for a, b in score_windows(batch.column(3)[i].as_py(), low, high):
                            if a <= b:
                                wanted |= (least[k] <= far(a) + slack) & (most[k] >= far(b) - slack)
                    at = np.flatnonzero(wanted)
                    out.append((np.full(len(at), i), at))
            at, places = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([rows.take(pa.array(at, pa.int64())), pa.array(places, pa.int64())], ["row", "place"])

    return run


class VantageForest:
    """Rows (id, label, v: whole numbers) dealt into cells, each of which a task searches with a tree of its own.

    The upper levels are one tree on a bounded sample (SAMPLE_VALUES components), which deals the rows of the most
    frequent length into places; a place with more than ``cell_rows`` rows, be they copies of one vector, is split by a
    hash of the row. So a cell is bounded, whatever the data, and a query goes to those places only that can hold what it
    asks for. Rows with a null id, label, vector or component take no part, nor do vectors whose squared length is over
    2**62, since their scores may not fit a long. Vectors of different lengths have no score with each other.
    """

    def __init__(self, rows: DataFrame, cell_rows: int = 8192):
        self.spark, self.ws = rows.sparkSession, Workspace(rows.sparkSession, "vantage")
        squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        usable = rows.where("id is not null and label is not null and v is not null").where(F.forall("v", lambda x: x.isNotNull()) & (squares <= LONGEST))
        # Rows are numbered once, in the written table, since ids may repeat.
        numbered = usable.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.size("v").alias("dim"), F.col("v").cast("array<long>").alias("v"))
        rows = self.ws.table(numbered, "rows")
        seen = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(squares).alias("bound")).orderBy(F.desc("n"), "dim").limit(1000).collect()
        self.bound = max(1.0, rows.agg(F.max(squares)).first()[0] or 0.0) * (1 + 1e-9)
        self.dim, n = (seen[0]["dim"], seen[0]["n"]) if seen else (0, 0)
        places = min(-(-n // cell_rows), max(1, SAMPLE_VALUES // max(self.dim, 1) // 16))
        self.tree = None
        if places > 1 and self.dim:
            sample = rows.where(F.col("dim") == self.dim).orderBy(F.xxhash64("row")).limit(16 * places).select("v").toPandas()
            self.tree = UpperTree(np.stack(sample.v.to_list()), self.bound, places)
        placed = self.ws.table(rows.mapInArrow(place_batches(self.tree, self.dim), ROW + ", place long"), "placed")
        salts = placed.groupBy("dim", "place").agg(F.ceil(F.count("*") / cell_rows).alias("salts"))
        self.salts = self.ws.table(salts, "salts")
        self.rows = placed
        self.searches = 0

    def cells(self, rows: DataFrame) -> DataFrame:
        """rows (dim, place, ...) with their cell: one by a hash of the row."""
        salted = rows.join(self.salts, ["dim", "place"])
        return salted.withColumn("cell", F.xxhash64("dim", "place", F.pmod(F.xxhash64("row", F.lit(3)), F.col("salts"))))

    def search(self, queries: DataFrame, places: DataFrame, same: bool, k: int, low: int = 0, high: int = 0) -> DataFrame:
        """(row, slot, id, score): up to k from each cell of the stated places (row, place), for each query and window."""
        self.searches += 1
        held = self.cells(self.rows).select("cell", F.lit(0).alias("kind"), "row", "id", "label", "v", F.lit(None).cast("array<long>").alias("scores"))
        asked = queries.join(places, "row").join(self.salts, ["dim", "place"])
        asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select(F.xxhash64("dim", "place", "salt").alias("cell"), F.lit(1).alias("kind"), "row", "id", "label", "v", "scores")
        both = held.join(asked.select("cell").distinct(), "cell", "left_semi").unionByName(asked)
        ordered = both.repartition("cell").sortWithinPartitions("cell", "kind")
        return self.ws.table(ordered.mapInArrow(search_batches(self.bound, same, k, low, high), FOUND), f"found{self.searches}")

    def routes(self, queries: DataFrame, same: bool, low: int = 0, high: int = 0) -> DataFrame:
        return queries.select("row", "dim", "v", "scores", "reach").mapInArrow(route_batches(self.tree, self.dim, self.bound, same, low, high), "row long, place long")


def first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each row and slot over all cells, ranked from 1."""
    order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, cell_rows: int = 8192) -> DataFrame:
    """Hard negatives of the ``anchors`` (a condition on id) among rows (id, label, v: array of whole numbers).

    An anchor's positives are the ``positives`` other rows of its label with the largest inner products. For each of them
    come the first ``negatives`` rows of other labels whose score lies between ``low`` and ``high`` hundredths of the
    positive's, larger scores first, ties by smaller id: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. An anchor without positives, or a positive without such rows (as is any of a negative score, whose
    window is empty), gives none. Rows that share an id are rows of their own, each an anchor if the id is one. Which rows
    take no part ``VantageForest`` says; further columns are ignored.

    With all vectors brought to one length M by one more component, the squared distance from an anchor a (with 0 there)
    is |a|**2 + M**2 - 2 * score: nearest is best, and a window of scores is an annulus. Positives are looked for in the
    anchor's own place first; what is found bounds the places to search next.
    """
    forest = VantageForest(rows, cell_rows)
    ws, found = forest.ws, T.StructType.fromDDL("scores array<long>, reach long")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in found]
    asked = ws.table(forest.rows.where(anchors).select("row", "id", "label", "dim", "v", "place", *none), "anchors")
    home = asked.select("row", "place")
    near = forest.search(asked.drop("place"), home, True, positives)
    reach = first(near, positives).where(F.col("rank") == positives).select("row", F.col("score").alias("reach"))
    further = asked.drop("reach", "place", "scores").join(reach, "row", "left").withColumn("scores", F.when(F.col("reach").isNotNull(), F.array("reach")))
    others = forest.routes(further, True).join(home, ["row", "place"], "left_anti")
    near = near.unionByName(forest.search(further, others, True, positives))
    chosen = ws.table(first(near, positives).select("row", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    lists = chosen.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    windows = ws.table(asked.drop("scores", "place").join(lists, "row"), "windows")
    best = first(forest.search(windows, forest.routes(windows, False, low, high), False, negatives, low, high), negatives)
    out = best.select("row", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(chosen, ["row", "slot"]).join(asked.select("row", F.col("id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives in ``embeddings``, for rows whose vec_id is divisible by 50; labels of ids divisible by 7 are moved on by one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.where(finite).select(F.col("vec_id").alias("id"), label.alias("label"), v.alias("v")), "id % 50 = 0")
