"""Quality rules on whole texts and an isolation forest on their statistics."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.operators import order

from .textkernel import SPACE, U64, Words, begin, chunks, gram_hashes, row_numbers, splitmix
from .workspace import Workspace, with_id

#: Words of the windows whose repetition counts.
WINDOW = 5
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines",)
STATISTICS = ", ".join(f"{c} long" for c in (*COUNTS, *EXTRA))


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def twice(values: np.ndarray) -> np.ndarray:
    """Whether each value is among the others too."""
    ordered = np.sort(values)
    repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(repeated):
        return np.zeros(len(values), bool)
    at = np.searchsorted(repeated, values)
    return repeated[np.minimum(at, len(repeated) - 1)] == values


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The columns COUNTS and EXTRA for each text."""
    found = Words(data, offsets)
    first, hashes = found.first, found.hashes()
    n = len(offsets) - 1
    out = np.zeros((n, len(COUNTS) + len(EXTRA)), np.int64)
    out[:, 0] = np.diff(first)
    out[:, 1] = per_text(((data & 0xC0) != 0x80) & ~SPACE[data], offsets)
    out[:, 2] = per_text(SYMBOL[data], offsets)
    rows = row_numbers(first)
    salt = splitmix(np.arange(1, n + 1, dtype=U64))
    windows = gram_hashes(hashes, WINDOW)
    inside = rows[: len(windows)] == rows[WINDOW - 1 :]
    starts = np.flatnonzero(inside)
    again = starts[twice(splitmix(windows[starts] ^ salt[rows[starts]]))]
    marks = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(marks, again, 1)
    np.add.at(marks, again + WINDOW, -1)
    out[:, 4] = per_text(np.cumsum(marks[:-1]) > 0, first)
    for i in range(n):
        seen: set[bytes] = set()
        lines = again_lines = 0
        for line in data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n"):
            if line.strip():
                lines += 1
                if line in seen:
                    again_lines += 1
                else:
                    seen.add(line)
        out[i, 3], out[i, 5] = again_lines, lines
    return out


def failed(stats: np.ndarray) -> np.ndarray:
    """The base rule: too few words, or more than a fifth of them in repeated windows."""
    return (stats[:, 0] < 10) | (100 * stats[:, 4] > 20 * stats[:, 0])


def ratios(stats: np.ndarray) -> np.ndarray:
    """What the forest looks at: characters, symbols and repetition a word, and repeated lines a line."""
    words, lines = np.maximum(stats[:, 0], 1), np.maximum(stats[:, 5], 1)
    return np.stack([stats[:, 1] / words, stats[:, 2] / words, stats[:, 3] / lines, stats[:, 4] / words], axis=1)


def mean_path(n: np.ndarray | float) -> np.ndarray | float:
    """Mean depth at which a random binary search tree of n points ends."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Complete binary trees in arrays: child nodes of i are 2i+1 and 2i+2; a leaf passes points on unchanged."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    level: np.ndarray
    sample: int
    depth: int

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7, far: np.ndarray | None = None) -> IsolationForest:
        """Trees on x, each on its own draw of x and of ``far``."""
        rng = np.random.default_rng(seed)
        sample, far = min(sample, len(x)), x[:0] if far is None else far
        pick = lambda points, n: points[rng.choice(len(points), n, replace=False)] if len(points) else points
        return cls.grow(((pick(x, sample), pick(far, min(sample, len(far)))) for _ in range(trees)), trees, sample, rng)

    @classmethod
    def grow(cls, draws: Iterable[tuple[np.ndarray, np.ndarray]], trees: int, sample: int, rng: np.random.Generator) -> IsolationForest:
        """A tree for each draw (points, far); splits reach beyond the points to where the far ones lie, so that what is alike splits too.

        A node with far points outside its points' range takes a feature as often as such points are outside in it, and
        splits between the range and one of them. Path lengths count the points alone.
        """
        depth = max(1, math.ceil(math.log2(max(sample, 2))))
        nodes = 2 ** (depth + 1) - 1
        feature, split, path, levels = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes)), np.zeros((trees, nodes), np.int8)
        for t, drawn in enumerate(draws):
            todo = [(0, 0, *drawn)]
            while todo:
                node, level, points, others = todo.pop()
                if len(points):
                    low, high = points.min(axis=0), points.max(axis=0)
                    wide, below, above = np.flatnonzero(high > low), others < low, others > high
                    outside = (below | above).sum(axis=0)
                if level == depth or not len(points) or not (outside.any() or (len(points) > 1 and len(wide))):
                    length = level + float(mean_path(len(points)))
                    first, width = node, 1
                    while first < nodes:
                        path[t, first : first + width], levels[t, first : first + width] = length, level
                        first, width = 2 * first + 1, 2 * width
                    continue
                if outside.any():
                    f = int(rng.choice(len(outside), p=outside / outside.sum()))
                    k = int(rng.choice(np.flatnonzero(below[:, f] | above[:, f])))
                    one, other = (others[k, f], low[f]) if below[k, f] else (high[f], others[k, f])
                    split[t, node] = max(rng.uniform(one, other), np.nextafter(one, np.inf))
                else:
                    f = int(rng.choice(wide))
                    split[t, node] = rng.uniform(low[f], high[f])
                feature[t, node] = f
                right, right_others = points[:, f] >= split[t, node], others[:, f] >= split[t, node]
                todo += [(2 * node + 1, level + 1, points[~right], others[~right_others]), (2 * node + 2, level + 1, points[right], others[right_others])]
        return cls(feature, split, path, levels, sample, depth)

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree, the nodes at which the points end."""
        rows = np.arange(len(x))
        for feature, split in zip(self.feature, self.split, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] >= split[node])
            yield node

    def counted(self, ends: np.ndarray, points: int) -> IsolationForest:
        """The trees with path lengths of so many points, of which ``ends`` (as ``path``) says how many end at each node."""
        return IsolationForest(self.feature, self.split, self.level + mean_path(ends), self.level, points, self.depth)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the shorter the mean path, the higher."""
        total = np.zeros(len(x))
        for node, path in zip(self.leaves(x), self.path, strict=True):
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / max(float(mean_path(self.sample)), 1.0))


@dataclass
class QualityModel:
    forest: IsolationForest | None
    threshold: float

    def keeps(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scores = self.forest.scores(ratios(stats)) if self.forest else np.zeros(len(stats))
        return scores, ~failed(stats) & (scores <= self.threshold)


def threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The score above which a row goes: the one that misjudges least of both classes, in the middle of its gap."""
    scores = np.unique(np.concatenate([good, bad]))
    wrong = len(good) - np.searchsorted(np.sort(good), scores, "right") + np.searchsorted(np.sort(bad), scores, "right")
    k = int(np.flatnonzero(wrong == wrong.min())[-1])
    return float(scores[k] + scores[k + 1]) / 2 if k + 1 < len(scores) else float(scores[k]) + 1e-9


def statistics_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (id, text) to the id and the statistics."""
    begin("quality")
    for batch in batches:
        for i, j, data, offsets in chunks(batch.column(1)):
            stats = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(stats[:, c]) for c in range(stats.shape[1]))], ["id", *COUNTS, *EXTRA])


def matrix(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """The last columns of a batch, which are statistics, as ``statistics`` has them."""
    return np.stack([batch.column(c).to_numpy() for c in (*COUNTS, *EXTRA)], axis=1)


def verdict_batches(model: QualityModel):
    """mapInArrow function: (id, statistics) to the id, the counts, the score and the verdicts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = matrix(batch)
            scores, kept = model.keeps(stats)
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + len(COUNTS)], pa.array(failed(stats)), pa.array(scores), pa.array(kept)], ["id", *COUNTS, "base_failed", "score", "kept"])

    return run


def drawn_batches(trees: int, rates: dict[bool, float]):
    """mapInArrow function: (good, hash, statistics) to the rows that each tree may draw: those whose key is within the class's rate."""
    salts = splitmix(np.arange(1, trees + 1, dtype=U64))
    most = {k: U64(2**64 - 1 if rate >= 1 else int(rate * 2**64)) for k, rate in rates.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(1).to_numpy().view(U64)
            within = np.where(batch.column(0).to_numpy(zero_copy_only=False), most[True], most[False])
            for t in range(trees):
                keys = splitmix(hashes ^ salts[t])
                at = np.flatnonzero(keys <= within)
                if len(at):
                    rows = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), rows.column(0), pa.array(keys[at].view(np.int64)), *rows.columns[2:]], ["tree", "good", "key", *COUNTS, *EXTRA])

    return run


def draws(rows: DataFrame, sizes: dict[bool, int], trees: int, sample: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """What each tree is grown on: of all rows (good, hash, statistics), ``sample`` good and as many bad ones, or all.

    A tree takes the rows of the least keys, which are hashes of the rows' and its own number. Rows beyond a key that
    leaves some to spare stay where they are, so at most about 1.5 times what is drawn reaches the driver.
    """
    want = {k: min(sample, n) for k, n in sizes.items()}
    spare = 1.0
    while True:
        rates = {k: spare * (m + 6 * math.sqrt(m) + 20) / max(sizes[k], 1) for k, m in want.items()}
        found = rows.mapInArrow(drawn_batches(trees, rates), f"tree int, good boolean, key long, {STATISTICS}").toArrow()
        stats, tree, good, key = matrix(found), found["tree"].to_numpy(), found["good"].to_numpy(), found["key"].to_numpy().view(U64)
        ordered = np.lexsort((*stats.T, key, good, tree))
        group = tree[ordered] * 2 + good[ordered]
        first = np.searchsorted(group, np.arange(2 * trees + 1))
        if all((np.diff(first)[int(k) :: 2] >= m).all() for k, m in want.items()):
            x = ratios(stats[ordered])
            return [(x[first[2 * t + 1] :][: want[True]], x[first[2 * t] :][: want[False]]) for t in range(trees)]
        spare *= 2


def leaf_batches(forest: IsolationForest):
    """mapInArrow function: statistics to (tree, node, n), how many of this task's rows end at each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.zeros(forest.path.shape, np.int64)
        for batch in batches:
            for t, node in enumerate(forest.leaves(ratios(matrix(batch)))):
                ends[t] += np.bincount(node, minlength=ends.shape[1])
        tree, node = np.nonzero(ends)
        yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(node.astype(np.int32)), pa.array(ends[tree, node])], ["tree", "node", "n"])

    return run


def score_batches(forest: IsolationForest):
    """mapInArrow function: (good, statistics) to good and the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.scores(ratios(matrix(batch))))], ["good", "score"])

    return run


def cut(held: DataFrame, spare: float = 0.001) -> float:
    """``threshold`` of rows (good, score), however many; without bad ones the score that passes all but ``spare`` of the good.

    Scores are put in order in ranges (``order.numbered``), and the driver sees one row for each range.
    """
    each = held.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    n = each.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if n.bad:
        # bad rows up to a score less good ones up to it: the rows misjudged there, but for a constant
        wrong = order.numbered(each, "score", value=F.col("bad") - F.col("good"))
        k = -wrong.agg(F.min(F.struct("total", (-F.col("score")).alias("down"))).alias("x")).first().x.down
        after = wrong.where(F.col("score") > k).agg(F.min("score").alias("score")).first().score
        return k + 1e-9 if after is None else (k + after) / 2
    passed = min(n.good - 1, math.ceil((1 - spare) * n.good))
    return order.numbered(each, "score", value=F.col("good")).where(F.col("total") > passed).agg(F.min("score").alias("score")).first().score + 1e-9


def train(ws: Workspace, stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", trees: int = 100, sample: int = 256, spare: float = 0.001) -> QualityModel:
    """A forest on half of all labelled rows' statistics (id and what ``statistics`` gives); its threshold is the best one on the other half.

    Rows that the base rule rejects have no part in either. The good rows are the reference and the bad ones say how
    far beyond it splits reach: each tree draws ``sample`` of both from all of that half, as isolation forests do, and
    its path lengths count all good rows of the half. The threshold misjudges the least of all held-out rows of both
    classes. Without bad rows it passes all but ``spare`` of the held-out good ones. A class of which one half is empty
    is in both whole. Halves and draws depend on hashes of the ids alone.

    Labels that are null or whose document is missing are left out; a document with several labels counts as good only
    if all say so. Without a good row that passes the base rule there is nothing to calibrate by, and the model keeps all.
    """
    said = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.min("quality") > 0).alias("good"))
    clean = stats.where("n_words >= 10 AND 100 * n_repeat_words <= 20 * n_words").join(said, "id")
    rows = ws.table(clean.select("good", F.xxhash64("id").alias("hash"), *COUNTS, *EXTRA), "labelled")
    n = {(r.good, r.later): r.n for r in rows.groupBy("good", (F.col("hash") < 0).alias("later")).agg(F.count("*").alias("n")).collect()}
    halves = {good: [n.get((good, False), 0), n.get((good, True), 0)] for good in (True, False)}
    if not sum(halves[True]):
        return QualityModel(None, 1.0)
    half = lambda later: F.when(F.col("good"), F.lit(not all(halves[True])) | ((F.col("hash") < 0) == later)).otherwise(F.lit(not all(halves[False])) | ((F.col("hash") < 0) == later))
    sizes = {good: x[0] if all(x) else sum(x) for good, x in halves.items()}
    reference = rows.where(half(False))
    forest = IsolationForest.grow(draws(reference, sizes, trees, sample), trees, min(sample, sizes[True]), np.random.default_rng(7))
    ends = np.zeros(forest.path.shape, np.int64)
    found = reference.where("good").mapInArrow(leaf_batches(forest), "tree int, node int, n long").groupBy("tree", "node").agg(F.sum("n").alias("n")).toArrow()
    ends[found["tree"].to_numpy(), found["node"].to_numpy()] = found["n"].to_numpy()
    forest = forest.counted(ends, sizes[True])
    model = QualityModel(forest, cut(rows.where(half(True)).drop("hash").mapInArrow(score_batches(forest), "good boolean, score double"), spare))
    ws.remove("labelled")
    return model


def measured(ws: Workspace, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The statistics of every text, written once: a few numbers a row, so that labels join them and not the texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return ws.table(rows.mapInArrow(statistics_batches, with_id(rows, STATISTICS)), "statistics")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rule statistics and verdicts for every document.

    Returns a row for each input row: the id, n_words, word_chars (code points in words), n_symbols (characters
    of ``#*$%&|<>``), n_dup_lines (lines with a word that equal an earlier one), n_repeat_words (words in 5-word
    windows found twice or more in the text), base_failed (under 10 words, or over a fifth of them repeated),
    score (of the isolation forest) and kept (false if base_failed, else whether the score is within the
    threshold calibrated on all labelled rows). A null text is empty, and so fails the base rule. Without labels
    nothing but the base rule rejects. Other columns are ignored, whatever their names.
    """
    ws = Workspace(docs.sparkSession, "quality")
    stats = measured(ws, docs, id_col, text_col)
    schema = with_id(stats, ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean")
    return stats.mapInArrow(verdict_batches(train(ws, stats, labels, id_col)), schema).withColumnRenamed("id", id_col)


def keep_batches(model: QualityModel, text: int):
    """mapInArrow function: the rows that the model keeps, whole; ``text`` is the number of their text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("quality")
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(text)):
                yield batch.slice(i, j - i).filter(pa.array(model.keeps(statistics(data, offsets))[1]))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that ``judge`` keeps, with all their columns."""
    ws = Workspace(docs.sparkSession, "quality")
    model = train(ws, measured(ws, docs, id_col, text_col), labels, id_col)
    ws.close()
    return docs.mapInArrow(keep_batches(model, docs.columns.index(text_col)), docs.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics of ``documents``, and which of them the forest fitted on ``labels`` keeps."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
