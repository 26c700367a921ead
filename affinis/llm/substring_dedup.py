"""Removal of passages that occur elsewhere too, by a log-structured index of window fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import U64, WORDS, Words, begin, chunks, gram_hashes, long_lists, sliding_min, splitmix
from .workspace import Folder, Workspace, with_id

#: Words of the short runs that stand for the windows which contain them.
GRAM = 8
#: Bits of a gram's hash that decide which gram stands for a window; the rest hold its place.
PLACE_BITS = 30


def anchors(words: np.ndarray, others: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(h, g, first, count) of each anchor of a text, given its words' hashes of one family and of the other.

    A window's anchor is the run of ``gram`` words inside it with the least hash, the leftmost of equal ones.
    It depends on the window's words alone, so equal windows have equal anchors, wherever they stand. An
    anchor stands for ``count`` windows, from the one that starts at word ``first``; h is the hash of its words
    and g that of all words which those windows cover, by the other family.
    """
    grams = gram_hashes(words, gram)
    places = np.arange(len(grams), dtype=U64)
    least = sliding_min((grams >> U64(PLACE_BITS) << U64(PLACE_BITS)) | places, window - gram + 1)
    at = (least & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    count = np.diff(first, append=len(at))
    up, down = WORDS.get(len(words) + 1)
    sums = np.zeros(len(words) + 1, U64)
    np.cumsum(others * up[: len(words)], out=sums[1:])
    g = splitmix((sums[first + count + window - 1] - sums[first]) * down[first] + count.astype(U64))
    return grams[at[first]], g, first, count


def anchor_batches(window: int, gram: int):
    """mapInArrow function: (k1, k2, text) to (k1, k2, h, g, first, count), lists of its anchors' values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("substring")
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(2)):
                found = Words(data, offsets)
                hashes, others, first = found.hashes(), found.hashes(family=1), found.first
                lists, lengths = [], np.zeros(j - i, np.int64)
                for r in range(j - i):
                    if first[r + 1] - first[r] >= window:
                        lists.append(anchors(hashes[first[r] : first[r + 1]], others[first[r] : first[r + 1]], window, gram))
                        lengths[r] = len(lists[-1][0])
                if lists:
                    h, g, at, count = (np.concatenate(x) for x in zip(*lists, strict=True))
                    keep = lengths > 0
                    rows = [batch.column(c).slice(i, j - i).filter(pa.array(keep)) for c in (0, 1)]
                    n = lengths[keep]
                    yield pa.RecordBatch.from_arrays([*rows, long_lists(h, n), long_lists(g, n), long_lists(at.astype(np.int32), n), long_lists(count.astype(np.int32), n)], ["k1", "k2", "h", "g", "first", "count"])

    return run


def window_batches(window: int):
    """mapInArrow function: (k1, k2, text, parts) to (k1, k2, h, w, start) of each window in the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("substring")
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            parts = batch.column(3)
            bounds = parts.offsets.to_numpy()
            h, first, count = (parts.values.field(c).to_numpy(zero_copy_only=False) for c in ("h", "first", "count"))
            for i, j, data, offsets in chunks(batch.column(2)):
                found = Words(data, offsets)
                hashes, at = found.hashes(family=1), found.first
                out = []
                for r in range(j - i):
                    windows = gram_hashes(hashes[at[r] : at[r + 1]], window)
                    a, b = bounds[i + r], bounds[i + r + 1]
                    n = count[a:b].astype(np.int64)
                    total = int(n.sum())
                    starts = np.repeat(first[a:b] - (np.cumsum(n) - n), n) + np.arange(total)
                    out.append((np.full(total, k1[i + r]), np.full(total, k2[i + r]), np.repeat(h[a:b], n), windows[starts].view(np.int64), starts.astype(np.int32)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["k1", "k2", "h", "w", "start"])

    return run


def covered(n_words: int, window: int, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which words are covered by runs of ``count`` windows from ``first``."""
    marks = np.zeros(n_words + 1, np.int32)
    np.add.at(marks, first, 1)
    np.add.at(marks, first + count + window - 1, -1)
    return np.cumsum(marks[:-1]) > 0


def kept_batches(window: int):
    """mapInArrow function: (id, text, repeats) to (id, n_words, n_removed, spans, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("substring")
        for batch in batches:
            repeats = batch.column(2)
            at = repeats.offsets.to_numpy()
            first, count = (repeats.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "count"))
            for i, j, data, offsets in chunks(batch.column(1)):
                ids, n_words, n_removed, spans, kept = batch.column(0).slice(i, j - i), [], [], [], []
                for r in range(j - i):
                    words = data[offsets[r] : offsets[r + 1]].tobytes().split()
                    gone = covered(len(words), window, first[(a := at[i + r]) : (b := at[i + r + 1])], count[a:b])
                    n_words.append(len(words))
                    n_removed.append(int(gone.sum()))
                    if n_removed[-1]:
                        edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                        spans.append(edges)
                        words = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                    else:
                        spans.append(np.empty(0, np.int64))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "spans", "kept"])

    return run


def keyed(docs: DataFrame, text: Column) -> DataFrame:
    """docs with k1 and k2, 128 bits that stand for the text."""
    return docs.withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)})


class FingerprintIndex:
    """A log-structured index of the windows of all documents that were appended.

    Each batch leaves an immutable run, sorted by fingerprint: h, the hash of an anchor (see ``anchors``); n,
    its occurrences; g, a hash of what its windows cover, and mixed, whether that differs between occurrences.
    An index of a workspace goes with the process; ``open`` gives one that lasts, for the batches of later jobs.
    A window's anchor is in the index exactly if the window is, so no window is lost although only one gram in
    about fourteen words is kept. Runs are merged when there are more than ``most_runs``.
    """

    def __init__(self, ws: Workspace, window: int = 35, gram: int = GRAM, most_runs: int = 4):
        if gram > window:
            raise ValueError("gram must not be longer than window")
        self.ws, self.window, self.gram, self.most_runs = ws, window, gram, most_runs
        self.runs: dict[str, DataFrame] = {}
        self.batches: list[tuple[DataFrame, DataFrame]] = []
        self.made = self.judged = self.number = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, **given: int) -> FingerprintIndex:
        """The index that is kept under a folder, or a new one to be kept there.

        Its runs, its batches with their texts, and a manifest for each change stay in the folder. A manifest names what is
        in force and counts once it is whole, so an append that dies changes nothing.
        """
        ws = Folder(spark, path)
        numbers = [int(n[9:]) for n in ws.names() if n.startswith("manifest-")]
        last = ws.read(f"manifest-{max(numbers):06d}").first() if numbers else None
        index = cls(ws, **({"window": last["window"], "gram": last["gram"], "most_runs": last["most_runs"]} if last else given))
        index.number = max(numbers, default=0)
        if last:
            index.made = last["made"]
            index.runs = {name: ws.read(name) for name in last["runs"]}
            index.batches = [(ws.read(f"batch{k}"), ws.read(f"postings{k}")) for k in range(last["batches"])]
        return index

    def _kept(self) -> None:
        """Writes the manifest of a lasting index, then removes runs that neither it nor the one before names."""
        if not isinstance(self.ws, Folder):
            return
        self.number += 1
        row = (list(self.runs), len(self.batches), self.made, self.window, self.gram, self.most_runs)
        self.ws.table(self.ws.spark.createDataFrame([row], "runs array<string>, batches int, made int, window int, gram int, most_runs int").coalesce(1), f"manifest-{self.number:06d}")
        before = f"manifest-{self.number - 1:06d}"
        names = self.ws.names()
        named = {*self.runs, *(self.ws.read(before).first()["runs"] if before in names else [])}
        for name in names:
            if (name.startswith("run") and name not in named) or (name.startswith("manifest-") and name < before):
                self.ws.remove(name)

    def _run(self, rows: DataFrame) -> None:
        self.made += 1
        name = f"run{self.made}"
        self.runs[name] = self.ws.table(rows.sortWithinPartitions("h"), name)

    def append(self, docs: DataFrame) -> None:
        """Adds a batch (id, text); its texts are read again when it is judged."""
        docs = keyed(docs, F.col("text"))
        if isinstance(self.ws, Folder):
            docs = self.ws.table(docs, f"batch{len(self.batches)}")
        lists = docs.select("k1", "k2", "text").mapInArrow(anchor_batches(self.window, self.gram), "k1 long, k2 long, h array<long>, g array<long>, first array<int>, count array<int>")
        postings = self.ws.table(lists, f"postings{len(self.batches)}")
        self.batches.append((docs, postings))
        each = postings.select(F.explode(F.arrays_zip("h", "g")).alias("x")).select("x.h", "x.g")
        self._run(each.groupBy("h").agg(F.count("*").alias("n"), F.min("g").alias("g"), (F.min("g") != F.max("g")).alias("mixed")))
        if len(self.runs) > self.most_runs:
            self.compact()
        self._kept()

    def merged(self) -> DataFrame:
        """One row for each fingerprint in any run."""
        runs = list(self.runs.values())
        if len(runs) == 1:
            return runs[0]
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out.groupBy("h").agg(F.sum("n").alias("n"), F.min("g").alias("g"), (F.max("mixed") | (F.min("g") != F.max("g"))).alias("mixed"))

    def compact(self) -> None:
        """Merges all runs into one."""
        if len(self.runs) < 2:
            return
        old = list(self.runs)
        merged = self.merged()
        self.runs = {}
        self._run(merged)
        if not isinstance(self.ws, Folder):
            for name in old:
                self.ws.remove(name)

    def judge(self, batch: int | None = None) -> DataFrame:
        """(id, n_words, n_removed, spans, kept) of the rows of a batch, or of all, against all that was appended.

        The batch's anchors are merge-joined with the runs. Occurrences of a repeated anchor whose windows all
        read alike are settled there. Those of the others are put into classes that read alike: a class of more than
        one is settled too, and only one occurrence of each class has its text read again and its windows compared with
        the other classes', by hashes of all their words, of the second family, beside that of their anchor, of the
        first: 124 bits in all. Of other batches only postings and texts with such an anchor are looked at.
        """
        self.judged += 1
        ws, window, tag = self.ws, self.window, self.judged
        repeated = self.merged().where("n > 1").select("h", "mixed")
        each = self._each(self.batches if batch is None else [self.batches[batch]])
        found = each.join(repeated, "h")
        if batch is not None and len(self.batches) > 1:
            found = ws.table(found, f"found-{tag}")
            asked_for = found.where("mixed").select("h").distinct()
            history = self._each([b for k, b in enumerate(self.batches) if k != batch]).join(asked_for, "h")
            found = found.unionByName(history.withColumn("mixed", F.lit(True)))
        run = F.struct("first", "count")
        hits = found.groupBy("k1", "k2").agg(
            F.collect_set(F.when(~F.col("mixed"), run)).alias("sure"), F.collect_set(F.when(F.col("mixed"), F.struct("h", "g", "first", "count"))).alias("parts"), F.count_if("mixed").alias("n")
        )
        hits = ws.table(hits, f"hits-{tag}")
        # every copy of a text has each of its parts, so n is a multiple of theirs
        parts = hits.where(F.size("parts") > 0).select("k1", "k2", F.expr("n div size(parts)").alias("copies"), F.inline("parts"))
        classes = ws.table(parts.groupBy("h", "g").agg(F.sum("copies").alias("n"), F.min(F.struct("k1", "k2", "first", "count")).alias("lead")), f"classes-{tag}")
        alike = parts.join(classes.where("n > 1").select("h", "g"), ["h", "g"]).select("k1", "k2", "first", "count")
        leads = classes.select("h", "lead.*").groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "first", "count")).alias("parts"))
        docs = self._union([d for d, _ in self.batches])
        texts = docs.select("k1", "k2", "text").join(leads, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
        windows = ws.table(texts.mapInArrow(window_batches(window), "k1 long, k2 long, h long, w long, start int"), f"windows-{tag}")
        twice = windows.groupBy("h", "w").agg(F.count("*").alias("n")).where("n > 1").select("h", "w")
        single = windows.join(twice, ["h", "w"]).select("k1", "k2", F.col("start").alias("first"), F.lit(1).alias("count"))
        more = alike.unionByName(single).groupBy("k1", "k2").agg(F.collect_list(run).alias("more"))
        none = F.array().cast("array<struct<first:int,count:int>>")
        spans = hits.select("k1", "k2", "sure").join(more, ["k1", "k2"], "left").select("k1", "k2", F.concat("sure", F.coalesce("more", none)).alias("repeats"))
        spans = ws.table(spans, f"verdict-{tag}")
        asked = docs if batch is None else self.batches[batch][0]
        rows = asked.join(spans, ["k1", "k2"], "left").select("id", "text", F.coalesce("repeats", none).alias("repeats"))
        return rows.mapInArrow(kept_batches(window), with_id(rows, "n_words long, n_removed long, spans array<long>, kept string"))

    def _each(self, batches: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
        """(k1, k2, h, g, first, count) of each anchor in the batches."""
        postings = self._union([p for _, p in batches])
        return postings.select("k1", "k2", F.explode(F.arrays_zip("h", "g", "first", "count")).alias("x")).select("k1", "k2", "x.h", "x.g", "x.first", "x.count")

    @staticmethod
    def _union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for x in frames[1:]:
            out = out.unionByName(x)
        return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, batches: int = 3) -> DataFrame:
    """Removes every word that a repeated window of ``window`` consecutive words covers.

    Returns a row for each input row: the id, n_words, n_removed, spans (first word, word after the last, and so
    on, of what was removed) and kept (the other words, joined by one space). Words are runs of characters other
    than ASCII white space, unchanged; a window is repeated if its words also start anywhere else, in the same
    text or another. Windows are judged on the input, so every copy goes. A null text is empty; texts shorter
    than a window keep all words. Rows are told apart by their texts, so ids may be null or repeat; an equal row
    counts as another text. Other columns are ignored, whatever their names.

    The rows go into the index in ``batches``, each of which leaves a sorted run; runs are compacted when there are more
    than two. All are judged at the end, since a window of an early batch may be repeated by a late one.
    """
    index = FingerprintIndex(Workspace(docs.sparkSession, "substring-dedup"), window=window, gram=min(GRAM, window), most_runs=2)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for k in range(batches):
        index.append(rows.where(F.pmod(F.xxhash64("text"), F.lit(batches)) == k))
    return index.judge().withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, text_col: str = "text", window: int = 35) -> DataFrame:
    """docs with ``remove_repeats`` applied to their texts; rows of which nothing is left go, other columns stay.

    A text without a repeated window is left exactly as it is, white space included.
    """
    places = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.select(F.struct(*(F.col(f"`{c}`").alias(p) for c, p in zip(docs.columns, places, strict=True))).alias("row"), F.col(text_col).alias("text"))
    out = remove_repeats(rows, "row", "text", window)
    text = lambda p: F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(f"row.{p}"))
    return out.where("n_removed = 0 or n_removed < n_words").select(*(text(p).alias(c) if c == text_col else F.col(f"row.{p}").alias(c) for c, p in zip(docs.columns, places, strict=True)))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` left when every repeated window of 35 words is removed."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
