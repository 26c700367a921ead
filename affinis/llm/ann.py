"""Nearest neighbours by cosine with randomly rotated one-bit codes and exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textkernel import begin
from .workspace import Workspace, split_count

#: Bytes of vectors, and rows, that a task holds at a time; a cell of the index has no more, give or take the hash.
CELL_BYTES, LEAST_ROWS = 64 << 20, 4096
#: The signs of the eight bits of each byte.
SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1).T.copy()
ROW = "row long, vec_id long, dim int, vector array<double>, code binary, scale double"


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def measured(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and their lengths; those whose squares leave the range of a double are scaled first, which no cosine sees."""
    with np.errstate(over="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))
    odd = ~np.isfinite(norm) | (norm < 1e-150)
    if odd.any():
        x = x.copy()
        x[odd] /= np.abs(x[odd]).max(axis=1, keepdims=True)
        norm[odd] = np.sqrt((x[odd] * x[odd]).sum(axis=1))
    return x, norm


def encode_batches(seed: int):
    """mapInArrow function: (row, vec_id, dim, vector) to those with code and scale, lengths side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("one-bit")
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                if dim not in turns:
                    turns = {dim: rotation(int(dim), seed)}
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x, norm = measured(part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                turned = (x / norm[:, None]) @ turns[dim]
                codes = pa.array([c.tobytes() for c in np.packbits(turned > 0, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, codes, pa.array(np.abs(turned).sum(axis=1) / math.sqrt(dim))], [*part.schema.names, "code", "scale"])

    return run


class Cell:
    """The packed codes of some rows, byte by byte, and beside them the vectors for those that are reranked."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, x: np.ndarray, code: np.ndarray, scale: np.ndarray, width: float):
        self.row, self.id, self.dim = row, ids, x.shape[1]
        self.x, self.norm = measured(x)
        self.bytes, self.scale = np.ascontiguousarray(code.T), scale.astype(np.float32)
        self.error = (np.sqrt(np.maximum(1 - scale * scale, 0) / np.maximum(scale * scale * max(self.dim - 1, 1), 1e-12)) * width + 1e-5).astype(np.float32)
        self.reranked = 0

    def nearest(self, q: np.ndarray, turn: np.ndarray, row: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k nearest rows but ``row``, best first.

        The inner product of a unit vector and the unit query is about that of the code's signs and the turned query,
        divided by the code's own with its vector, ``scale``. It is read off the packed bits: for each byte of a code, a
        table has the share of that byte's eight signs. With c for the scale the error is within
        sqrt((1 - c * c) / (c * c * (dim - 1))) times ``width``, but for a probability that falls as exp(-width ** 2).
        What reaches the k-th best lower bound is reranked on the original components.
        """
        (q,), (length,) = measured(q[None])
        turned = np.zeros(8 * len(self.bytes), np.float32)
        turned[: self.dim] = (q / length) @ turn / math.sqrt(self.dim)
        tables = turned.reshape(-1, 8) @ SIGNS
        about = np.zeros(len(self.row), np.float32)
        for table, column in zip(tables, self.bytes, strict=True):
            about += table[column]
        about /= self.scale
        others = self.row != row
        low = np.where(others, about - self.error, -np.inf)
        least = -np.partition(-low, k - 1)[k - 1] if len(low) > k else -np.inf
        at = np.flatnonzero((about + self.error >= least) & others)
        self.reranked += len(at)
        scores = (q * self.x[at]).sum(axis=1) / (length * self.norm[at])
        best = np.lexsort((self.id[at], -scores))[:k]
        return self.id[at][best], scores[best]


def search_batches(k: int, seed: int, width: float):
    """mapInArrow function: rows of cells, each cell's indexed ones (kind 0) before its queries (kind 1), to (row, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("one-bit")
        cell, held, index, turn = None, [], None, np.empty((0, 0))
        for batch in batches:
            cells, kind, row, ids, dims, scale = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 3, 4, 7))
            edges = [0, *(np.flatnonzero((np.diff(cells) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(cells)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if cells[a] != cell:
                    cell, held, index = cells[a], [], None
                x = batch.column(5).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, dims[a])
                if kind[a] == 0:
                    code = np.frombuffer(b"".join(batch.column(6).slice(a, b - a).to_pylist()), np.uint8).reshape(b - a, -1)
                    held.append((row[a:b], ids[a:b], x, code, scale[a:b]))
                    continue
                if index is None:
                    index, held = Cell(*(np.concatenate(y) for y in zip(*held, strict=True)), width), []
                    turn = turn if len(turn) == dims[a] else rotation(int(dims[a]), seed)
                found = [(np.full(len(i), r), i, s) for q, r in zip(x, row[a:b], strict=True) for i, s in [index.nearest(q, turn, r, k)]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in zip(*found, strict=True)], ["row", "vec_id", "score"])

    return run


class OneBitIndex:
    """Codes of one bit a component for all usable vectors of a table, beside the vectors themselves.

    Vectors that are null, zero, or hold a null or a component that is not finite take no part, nor do rows without an id.
    Vectors of different lengths have no cosine: each length is a space of its own, and all are searched. Rows are dealt
    into cells by a hash, so copies of one vector do not meet; a cell is what a task holds at a time.
    """

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 11):
        rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
        finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda v: v != 0))
        self.spark, self.seed = vectors.sparkSession, seed
        self.ws = Workspace(self.spark, "one-bit")
        numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("vector").alias("dim"), "vector")
        self.codes = self.ws.table(numbered.mapInArrow(encode_batches(seed), ROW), "codes")
        fewest = F.least(F.lit(split_count(self.spark)), F.ceil(F.col("n") / LEAST_ROWS))
        sized = self.codes.groupBy("dim").agg(F.count("*").alias("n")).select("dim", F.greatest(F.ceil(F.col("n") * F.col("dim") * 8 / CELL_BYTES), fewest).alias("cells"))
        self.cells = self.ws.table(sized, "cells")

    def search(self, queries: DataFrame, k: int = 5, width: float = 3.0) -> DataFrame:
        """(query_id, rank, vec_id, score): the k nearest of each of ``queries`` (vec_id) that the index holds.

        A row is never its own neighbour; ties go to the smaller vec_id, and rows that share an id are compared one by
        one. Where the id of a query is several rows', the one whose vector is first in order asks. Every query meets
        every cell of its length in one job; each cell returns its k best.
        """
        asked = self.codes.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id")
        asked = self.ws.table(asked.groupBy("vec_id").agg(F.min(F.struct("vector", "row", "dim")).alias("x")).select("vec_id", "x.*"), f"queries-{k}-{width}")
        held = self.codes.join(self.cells, "dim").select(F.xxhash64("dim", F.pmod(F.xxhash64("row", F.lit(3)), F.col("cells"))).alias("cell"), F.lit(0).alias("kind"), "row", "vec_id", "dim", "vector", "code", "scale")
        sent = asked.join(self.cells, "dim").withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
        sent = sent.select(F.xxhash64("dim", "c").alias("cell"), F.lit(1).alias("kind"), "row", "vec_id", "dim", "vector", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("scale"))
        both = held.join(sent.select("cell").distinct(), "cell", "left_semi").unionByName(sent).repartition("cell").sortWithinPartitions("cell", "kind")
        found = both.mapInArrow(search_batches(k, self.seed, width), "row long, vec_id long, score double")
        order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return best.join(asked.select("row", F.col("vec_id").alias("query_id")), "row").select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest others of each of the stated queries in ``embeddings``: rows whose vec_id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return OneBitIndex(vectors).search(vectors.where("vec_id % 50 = 0"))
