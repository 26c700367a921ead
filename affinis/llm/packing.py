"""Packing of token pieces into sequences of a fixed length, by best fit and swap-based local search."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textkernel import begin, chunks
from .tokens import ENCODED_BYTES, encoder, forget
from .workspace import Workspace

def pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole sequences, after what is left over."""
    rest = n % size
    return ([(0, rest)] if rest else []) + [(s, size) for s in range(rest, n, size)]


def piece_batches(path: str, size: int, end_id: int):
    """mapInArrow function: (id, text) to (id, piece, start, length, crc, part, nth).

    nth numbers the pieces of equal length within this task, and part is the task's number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("tokens", forget)
        encode, seen, part = encoder(path).encode, np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1), ENCODED_BYTES):
                rows: list[tuple] = []
                found, lengths = encode(data, offsets)
                held, at = found.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(lengths) * 4]).tolist()
                for r in range(j - i):
                    ids = held[at[r] : at[r + 1]] + end
                    for k, (start, length) in enumerate(pieces(len(ids) // 4, size)):
                        rows.append((r, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), seen[length]))
                        seen[length] += 1
                if rows:
                    r, *others = zip(*rows, strict=True)
                    columns = [pa.array(x, pa.int64()) for x in others]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(r)), pa.array(others[0], pa.int32()), *columns[1:4], pa.array([part] * len(rows), pa.int32()), columns[4]], ["id", "piece", "start", "length", "crc", "part", "nth"])

    return run


Bin = tuple[int, ...]


def best_fit(counts: dict[int, int], size: int) -> Counter[Bin]:
    """Bins of the given numbers of lengths, as patterns with how often each is used.

    Each pattern starts with the longest length left and takes the longest that fits, and is used as often as the
    counts allow; so there are hardly more patterns than lengths, whatever the counts.
    """
    left, out = {x: n for x, n in counts.items() if n > 0}, Counter()
    while left:
        room, pattern, used = size, [], Counter()
        while fits := [x for x in left if x <= room and left[x] > used[x]]:
            x = max(fits)
            k = min(room // x, left[x] - used[x])
            pattern += [x] * k
            used[x] += k
            room -= x * k
        times = min(left[x] // k for x, k in used.items())
        out[tuple(pattern)] += times
        for x, k in used.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
    return out


def _without(b: Bin, gone: tuple[int, ...]) -> Bin:
    rest = list(b)
    for x in gone:
        rest.remove(x)
    return tuple(rest)


class Receivers:
    """Underfull bins by what they can give back, no length, one or two, and by the room that they have.

    ``held[k][s]`` maps a room to the bins with that room and k lengths of sum s; ``rooms[k][s]`` has a bit for each
    such room, so the most room up to a bound is found at once.
    """

    def __init__(self, size: int):
        self.size = size
        self.held: tuple[dict, ...] = ({}, {}, {})
        self.rooms: tuple[dict[int, int], ...] = ({}, {}, {})

    def options(self, b: Bin) -> Iterator[tuple[int, int]]:
        yield 0, 0
        kinds = sorted(set(b))
        for x in kinds:
            yield 1, x
        yield from {(2, y + z) for i, y in enumerate(kinds) for z in kinds[i:] if y != z or b.count(y) > 1}

    def add(self, b: Bin) -> None:
        room = self.size - sum(b)
        for k, s in self.options(b):
            self.held[k].setdefault(s, {}).setdefault(room, {})[b] = None
            self.rooms[k][s] = self.rooms[k].get(s, 0) | 1 << room

    def drop(self, b: Bin) -> None:
        room = self.size - sum(b)
        for k, s in self.options(b):
            there = self.held[k][s]
            del there[room][b]
            if not there[room]:
                del there[room]
                self.rooms[k][s] ^= 1 << room
                if not there:
                    del self.held[k][s], self.rooms[k][s]

    def reach(self, k: int, most: int) -> tuple[list[int], list[int], list[int]]:
        """Sums s in order of which each takes a larger s + room than all smaller ones, that reach, and the room."""
        mask, far, out = (2 << most) - 1, 0, ([], [], [])
        for s in sorted(self.rooms[k]):
            room = (self.rooms[k][s] & mask).bit_length() - 1
            if room > 0 and s + room > far:
                far = s + room
                for column, value in zip(out, (s, far, room), strict=True):
                    column.append(value)
        return out


def _exchange(donor: Bin, receivers: Receivers) -> tuple[Bin, tuple[int, ...], tuple[int, ...]] | None:
    """Of all exchanges with all bins at least as full, one that fills its bin most: (bin, what it gets, what it gives).

    One document moves, is exchanged for one or for two shorter ones, or two are for one shorter than both. The least
    sum given back that leaves room for what comes is the largest gain, so each receiver need not be looked at.
    """
    give = sorted(set(donor), reverse=True)
    twos = [(x, y) for i, x in enumerate(give) for y in give[i:] if x != y or donor.count(x) > 1]
    best: tuple[int, tuple[int, ...], int, int, int] | None = None
    for k, options in ((0, [(x,) for x in give]), (1, [(x,) for x in give] + twos), (2, [(x,) for x in give])):
        sums, far, rooms = receivers.reach(k, receivers.size - sum(donor))
        for x in options:
            at = bisect_left(far, sum(x))
            if at < len(far) and sums[at] < sum(x) and (best is None or sum(x) - sums[at] > best[0]):
                best = (sum(x) - sums[at], x, k, sums[at], rooms[at])
    if best is None:
        return None
    _, x, k, s, room = best
    other = next(iter(receivers.held[k][s][room]))
    back = () if k == 0 else (s,) if k == 1 else next((y, s - y) for y in sorted(set(other)) if s - y in other and (2 * y != s or other.count(y) > 1))
    return other, x, back


def local_search(bins: Counter[Bin], size: int) -> Counter[Bin]:
    """Exchanges documents between underfull bins until no bin has an exchange left or no bin can empty.

    The donor is the emptiest bin; it gives to bins at least as full, so each step adds to the sum of squared fills
    and the search ends. Bins of one pattern are changed together, as many as both patterns have, so the work depends
    on the number of patterns. Donors without an exchange are tried again after other bins have changed.
    """
    bins = Counter(bins)
    number, least = sum(bins.values()), -(-sum(sum(b) * n for b, n in bins.items()) // size)
    receivers = Receivers(size)
    todo: list[tuple[int, Bin]] = []
    for b in bins:
        if sum(b) < size:
            receivers.add(b)
            todo.append((sum(b), b))
    heapify(todo)
    changed, stuck = False, set()
    while number > least:
        if not todo:
            if not changed:
                break
            todo, changed, stuck = [(sum(b), b) for b in bins if sum(b) < size], False, set()
            heapify(todo)
            continue
        _, donor = heappop(todo)
        if donor not in bins or donor in stuck:
            continue
        if bins[donor] == 1:
            receivers.drop(donor)
        found = _exchange(donor, receivers)
        if bins[donor] == 1:
            receivers.add(donor)
        if found is None:
            stuck.add(donor)
            continue
        other, x, y = found
        changed = True
        times = bins[donor] // 2 if other == donor else min(bins[donor], bins[other])
        for old in (donor, other):
            bins[old] -= times
            if not bins[old]:
                del bins[old]
                receivers.drop(old)
            elif old == donor:
                heappush(todo, (sum(old), old))
        for new in (tuple(sorted(_without(donor, x) + y, reverse=True)), tuple(sorted(_without(other, y) + x, reverse=True))):
            if not new:
                number -= times
                continue
            if new not in bins and sum(new) < size:
                receivers.add(new)
                heappush(todo, (sum(new), new))
            bins[new] += times
    return bins


class Plan:
    """Where the nth piece of each length goes: runs of pieces that fill runs of bins at one offset."""

    def __init__(self, bins: Counter[Bin]):
        rows, used, self.bins = [], Counter(), 0
        for b in sorted(bins, reverse=True):
            at = 0
            for x in b:
                rows.append((x, used[x], self.bins, at))
                used[x] += bins[b]
                at += x
            self.bins += bins[b]
        rows.sort()
        self.length, self.nth, self.bin, self.at = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 4

    def place(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = 1 << 48
        at = np.searchsorted(self.length * shift + self.nth, length * shift + nth, "right") - 1
        return self.bin[at] + nth - self.nth[at], self.at[at]


def place_batches(plan: Plan):
    """mapInArrow function: (id, piece, start, length, crc, nth) with nth over all pieces of a length, to its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, at = plan.place(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins), pa.array(at)], ["id", "piece", "start", "length", "crc", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs the token ids of all documents into sequences of at most ``size``.

    A document is the ids of its text, by the tokenizers library without added special tokens, and ``end_id``. One
    that is longer than a sequence is cut into whole sequences and a first piece of what is left over. Returns a
    row for each piece: the id, piece (from 0), start (ids of the document before it), length, ids_crc32 (of its
    ids as unsigned little-endian 32-bit integers), sequence_id and offset (place in the sequence; sequences have
    no gaps). A null text is empty and leaves its ``end_id`` alone. Each input row is a document, whatever its id;
    other columns are ignored, whatever their names.

    Whole sequences stand alone. Of the others only the numbers of each length reach the driver, ``size`` - 1 at
    most; best fit and local search make patterns of them, and the nth piece of a length takes the nth place that
    the patterns have for it. Pieces are numbered within the task that made them, plus what earlier tasks made.
    """
    ws = Workspace(docs.sparkSession, "packing")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, crc long"
    cut = ws.table(rows.mapInArrow(piece_batches(path, size, end_id), f"{schema}, part int, nth long"), "pieces")
    open_pieces = cut.where(F.col("length") < size)
    made = ws.table(open_pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "made")
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(local_search(best_fit(counts, size), size))
    earlier = made.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("earlier"))
    numbered = open_pieces.join(earlier, ["length", "part"]).select("id", "piece", "start", "length", "crc", (F.col("nth") + F.col("earlier")).alias("nth"))
    placed = numbered.mapInArrow(place_batches(plan), f"{schema}, sequence_id long, offset long")
    whole = cut.where(F.col("length") == size).select("id", "piece", "start", "length", "crc", (F.lit(plan.bins) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(whole).withColumnsRenamed({"id": id_col, "crc": "ids_crc32"})


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` packed into sequences of 1024 tokens of the 50k byte-level BPE."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
