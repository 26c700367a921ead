"""Byte-level BPE: encoding with a segment tree over adjacent pair ranks, and decoding."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import begin, chunks, long_lists
from .tokens import ENCODED_BYTES, UnitCache, splits_at_spaces

#: The pre-tokenizer of byte-level files (its published pattern).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A leaf without a mergeable pair.
NONE = np.iinfo(np.int64).max
#: Leaves of all trees that are worked on together, and the height of those that are; higher ones are worked on alone.
TREE_LEAVES, SIDE_BY_SIDE = 1 << 19, 8

_codecs: dict[str, Codec] = {}


def byte_characters() -> list[str]:
    """The printable character by which byte-level files write each byte: itself, or one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Codec:
    """Encoder and decoder of one byte-level file; keeps the ids of pieces that it has met."""

    def __init__(self, path: str):
        if not splits_at_spaces(path):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        with open(path, encoding="utf-8") as f:
            top = json.load(f)
        vocabulary, merges = top["model"]["vocab"], top["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        characters = byte_characters()
        as_byte = {c: bytes([b]) for b, c in enumerate(characters)}
        self.byte_ids = np.array([vocabulary[c] for c in characters], np.int64)
        left, right, joined = (np.array([vocabulary[x] for x in column], np.int64) for column in zip(*((a, b, a + b) for a, b in merges), strict=True))
        self.shift = int(max(vocabulary.values())).bit_length()
        keys = left << self.shift | right
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks, self.joined = keys[order], order, joined
        made = np.full(1 << self.shift, -1)
        made[joined[::-1]] = np.arange(len(joined))[::-1]
        self.in_order = bool((np.maximum(made[left], made[right]) < np.arange(len(joined))).all())
        self.special = {t["content"]: t["id"] for t in top.get("added_tokens") or []}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(PATTERN)
        words: dict[int, bytes] = {i: b"".join(as_byte.get(c, c.encode()) for c in t) for t, i in vocabulary.items()}
        words |= {i: t.encode() for t, i in self.special.items()}
        pieces = [words.get(i, b"") for i in range(max(words) + 1)]
        self.piece_at = np.cumsum([0, *map(len, pieces)])
        self.pieces = np.frombuffer(b"".join(pieces), np.uint8)
        self.cache = UnitCache(self.make)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it does not merge."""
        keys = left << self.shift | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece. Pieces with as many leaves are merged side by side, one merge of each at a time."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sizes = np.array([max(1, int(n - 1).bit_length()) for n in lengths.tolist()])
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            if self.in_order and size > SIDE_BY_SIDE:
                for r in rows.tolist():
                    out[r] = self._merge_long(words[r])
                continue
            step = max(1, TREE_LEAVES >> int(size))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for r, ids in zip(part.tolist(), self._merge_rows([words[r] for r in part.tolist()], lengths[part], 1 << int(size)), strict=True):
                    out[r] = ids
        return out

    def _merge_rows(self, words: list[bytes], lengths: np.ndarray, leaves: int) -> list[np.ndarray]:
        n = len(words)
        inside = np.arange(leaves) < lengths[:, None]
        symbols = np.zeros((n, leaves), np.int64)
        symbols[inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after = np.broadcast_to(np.arange(1, leaves + 1), (n, leaves)).copy()
        before = after - 2
        tree = np.full((n, 2 * leaves), NONE, np.int64)
        pairs = inside[:, 1:]
        leaf = np.full((n, leaves), NONE, np.int64)
        ranks = self.ranks(symbols[:, :-1][pairs], symbols[:, 1:][pairs])
        at = np.nonzero(pairs)
        leaf[at] = np.where(ranks == NONE, NONE, ranks * leaves + at[1])
        tree[:, leaves:] = leaf
        width = leaves
        while width > 1:
            tree[:, width // 2 : width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
            width //= 2
        alive = inside.copy()
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            rank, at = np.divmod(tree[rows, 1], leaves)
            gone = after[rows, at]
            then = after[rows, gone]
            symbols[rows, at] = self.joined[rank]
            after[rows, at] = then
            alive[rows, gone] = False
            follows = then < lengths[rows]
            before[rows[follows], then[follows]] = at[follows]
            self._set(tree, leaves, rows, gone, np.full(len(rows), NONE))
            value = np.full(len(rows), NONE)
            f = rows[follows]
            found = self.ranks(symbols[f, at[follows]], symbols[f, then[follows]])
            value[follows] = np.where(found == NONE, NONE, found * leaves + at[follows])
            self._set(tree, leaves, rows, at, value)
            p = before[rows, at]
            leads = p >= 0
            r, p = rows[leads], p[leads]
            found = self.ranks(symbols[r, p], symbols[r, at[leads]])
            self._set(tree, leaves, r, p, np.where(found == NONE, NONE, found * leaves + p))
            rows = rows[tree[rows, 1] != NONE]
        return np.split(symbols[alive], np.cumsum(alive.sum(axis=1))[:-1])

    def _merge_long(self, word: bytes) -> np.ndarray:
        """Ids of a long piece: all merges of the lowest rank at once, found from the root of its tree downwards.

        A merge makes pairs of higher ranks only, because parts come before what they are joined to; so those of one
        rank are all made before any other, from left to right. Of pairs that overlap every other one is made.
        """
        n = len(word)
        leaves = 1 << max(1, (n - 1).bit_length())
        symbols = np.zeros(leaves + 1, np.int64)
        symbols[:n] = self.byte_ids[np.frombuffer(word, np.uint8)]
        after, before = np.arange(1, leaves + 2), np.arange(-1, leaves)
        alive = np.arange(leaves + 1) < n
        tree = np.full(2 * leaves, NONE, np.int64)
        tree[leaves : leaves + n - 1] = self.ranks(symbols[: n - 1], symbols[1:n])
        width = leaves
        while width > 1:
            tree[width // 2 : width] = np.minimum(tree[width : 2 * width : 2], tree[width + 1 : 2 * width : 2])
            width //= 2
        while (rank := tree[1]) != NONE:
            nodes = np.ones(1, np.int64)
            while nodes[0] < leaves:
                nodes = np.repeat(2 * nodes, 2)
                nodes[1::2] += 1
                nodes = nodes[tree[nodes] == rank]
            at = nodes - leaves
            follows = np.concatenate([[False], at[1:] == after[at[:-1]]])
            if follows.any():
                number = np.arange(len(at))
                at = at[(number - np.maximum.accumulate(np.where(follows, 0, number))) % 2 == 0]
            gone = after[at]
            then = after[gone]
            symbols[at] = self.joined[rank]
            after[at], before[then], alive[gone] = then, at, False
            lead = before[at]
            changed = np.unique(np.concatenate([at, lead[lead >= 0]]))
            value = np.full(len(changed), NONE)
            inside = after[changed] < n
            value[inside] = self.ranks(symbols[changed[inside]], symbols[after[changed[inside]]])
            tree[leaves + changed], tree[leaves + gone] = value, NONE
            nodes = np.unique(np.concatenate([changed, gone]) + leaves) >> 1
            while nodes[0]:
                nodes = nodes[np.diff(nodes, prepend=-1) > 0]
                tree[nodes] = np.minimum(tree[2 * nodes], tree[2 * nodes + 1])
                nodes = nodes >> 1
        return symbols[alive]

    @staticmethod
    def _set(tree: np.ndarray, leaves: int, rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        """Sets one leaf of each row's tree and the minima above it."""
        node = at + leaves
        tree[rows, node] = value
        node = node >> 1
        while leaves > 1:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1
            leaves >>= 1

    def make(self, units: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(order, all ids, number of ids) of units, in the order given."""
        names: dict[str | int, int] = {}
        pieces: list[int] = []
        numbers = np.zeros(len(units), np.int64)
        for u, text in enumerate(units):
            plan: list = []
            at = 0
            for m in self.special_pattern.finditer(text) if self.special_pattern else ():
                plan += self.pattern.findall(text[at : m.start()])
                plan.append(self.special[m[0]])
                at = m.end()
            plan += self.pattern.findall(text[at:] if at else text)
            numbers[u] = len(plan)
            pieces += [names.setdefault(x, len(names)) for x in plan]
        words = [x for x in names if isinstance(x, str)]
        merged = dict(zip(words, self.merge([w.encode() for w in words]), strict=True))
        ids = [merged[x] if isinstance(x, str) else np.array([x]) for x in names]
        lengths = np.array([len(x) for x in ids], np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths[pieces])])
        last = np.cumsum(numbers)
        flat = np.concatenate([ids[k] for k in pieces]) if pieces else np.empty(0)
        return list(range(len(units))), flat.astype(np.int32), ends[last] - ends[last - numbers]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a run of ids; ids outside the vocabulary have none."""
        ids = ids[(ids >= 0) & (ids < len(self.piece_at) - 1)]
        starts, lengths = self.piece_at[ids], self.piece_at[ids + 1] - self.piece_at[ids]
        ends = np.cumsum(lengths)
        return self.pieces[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_batches(path: str):
    """mapInArrow function: (id, text) to (id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("bpe", _codecs.clear)
        encode = codec(path).cache.encode
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1), ENCODED_BYTES):
                ids, lengths = encode(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), long_lists(ids, lengths, pa.int32())], ["id", "ids"])

    return run


def decode_batches(path: str):
    """mapInArrow function: (id, ids) to (id, ids, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path).decode
        for batch in batches:
            lists = batch.column(1)
            bounds, values = lists.offsets.to_numpy().tolist(), lists.values.fill_null(-1).to_numpy().astype(np.int64)
            texts = [decode(values[a:b]).decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], ["id", "ids", "text"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every whole text, as the tokenizers library gives them without added tokens.

    The root of a segment tree over the ranks of adjacent pairs is the leftmost pair of lowest rank; merging it
    updates three leaves and what is above them, until no pair merges. Pieces of over 256 bytes make all merges of the
    lowest rank at once. A worker merges each distinct piece once as long as it remembers it. Special strings inside a text are special tokens. Null is empty
    and has no ids. A row for each input row; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode_batches(path), f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text): the text that the ids stand for, special tokens included; bytes that are no UTF-8 become U+FFFD.

    A null list is empty; null and unknown ids stand for nothing.
    """
    rows = tokens.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(decode_batches(path), f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, text string").withColumnRenamed("id", id_col)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of ``documents`` under the 50k byte-level BPE, and of the texts decoded from them."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2(F.col("text"), 256).alias("decoded_sha256"))
