"""Tokenizer files, and texts cut where no token can cross.

The path of a tokenizer file is a parameter everywhere; files ending in .json are read by ``tokenizers``, those
ending in .model by ``sentencepiece``. Nothing is trained.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Units that a Python worker remembers before it forgets the rarer ones (about 300 bytes each), and bytes of them.
MOST_UNITS, MOST_BYTES = 450_000, 36 << 20
#: Bytes of texts that are encoded together; a longer text is encoded alone.
ENCODED_BYTES = 2 << 20
#: Characters of new units that the library encodes as one text.
JOINED = 1 << 18
#: A unit that begins with its only white space, a space.
_LONE = re.compile(" [^\\s\u180e]+")
_ENDS = np.zeros(256, bool)
_ENDS[[0x20, 0x09, 0x0A, 0x0D]] = True
_BLANK = _ENDS.copy()
_BLANK[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F]] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units of UTF-8 texts begin: where texts do, and before white space that follows something else.

    Byte-level pre-tokenizers have no piece in which white space follows something else, and where a piece starts
    depends on what comes after alone. So no token crosses a cut, and the units have the same tokens one by one as
    the whole text. Cuts are before ASCII white space only, and never after any character that may count as white.
    """
    n = len(data)
    begins = np.zeros(n, bool)
    if n:
        white = _BLANK[data]
        high = np.flatnonzero((data >= 0x80) & (data <= 0xAF))
        if len(high):
            one, two = data[np.maximum(high - 1, 0)], data[np.maximum(high - 2, 0)]
            white[high[(one == 0xC2) | (np.isin(one, (0x80, 0x81, 0x9A, 0xA0)) & np.isin(two, (0xE1, 0xE2, 0xE3)))]] = True
        begins[1:] = _ENDS[data[1:]] & ~white[:-1]
        begins[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(begins)


def splits_at_spaces(path: str) -> bool:
    """Whether ``units`` may be encoded one by one: true of byte-level files without a normalizer or odd tokens."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        top = json.load(f)
    pre = top.get("pre_tokenizer") or {}
    odd = any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in top.get("added_tokens") or [])
    return not top.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not odd


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def library(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Encoder of texts by the file's library, without special tokens added, truncation or padding."""
    if path.endswith(".json"):
        t = _tokenizer(path)
        return lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: p.encode(texts, num_threads=1)


class Joined:
    """Ids of many short texts by the file's library; those that begin with a lone space are encoded as one long text.

    The ids of such a text begin with the token that begins with its space, and no other token does, so they are found
    in those of the whole. Should the numbers differ, the texts are encoded one by one.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.spaced = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True

    def __call__(self, units: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(order of the units in the result, all ids, number of ids of each)."""
        lone = [i for i, u in enumerate(units) if _LONE.fullmatch(u)]
        others = sorted(set(range(len(units))).difference(lone)) if len(lone) < len(units) else []
        ids, lengths, i = [], [], 0
        while i < len(lone):
            j, n = i, 0
            while j < len(lone) and n < JOINED:
                n += len(units[lone[j]])
                j += 1
            texts = [units[k] for k in lone[i:j]]
            found = np.array(self.tokenizer.encode("".join(texts), add_special_tokens=False).ids, np.int32)
            first = np.flatnonzero(self.spaced[found])
            if len(first) == j - i and first[0] == 0:
                ids.append(found)
                lengths.append(np.diff(first, append=len(found)))
            else:
                self._each(texts, ids, lengths)
            i = j
        self._each([units[k] for k in others], ids, lengths)
        return lone + others, np.concatenate(ids or [np.empty(0, np.int32)]), np.concatenate(lengths or [np.empty(0, np.int64)])

    def _each(self, texts: list[str], ids: list[np.ndarray], lengths: list[np.ndarray]) -> None:
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids.append(np.array(e.ids, np.int32))
            lengths.append(np.array([len(e.ids)]))


class UnitCache:
    """Ids of texts from those of their units, each of which is made once as long as it is remembered.

    ``make`` gives (order, ids, lengths) of distinct units. What is remembered is bounded by MOST_UNITS and MOST_BYTES,
    whatever the texts; beyond, the half used less goes.
    """

    def __init__(self, make: Callable[[list[str]], tuple[list[int], np.ndarray, np.ndarray]]):
        self.make = make
        self._keep({}, np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), 0)

    def _keep(self, known: dict[str, int], ids: np.ndarray, lengths: np.ndarray, used: np.ndarray, size: int) -> None:
        self.known, self.ids, self.lengths, self.used, self.size = known, ids, lengths, used, size
        self.starts = np.cumsum(lengths) - lengths

    def _forget(self) -> None:
        order = np.argsort(-self.used, kind="stable")
        sizes = np.fromiter(map(len, self.known), np.int64, len(self.known))
        stay = np.sort(order[(np.arange(len(order)) < MOST_UNITS // 2) & (np.cumsum(sizes[order]) < MOST_BYTES // 2)])
        keys = list(self.known)
        at = np.repeat(self.starts[stay] - np.cumsum(self.lengths[stay]) + self.lengths[stay], self.lengths[stay])
        self._keep({keys[k]: i for i, k in enumerate(stay.tolist())}, self.ids[at + np.arange(len(at))], self.lengths[stay], self.used[stay] // 2, int(sizes[stay].sum()))

    def places(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(remembered unit of each unit of the texts, first unit of each text and their number)."""
        begin = cuts(data, offsets)
        first = np.searchsorted(begin, offsets)
        if not len(begin):
            return np.empty(0, np.int64), first
        bounds = pa.py_buffer(np.append(begin, len(data)).astype(np.int64))
        texts = pa.Array.from_buffers(pa.large_string(), len(begin), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
        units, codes = texts.dictionary.to_pylist(), texts.indices.to_numpy(zero_copy_only=False)
        if len(self.known) > MOST_UNITS or self.size > MOST_BYTES:
            self._forget()
        slots = np.array(list(map(self.known.get, units, repeat(-1))), np.int64)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            new = [units[k] for k in missing.tolist()]
            order, ids, lengths = self.make(new)
            number = len(self.known)
            slots[missing[order]] = np.arange(number, number + len(new))
            self.known.update(zip(map(new.__getitem__, order), range(number, number + len(new)), strict=True))
            self._keep(self.known, np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths]), np.concatenate([self.used, np.zeros(len(new), np.int64)]), self.size + sum(map(len, new)))
        self.used[slots] += np.bincount(codes, minlength=len(units))
        return slots[codes], first

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of ids of each text."""
        slots, first = self.places(data, offsets)
        sums = np.concatenate([[0], np.cumsum(self.lengths[slots])])
        return np.diff(sums[first])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        slots, first = self.places(data, offsets)
        lengths = self.lengths[slots]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[slots] - ends + lengths, lengths)
        return self.ids[at + np.arange(len(at))], np.diff(np.concatenate([[0], ends])[first])


class Encoder:
    """Encoder of one file: ``encode`` and ``counts`` of whole texts, given as bytes and offsets."""

    def __init__(self, path: str):
        self.cache = UnitCache(Joined(path)) if splits_at_spaces(path) else None
        self.whole = None if self.cache else library(path)

    def _texts(self, data: np.ndarray, offsets: np.ndarray) -> list[str]:
        whole = data.tobytes()
        return [whole[a:b].decode() for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.cache:
            return self.cache.encode(data, offsets)
        found = self.whole(self._texts(data, offsets))
        return np.array([x for ids in found for x in ids], np.int32), np.array([len(x) for x in found], np.int64)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.cache.counts(data, offsets) if self.cache else self.encode(data, offsets)[1]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of the file; what it remembers outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Gives back what this worker remembers of all files."""
    _encoders.clear()
