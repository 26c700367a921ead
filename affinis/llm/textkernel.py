"""Words of UTF-8 texts and their hashes, for whole Arrow batches at a time.

A word is a maximal run of characters other than the six ASCII white-space characters, and those are single
bytes in UTF-8, so words are found in the bytes. A word's hash is that of two polynomials over its bytes, modulo two
primes below 2**31, read off prefix sums and mixed at the end; it depends on the word alone and is the same on every
machine. (Modulo a power of two, long words can be made whose sums agree whatever the base.) There are two families of
such hashes, with other bases, for what has to be verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; a longer text is worked on alone.
CHUNK_BYTES = 1 << 20
U64 = np.uint64


#: What operators keep in this worker between tasks, and how it is given back.
_kept: dict[str, Callable[[], None]] = {}


def begin(owner: str, release: Callable[[], None] | None = None) -> None:
    """Says that a task of an operator begins: what other operators keep in this worker is given back."""
    for name in [x for x in _kept if x != owner]:
        _kept.pop(name)()
    if release:
        _kept[owner] = release
    pa.default_memory_pool().release_unused()


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that mixes all bits (the finalizer of splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Odd base of the polynomials over words; primes, and bases of each family, of those over bytes.
WORD_BASE = 0xD1342543DE82EF95
PRIMES = (2147483647, 2147483629)
FAMILIES = ((1103515245, 1812433253), (1566083941, 1664525013))
SALTS = (U64(0), U64(0x9E3779B97F4A7C15))
#: Bytes over which prefix sums of products below 2**40 stay below 2**63.
SUMMED = 1 << 22
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BYTE_VALUES = np.arange(1, 257, dtype=U64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as needed so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.n, self.up, self.down = 0, np.empty(0, U64), np.empty(0, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            size = max(n, CHUNK_BYTES)
            up, down = self._table(self.base, size), self._table(self.inverse, size)
            if size > 2 * CHUNK_BYTES:
                return up[:n], down[:n]
            self.n, self.up, self.down = size, up, down
        return self.up[:n], self.down[:n]

    def _table(self, base: int, n: int) -> np.ndarray:
        out = np.full(n, base, U64)
        out[0] = 1
        return np.multiply.accumulate(out)


class PrimePowers(Powers):
    """The same modulo a prime below 2**31."""

    def __init__(self, base: int, prime: int):
        self.prime = prime
        super().__init__(base)
        self.inverse = pow(base, -1, prime)

    def _table(self, base: int, n: int) -> np.ndarray:
        out = np.ones(n, U64)
        size = 1
        while size < n:
            out[size : 2 * size] = out[: min(size, n - size)] * U64(pow(base, size, self.prime)) % U64(self.prime)
            size *= 2
        return out


BYTES = [[PrimePowers(b, p) for b, p in zip(bases, PRIMES, strict=True)] for bases in FAMILIES]
WORDS = Powers(WORD_BASE)


class Words:
    """The words of some texts: ``starts`` and ``ends`` in ``data``; those of text i are first[i]:first[i+1]."""

    __slots__ = ("data", "offsets", "starts", "ends", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = ~SPACE[data]
        begins, stops = inside.copy(), np.zeros(n + 1, dtype=bool)
        if n:
            edges = offsets[(offsets > 0) & (offsets < n)]
            begins[1:] &= ~inside[:-1]
            begins[edges] = inside[edges]
            stops[1:n] = inside[:-1] & ~inside[1:]
            stops[n] = inside[-1]
            stops[edges] = inside[edges - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops)
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, lower: bool = False, family: int = 0) -> np.ndarray:
        n = len(self.data)
        values = (BYTE_VALUES[LOWER] if lower else BYTE_VALUES)[self.data]
        out = np.zeros(len(self.starts), U64)
        for powers in BYTES[family]:
            p = U64(powers.prime)
            up, down = powers.get(n + 1)
            products, sums = values * up[:n], np.zeros(n + 1, U64)
            if n <= SUMMED:
                np.cumsum(products, out=sums[1:])
            else:
                products %= p
                np.cumsum(products, out=sums[1:])
            out = out << U64(31) | (sums[self.ends] - sums[self.starts]) % p * down[self.starts] % p
        # a word of one byte is that byte in every family
        return splitmix(out ^ SALTS[family])

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; entry i is that of words i to i+n-1."""
    if len(words) < n:
        return np.empty(0, U64)
    up, down = WORDS.get(len(words) + 1)
    sums = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    out = sums[n:] - sums[:-n]
    out *= down[: len(out)]
    return splitmix(out)


def sequence_hash(words: np.ndarray) -> int:
    """Hash of a whole sequence of words, told from others by its length too."""
    up, _ = WORDS.get(len(words) + 1)
    return int(splitmix(np.array([(words * up[: len(words)]).sum(dtype=U64) + U64(len(words))], U64))[0])


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about ``most`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def row_numbers(first: np.ndarray) -> np.ndarray:
    """For each word, the number of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def long_lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list column from the values of all rows and the number of each row's."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    values = values.view(np.int64) if values.dtype == U64 else values
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    if len(x) < width:
        return x[:0]
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x
