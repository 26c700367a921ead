"""Spelling variants of a vocabulary by full neighbourhoods: every edit of every word is looked up among the words."""

from __future__ import annotations

import functools
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import U64, begin, splitmix
from .workspace import Workspace

LETTERS = "A-Za-zÀ-ÿ"
#: Of the occurrences of runs one in this many loses a code point first, as the contract of the query has it.
ALTERED = 199
#: Two primes below 2**31 and the bases of the polynomials modulo them; the 62 bits of both are a word's key.
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1812433253)
#: Bits of the filter that candidates pass before they are shuffled, 16 MB whatever the vocabulary.
FILTER_BITS = 1 << 27
#: Candidates that are made at a time.
CELLS = 1 << 18


@functools.lru_cache(maxsize=8)
def powers(n: int) -> tuple[np.ndarray, ...]:
    """The powers 0 to n-1 of each base modulo its prime."""
    out = []
    for p, b in zip(PRIMES, BASES, strict=True):
        table = np.ones(1, U64)
        while len(table) < n:
            table = np.concatenate([table, table * U64(pow(b, len(table), p)) % U64(p)])
        out.append(table[:n])
    return tuple(out)


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words one after the other, and the place where each begins and the last ends."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(U64), np.cumsum([0, *map(len, words)])


def by_length(codes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the words of one length, their code points as a matrix)."""
    lengths = np.diff(offsets)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, codes[offsets[rows][:, None] + np.arange(n)]


def word_keys(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for rows, w in by_length(*code_points(words)):
        sums = [(w * b % U64(p)).sum(axis=1) % U64(p) for p, b in zip(PRIMES, powers(w.shape[1]), strict=True)]
        out[rows] = (sums[0] << U64(31) | sums[1]).view(np.int64)
    return out


def filter_place(keys: np.ndarray) -> np.ndarray:
    return splitmix(keys.astype(U64)) & U64(FILTER_BITS - 1)


def key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (word, n) to (word, n, key, place)."""
    for batch in batches:
        keys = word_keys(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys), pa.array(filter_place(keys).astype(np.int64))], ["word", "n", "key", "place"])


def neighbourhood(w: np.ndarray, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row, at, letter, key, skip) of all distinct edits of words of one length, some at a time.

    An edit leaves out ``skip`` code points from place ``at`` on and puts ``letter`` there, or nothing if that is 0. Of
    equal code points in a row only the first is deleted, a code point is replaced by others only, and none is inserted
    behind its like; so no edit of a word gives what another one gives.
    """
    m, n = w.shape
    step = max(1, CELLS // ((n + 1) * (len(letters) + 1)))
    for a in range(0, m, step):
        part = w[a : a + step]
        pre, terms = [], []
        for p, b in zip(PRIMES, powers(n + 1), strict=True):
            terms.append(part * b[:n] % U64(p))
            sums = np.zeros((len(part), n + 1), U64)
            np.cumsum(terms[-1], axis=1, out=sums[:, 1:])
            pre.append(sums % U64(p))
        run = np.zeros((len(part), n), bool)
        run[:, 1:] = part[:, 1:] == part[:, :-1]
        width = max(1, CELLS // (len(part) * (len(letters) + 1)))
        for i in range(0, n + 1, width):
            j, inner = min(i + width, n + 1), min(i + width, n)
            keys: dict[str, list[np.ndarray]] = {"delete": [], "replace": [], "insert": []}
            for p, base, b, x, s in zip(PRIMES, BASES, powers(n + 1), pre, terms, strict=True):
                q = U64(p)
                rest = (x[:, n:] + q - x) % q
                added = letters[None, :] * b[i:j, None] % q
                keys["delete"].append((x[:, i:inner] + rest[:, i + 1 : inner + 1] * U64(pow(base, -1, p)) % q) % q)
                y = ((x[:, n:] + q - s[:, i:inner]) % q)[:, :, None] + added[None, : inner - i]
                keys["replace"].append(np.where(y >= q, y - q, y))
                y = ((x[:, i:j] + rest[:, i:j] * U64(base) % q) % q)[:, :, None] + added[None]
                keys["insert"].append(np.where(y >= q, y - q, y))
            before = np.zeros((len(part), j - i), U64)
            before[:, (1 if i == 0 else 0) :] = part[:, max(i - 1, 0) : j - 1]
            wanted = {"delete": ~run[:, i:inner], "replace": part[:, i:inner, None] != letters, "insert": before[:, :, None] != letters}
            for kind, skip in (("delete", 1), ("replace", 1), ("insert", 0)):
                at = np.nonzero(wanted[kind])
                key = (keys[kind][0] << U64(31) | keys[kind][1])[at]
                yield at[0] + a, at[1] + i, letters[at[2]] if len(at) > 2 else np.zeros(len(at[0]), U64), key, skip


def candidate_batches(letters: np.ndarray, bitmap: bytes):
    """mapInArrow function: (word) to (key, near_key, at, added, skip) of each edit whose key's place in the filter is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("spelling")
        bits = np.frombuffer(bitmap, np.uint8)
        names = np.array(["", *map(chr, letters.tolist())], object)
        for batch in batches:
            words = batch.column(0).to_pylist()
            own = word_keys(words)
            for rows, w in by_length(*code_points(words)):
                for row, at, letter, key, skip in neighbourhood(w, letters):
                    place = filter_place(key)
                    seen = np.flatnonzero((bits[place >> U64(3)] >> (place & U64(7)).astype(np.uint8)) & 1)
                    if len(seen):
                        added = names[np.where(letter[seen] == 0, 0, np.searchsorted(letters, letter[seen]) + 1)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(own[rows[row[seen]]]), pa.array(key[seen].view(np.int64)), pa.array(at[seen].astype(np.int32)), pa.array(added, pa.string()), pa.array(np.full(len(seen), skip, np.int32))],
                            ["key", "near_key", "at", "added", "skip"],
                        )

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n): the runs of letters of whole texts, A-Z lower-cased, of ``shortest`` code points that occur ``least`` times.

    One occurrence in ALTERED, told by the CRC-32 of the id, a colon and the run, loses a code point first. A null text
    has no runs; a null id reads as an empty one. Rows are counted one by one, also if ids or texts repeat.
    """
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("found"))
    runs = runs.select("id", F.when(F.col("found") == F.lower("found"), F.col("found")).otherwise(F.translate("found", upper, lower)).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    word = F.when(h % ALTERED == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def near_words(ws: Workspace, words: DataFrame) -> DataFrame:
    """(word, near, n): each word of ``words`` (word, n) with each one that differs by one code point inserted, deleted or replaced.

    Every word emits its whole neighbourhood over the letters that the words hold (at most the 90 of the pattern), as
    62-bit keys. A filter of a fixed size, made of the words' keys, keeps most of those that are no word from the
    shuffle; what passes is hash-joined to the vocabulary by key. A joined edit is written out and has to be the word
    that it met, so keys that happen to agree give nothing, and no distance is ever computed.
    """
    keyed = ws.table(words.select("word", "n").mapInArrow(key_batches, "word string, n long, key long, place long"), "keyed")
    found = keyed.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()
    letters = np.array(sorted(ord(r["c"]) for r in found), U64)
    pages = keyed.groupBy(F.bitmap_bucket_number(F.col("place") + 1).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("bits")).collect()
    bitmap = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for r in pages:
        bitmap[r["page"] - 1] = np.frombuffer(r["bits"], np.uint8)
    edits = ws.table(keyed.select("word").mapInArrow(candidate_batches(letters, bitmap.tobytes()), "key long, near_key long, at int, added string, skip int"), "edits")
    near = keyed.select(F.col("key").alias("near_key"), F.col("word").alias("near"), "n")
    made = F.concat(F.substring("word", F.lit(1), F.col("at")), "added", F.substring("word", F.col("at") + F.col("skip") + 1, F.length("word")))
    return edits.join(near.hint("shuffle_hash"), "near_key").join(keyed.select("key", "word").hint("shuffle_hash"), "key").where(made == F.col("near")).select("word", "near", "n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """Spelling variants among the words of whole texts (see ``vocabulary``), grouped under their most usual form.

    Returns a row for each word: word, n (occurrences), n_near (words that differ from it by one code point inserted,
    deleted or replaced), form (of those the one of largest n, the first in code-point order of equal ones, if it has
    ``times`` as many occurrences; else null), form_n, and root (from the word on, forms followed to the last). Texts
    without words, null ones and empty tables give no rows; very long words cost what their length times the alphabet
    is, a part at a time. Other columns are ignored, whatever their names.

    Along forms n grows ``times``-fold, so chains end; pointers are doubled, one written table a round.
    """
    if times < 2:
        raise ValueError("times must be 2 at least")
    ws = Workspace(docs.sparkSession, "spelling")
    words = ws.table(vocabulary(docs, id_col, text_col, shortest, least), "words")
    best = near_words(ws, words).groupBy("word").agg(F.count("*").alias("n_near"), F.min_by(F.struct("near", "n"), F.struct(-F.col("n"), F.col("near"))).alias("best"))
    told = ws.table(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("best.n") >= times * F.col("n"), F.col("best")).alias("best")), "told")
    up, k = told.where("best is not null").select("word", F.col("best.near").alias("up")), 0
    while True:
        further = up.select(F.col("word").alias("up"), F.col("up").alias("next"))
        step = ws.table(up.join(further, "up", "left").select("word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), f"up{k}")
        up, k = step.select("word", "up"), k + 1
        if step.where("moved").isEmpty():
            break
    return told.join(up, "word", "left").select("word", F.col("best.near").alias("form"), F.coalesce("up", "word").alias("root"), "n", "n_near", F.col("best.n").alias("form_n"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of ``documents`` with their forms and roots."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
