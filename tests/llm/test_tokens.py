from __future__ import annotations

import hashlib
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from affinis.llm import bpe, packing, token_counts, tokens
from affinis.llm.textkernel import chunks

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", " a", "a ", "hello  world", "x<|endoftext|> y <|endoftext|>z", "it's we'll  don't \n\n  x", "日本語 テキスト 𝒳 é", "a" * 3000, "ab" * 777 + " " + "1234567890" * 30, "\t\ttab\r\n x\x1cy z", "one.\nTwo, three", "\x00 \x85 q", "....!!!  ?? 's 't", "the same", "the same"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns({"ids": F.lit("clash"), "n_tokens": F.lit(1), "id": F.lit("x")})


def flat(texts):
    (_, _, data, offsets), = chunks(pa.array(texts, pa.string()), 1 << 30)
    return data, offsets


ODD = ["a", "B", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u3000", "\u180e", "\u200b", "\ufeff", "1", ".", "'s", "'", "é", "日", "<|endoftext|>", "<|", "\x00"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD), max_size=14).map("".join), min_size=1, max_size=6))
def test_units_have_the_tokens_of_the_text(texts):
    want = tokens.library(PATH)(texts)
    for encode in (tokens.encoder(PATH).encode, bpe.codec(PATH).cache.encode):
        ids, lengths = encode(*flat(texts))
        assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert tokens.encoder(PATH).counts(*flat(texts)).tolist() == [len(x) for x in want]


def test_rarer_units_are_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_UNITS", 50)
    made = tokens.Encoder(PATH)
    rng = np.random.default_rng(2)
    for _ in range(20):
        texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, 30)) for _ in range(3)]
        assert made.encode(*flat(texts))[0].tolist() == [i for x in tokens.library(PATH)(texts) for i in x]
        assert len(made.cache.known) <= 50 + 90


@pytest.mark.parametrize("kind", ["letters", "same", "japanese", "words", "lines"])
def test_a_megabyte(kind, spark):
    rng = np.random.default_rng(3)
    pick = lambda x, n, sep="": sep.join(rng.choice(x, n))
    text = {"letters": lambda: pick(list("abcdefghij"), 1_000_000), "same": lambda: "a" * 1_000_000, "japanese": lambda: pick(list("日本語のテキストは長い文章"), 340_000), "words": lambda: pick(["foo", "barbaz"], 200_000, " "), "lines": lambda: pick(["foo", "x  y"], 250_000, "\n")}[kind]()
    want = tokens.library(PATH)([text])[0]
    began = time.monotonic()
    ids, _ = bpe.codec(PATH).cache.encode(*flat([text]))
    assert time.monotonic() - began < 20 and ids.tolist() == want
    assert tokens.encoder(PATH).counts(*flat([text])).tolist() == [len(want)]
    assert bpe.codec(PATH).decode(ids.astype(np.int64)).decode() == text


def test_encoding_is_the_librarys(library, docs, spark):
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].text == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    odd = spark.createDataFrame([(1, [None, 99999999, -4, 72]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(odd, PATH).collect()} == {1: library.decode([72]), 2: ""}


def test_merging_equals_a_plain_loop():
    c = bpe.codec(PATH)
    ranks = {(int(k) >> c.shift, int(k) & ((1 << c.shift) - 1)): int(r) for k, r in zip(c.pair_keys, c.pair_ranks, strict=True)}
    rng = np.random.default_rng(1)
    words = [bytes(rng.choice(list(b" etaoinshrdlu.\xc3\xa9"), rng.integers(1, 40))) for _ in range(300)]
    for word, got in zip(words, c.merge(words), strict=True):
        ids = [int(c.byte_ids[b]) for b in word]
        while True:
            best = min(((ranks[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in ranks), default=None)
            if best is None:
                break
            ids[best[1] : best[1] + 2] = [int(c.joined[best[0]])]
        assert got.tolist() == ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(name, docs):
    path = public_tokenizers.path(name)
    want = [len(x) for x in tokens.library(path)([t or "" for t in TEXTS])]
    got = {r.doc_id: r for r in token_counts.token_counts(docs, path, limit=5).collect()}
    assert [got[i].n_tokens for i in range(len(TEXTS))] == want
    assert all(r.n_bytes == len((TEXTS[i] or "").encode()) and r.over_limit == (r.n_tokens > 5) for i, r in got.items())


def test_packing_is_a_round_trip(library, docs):
    rows = packing.pack(docs, PATH, size=64).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(TEXTS):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and (k == 0 or r.length == 64)
            at += r.length
        assert at == len(ids)
    filled: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 64 and len(filled) <= -(-sum(filled.values()) // 64) + 1
    assert packing.pack(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_local_search_keeps_documents_and_fill(seed):
    rng = np.random.default_rng(seed)
    counts = Counter(int(x) for x in rng.integers([1, 300, 40, 500][seed], [1023, 700, 90, 600][seed], 3000))
    first = packing.best_fit(counts, 1024)
    second = packing.local_search(first, 1024)
    held = Counter()
    for b, n in second.items():
        assert sum(b) <= 1024
        for x in b:
            held[x] += n
    squares = lambda bins: sum(sum(b) ** 2 * n for b, n in bins.items())
    assert held == counts and sum(second.values()) <= sum(first.values()) and squares(second) >= squares(first)


def test_local_search_empties_bins():
    loose = Counter({(600,): 1, (500,): 1, (524,): 1, (424,): 1})
    assert sum(packing.local_search(loose, 1024).values()) == 2
    swap = Counter({(700, 200): 1, (600, 300): 1, (124, 124): 1})
    assert sum(packing.local_search(swap, 1024).values()) <= 3


@pytest.mark.parametrize(("low", "high", "n"), [(200, 520, 30_000), (200, 520, 300), (150, 550, 200)])
def test_local_search_goes_on_while_there_are_exchanges(low, high, n):
    counts = Counter(int(x) for x in np.random.default_rng(1).integers(low, high + 1, n))
    first = packing.best_fit(counts, 1024)
    second = packing.local_search(first, 1024)
    assert sum(second.values()) < sum(first.values()) and sum((Counter({x: b.count(x) * k for x in b}) for b, k in second.items()), Counter()) == counts
    if n > 1000 or sum(second.values()) == -(-sum(x * k for x, k in counts.items()) // 1024):
        return
    under = [b for b in second if sum(b) < 1024]
    sums = lambda b, most: {0} | set(b) | {x + y for i, x in enumerate(b) for y in b[i + 1 :] if most > 1}
    for a in under:
        for b in under:
            if sum(a) <= sum(b) and (a != b or second[a] > 1):
                room = 1024 - sum(b)
                assert not any(0 < x - y <= room for x in set(a) for y in sums(b, 2)) and not any(0 < x - y <= room for x in sums(a, 2) - {0} for y in set(b))


def test_query(spark, library):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in bpe.op6_bpe(spark, d).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
