"""A megabyte in one row, with and without white space, through the operators that take whole texts."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from test_dedup import brute_substring

from affinis.llm import near_dedup, packing, pii, quality, secrets, substring_dedup, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(8)
    words = " ".join(f"w{x}" for x in rng.integers(0, 50_000, 160_000))
    return ["".join(rng.choice(list("abcdefghij"), 1_000_000)), words, words.replace("w1", "x1", 300), "token = \"" + "0f3a9c" * 8 + "\" " + "y" * 500_000, "", None]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()


def test_substring_dedup(docs, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_substring(texts, 35)


def test_near_dedup(docs):
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, words=2).collect()}
    assert got == {0: (0, True), 1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True), 5: (5, True)}


def test_the_others(spark, docs, texts):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r.doc_id: r.n_words for r in quality.judge(docs, labels).collect()} == {i: len((t or "").split()) for i, t in enumerate(texts)}
    assert [r.start for r in secrets.scan(docs).where("doc_id = 3 and length(secret) = 48").collect()] == [9]
    assert {r.doc_id for r in pii.find(docs).where("size(spans) = 0").collect()} == set(range(6))
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, PATH).collect()}
    packed = packing.pack(docs, PATH).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r.doc_id: r[1] - 1 for r in packed} == counts and counts[5] == counts[4] == 0
