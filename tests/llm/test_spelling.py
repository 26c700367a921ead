from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from affinis.llm import spelling
from affinis.llm.workspace import Workspace

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def edits(word: str, alphabet: str) -> set[str]:
    return ({word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + a + word[i + j :] for i in range(len(word) + 1) for a in alphabet for j in (0, 1) if i + j <= len(word)}) - {word}


def brute(rows, shortest=6, least=5, times=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                counts[run] += 1
    n = {w: k for w, k in counts.items() if k >= least}
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and x in edits(w, "".join(sorted(set("".join(n)))))] for w in n}
    form = {w: next((x for x in sorted(near[w], key=lambda x: (-n[x], x))[:1] if n[x] >= times * n[w]), None) for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abé÷", min_size=1, max_size=7), min_size=1, max_size=6, unique=True))
def test_neighbourhood_is_whole_and_distinct(words):
    letters = np.array(sorted({ord(c) for w in words for c in w}), np.uint64)
    alphabet = "".join(map(chr, letters.tolist()))
    for rows, w in spelling.by_length(*spelling.code_points(words)):
        found: dict[int, list[str]] = {}
        for row, at, letter, key, skip in spelling.neighbourhood(w, letters):
            made = []
            for r, a, c in zip(row.tolist(), at.tolist(), letter.tolist(), strict=True):
                word = words[rows[r]]
                made.append(word[:a] + (chr(c) if c else "") + word[a + skip :])
                found.setdefault(r, []).append(made[-1])
            assert (spelling.word_keys(made).view(np.uint64) == key).all()
        for r, made in found.items():
            assert len(made) == len(set(made)) and set(made) == edits(words[rows[r]], alphabet)


def test_parts_of_a_neighbourhood_equal_the_whole(monkeypatch):
    w = spelling.code_points(["abcdefgh", "aabbccdd", "zzzzzzzz"])[0].reshape(3, 8)
    letters = np.array([97, 98, 122], np.uint64)
    every = lambda: sorted((int(r), int(k), s) for row, _, _, key, s in spelling.neighbourhood(w, letters) for r, k in zip(row, key, strict=True))
    whole = every()
    monkeypatch.setattr(spelling, "CELLS", 5)
    assert every() == whole


def test_variants(spark):
    rng = np.random.default_rng(3)
    stems = ["Straße", "éclairer", "wonderful", "aaaaaa", "aaaaaaa", "banane", "hello"]
    words = [w if rng.random() < 0.7 else w[:k] + str(rng.choice(list("aeXé÷"))) + w[k + int(rng.integers(0, 2)) :] for w in rng.choice(stems, 4000, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.07, 0.03]) for k in [int(rng.integers(0, 7))]]
    texts = [" ".join(words[i : i + 25]) for i in range(0, 4000, 25)]
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (3, texts[3]), (900, None), (901, ""), (902, "12 345 _ ÀÀÀÀÀÀÀ" * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x"), "id": F.lit(2)})
    want = brute(rows)
    assert got(spelling.variants(df)) == want and len(want) > 30 and any(w[1] for w in want)
    assert got(spelling.variants(df, shortest=3, least=2, times=2)) == brute(rows, 3, 2, 2)
    assert spelling.variants(df.limit(0)).collect() == [] and spelling.variants(df.where("text is null")).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(df, times=1)


def test_chains_are_followed_to_the_last(spark):
    sizes = {"abcdefgh": 700, "abcdefg": 130, "abcdefx": 26, "abcdxfx": 5}
    text = " ".join(f"{w} " * n for w, n in sizes.items())
    roots = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame([("d", text)], "doc_id string, text string")).collect()}
    h = {w: zlib.crc32(f"d:{w}".encode()) % 199 for w in sizes}
    assert all(h.values()), "none of the words may be altered here"
    assert roots == {"abcdefgh": (None, "abcdefgh"), "abcdefg": ("abcdefgh", "abcdefgh"), "abcdefx": ("abcdefg", "abcdefgh"), "abcdxfx": ("abcdefx", "abcdefgh")}


def test_very_long_words(spark):
    a = "xy" * 3000
    text = f"{a} " * 30 + f"{a[:-1]} " * 5 + f"{a[:100]}z{a[101:]} " * 6
    rows = [(1, text)]
    out = {r.n: r for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(zlib.crc32(f"1:{w}".encode()) % 199 for w in (a, a[:-1], a[:100] + "z" + a[101:]))
    assert out[30].n_near == 2 and out[5].form == a and out[6].form == a and out[5].n_near == 1


def test_keys_that_agree_give_nothing(spark, monkeypatch):
    monkeypatch.setattr(spelling, "word_keys", lambda words: np.full(len(words), 7, np.int64))
    words = spark.createDataFrame([("abcdef", 9), ("uvwxyz", 9)], "word string, n long")
    assert spelling.near_words(Workspace(spark, "test"), words).count() == 0
