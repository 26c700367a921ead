from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from affinis.llm import near_dedup, substring_dedup
from affinis.llm.components import connected_components
from affinis.llm.textkernel import Words, chunks, gram_hashes, sliding_min
from affinis.llm.workspace import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\x0b\x85\xa0é𝒳", max_size=12), max_size=8))
def test_words(texts):
    import pyarrow as pa

    for i, j, data, offsets in chunks(pa.array(texts, pa.string()), 16):
        w = Words(data, offsets)
        for k in range(j - i):
            got = [data[s:e].tobytes().decode() for s, e in zip(w.starts[w.first[k] : w.first[k + 1]], w.ends[w.first[k] : w.first[k + 1]], strict=True)]
            assert got == WORD.findall(texts[i + k])


def test_hashes_follow_words_alone():
    import pyarrow as pa

    (_, _, data, offsets), = chunks(pa.array(["a b c a b", " x\ta  b\nc", ""]))
    w = Words(data, offsets)
    h = w.hashes()
    g = gram_hashes(h, 2)
    assert g[0] == g[3] == g[6] and len(set(g[:3].tolist())) == 3 and h[0] == h[6]
    x = np.array([5, 3, 9, 1, 7, 7, 2])
    assert all((sliding_min(x, k) == [x[i : i + k].min() for i in range(len(x) - k + 1)]).all() for k in range(1, 8))


def brute_substring(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, y in zip(w, gone, strict=True) if not y)))
    return out


@pytest.mark.parametrize("window", [3, 12, 35])
def test_substring_dedup(spark, window):
    rng = np.random.default_rng(window)
    word = lambda n: " ".join(rng.choice(list("abcdefg"), n)) if window < 20 else " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    shared = word(60)
    texts = [None, "", "a", *(f"{word(rng.integers(0, 60))} {shared[k * 3 :]} {word(20)}" for k in range(6)), word(90), "same text " * 50, "z " * 100]
    texts += [texts[5], texts[5].replace(" ", "\n")]
    rows = [(i if i % 4 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k1": F.lit(1), "sure": F.lit("x"), "kept": F.lit("y")})
    got = sorted(((r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(df, window=window).collect()))
    assert got == sorted(brute_substring(texts, window))
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_index_over_batches(spark):
    text = " ".join(f"w{i}" for i in range(50))
    batches = [[(1, text), (2, "other words " * 3)], [(3, "start " + text + " end")], [(4, " ".join(f"v{i}" for i in range(60)))]]
    index = substring_dedup.FingerprintIndex(Workspace(spark, "test"), window=35, most_runs=1)
    for b in batches:
        index.append(spark.createDataFrame(b, "id long, text string"))
    assert len(index.runs) == 1
    assert {r.id: r.n_removed for r in index.judge(1).collect()} == {3: 50}
    assert {r.id: r.n_removed for r in index.judge().collect()} == {1: 50, 2: 0, 3: 50, 4: 0}
    assert index.judge(1).collect()[0].kept == "start end" and index.judge(1).collect()[0].spans == [1, 51]


def test_windows_of_copies_are_compared_once(spark, monkeypatch):
    """What is written to be compared grows with the texts that differ, not with their copies."""
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    shared, tails, ends = word(80), [word(50) for _ in range(3)], [word(6) for _ in range(40)]
    written = {}
    table = Workspace.table

    def spied(self, df, name):
        out = table(self, df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(Workspace, "table", spied)
    counts = []
    for n in (2, 8):
        texts = [f"{shared} {t}" for t in tails for _ in range(n)] + [f"{shared} {tails[0]} {tails[1]} {ends[0]}", shared + " x"]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = sorted((r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(df).collect())
        assert got == sorted(brute_substring(texts, 35))
        counts.append(written["windows-1"])
    assert counts[0] == counts[1] > 0
    # near copies: each has an end of its own, the anchors before it read alike
    texts = [f"{shared} {tails[k % 2]} {e}" for k, e in enumerate(ends)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(df).collect())
    assert got == sorted(brute_substring(texts, 35))


@pytest.mark.parametrize("seed", range(3))
def test_batches_with_copies_of_each_other(spark, seed):
    """Copies within a batch and in earlier ones, whose windows are partly shared with other texts."""
    rng = np.random.default_rng(seed)
    word = lambda n: " ".join(rng.choice(list("abcdefgh"), n))
    pieces = [word(rng.integers(3, 16)) for _ in range(8)]
    pool = [" ".join(rng.choice(pieces, rng.integers(1, 6))) for _ in range(12)]
    batches = [[str(t) for t in rng.choice(pool, 8)] for _ in range(3)]
    index = substring_dedup.FingerprintIndex(Workspace(spark, "test"), window=10, gram=4, most_runs=2)
    for b, part in enumerate(batches):
        index.append(spark.createDataFrame([(100 * b + k, t) for k, t in enumerate(part)], "id long, text string"))
    want = brute_substring([t for p in batches for t in p], 10)
    for b in (None, 1):
        got = {r.id: (r.n_words, r.n_removed, r.kept) for r in index.judge(b).collect()}
        assert got == {100 * (k // 8) + k % 8: w for k, w in enumerate(want) if b is None or k // 8 == b}


def test_texts_without_repeats_stay(spark):
    docs = spark.createDataFrame([(1, "a  b\n c", "en"), (2, "x " * 80, "de"), (3, None, "fr")], "doc_id long, text string, lang string")
    assert {tuple(r) for r in substring_dedup.without_repeats(docs).collect()} == {(1, "a  b\n c", "en"), (3, None, "fr")}


def brute_components(texts, ids, words, percent=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)), key=lambda k: ids[k])
                root[b] = a
    return {ids[i]: (len(sets[i]), ids[find(i)]) for i in range(len(texts))}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    rng = np.random.default_rng(words)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]

    def changed(n):
        w = list(base)
        for k in rng.integers(0, len(w), n):
            w[k] = f"x{rng.integers(0, 9999)}"
        return " ".join(w)

    texts = [None, "", "one", "ONE", "two words", " ".join(base), " ".join(base).upper().replace(" ", "\n"), *(changed(n) for n in list(range(1, 14)) * 3), *(" ".join(f"u{x}" for x in rng.integers(0, 5000, 60)) for _ in range(5))]
    ids = [int(x) for x in rng.permutation(len(texts)) + 10]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumns({"id": F.lit("x"), "n": F.lit(0), "keys": F.lit("k")})
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df, words=words).collect()}
    want = brute_components(texts, ids, words)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def dense_components(texts, words, percent=80):
    """Components by all pairs at once, for groups too large for sets: the least number of each."""
    names: dict = {}
    rows = [sorted({names.setdefault(tuple(w[k : k + words]), len(names)) for k in range(len(w) - words + 1)}) for w in map(WORD.findall, texts)]
    has = np.zeros((len(rows), len(names)), np.float32)
    for i, r in enumerate(rows):
        has[i, r] = 1
    n = has.sum(axis=1)
    both = has @ has.T
    links = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    label = np.arange(len(rows))
    while True:
        lower = np.where(links, label[None, :], len(rows)).min(axis=1)
        if (lower == label).all():
            return label.tolist()
        label = lower


@pytest.mark.parametrize("kind", ["made from one", "without it", "cut", "around a passage"])
def test_near_duplicates_of_a_large_group(spark, kind):
    rng = np.random.default_rng(len(kind))
    draw = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    base = draw(150)
    rows = [list(base)] if kind == "made from one" else []
    for _ in range(1500):
        w = list(base)
        if kind == "cut":
            at = int(rng.integers(0, 60))
            w = w[at : len(w) - int(rng.integers(0, 60))]
            for k in rng.integers(0, len(w), rng.integers(0, 5)):
                w[k] = f"x{rng.integers(0, 999)}"
        elif kind == "around a passage":
            w = draw(int(rng.integers(5, 60))) + base[:80] + draw(int(rng.integers(0, 30)))
        else:
            for k in rng.integers(0, len(w), rng.integers(4, 26)):
                w[k] = f"x{rng.integers(0, 9999)}"
        rows.append(w)
    order = rng.permutation(len(rows))
    texts = [" ".join(rows[i]) for i in order]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, words=2).collect()}
    assert [got[i] for i in range(len(texts))] == dense_components(texts, 2)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d"), (None, None), (7, "a b c d"), (7, "a b c d"), (7, "q r s t"), (3, "q r s t")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, words=2).collect()]
    assert sorted(got, key=repr) == sorted([(None, None, True)] * 2 + [(7, 3, False)] * 3 + [(3, 3, True)], key=repr)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in near_dedup.one_of_each(df, words=2).collect()) == [0, 0, 3]


def test_signature_agrees_with_jaccard():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    s = near_dedup.signatures([np.unique(a), np.unique(b)], 1024)
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.06


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.label for r in connected_components(Workspace(spark, "cc"), spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 130)}, 300: 300, 301: 300}


def opposite_words() -> tuple[str, str]:
    """Two words of 1,024 bytes whose polynomials modulo 2**64 agree for every odd base."""
    signs = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[s] for s in signs), "".join("ba"[s] for s in signs)


def test_words_that_collide_modulo_powers_of_two(spark):
    import pyarrow as pa

    from affinis.llm import quality

    a, b = opposite_words()
    (_, _, data, offsets), = chunks(pa.array([f"{a} {b}"]))
    for family in (0, 1):
        h = Words(data, offsets).hashes(family=family)
        assert h[0] != h[1]
    common = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{common} {a}"), (2, f"{common} {b}")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(docs).collect()] == [0, 0]
    pair = spark.createDataFrame([(1, a), (2, b), (3, f"x {a} y"), (4, f"x {b} y")], "doc_id long, text string")
    assert all(r.kept for r in near_dedup.near_duplicates(pair, words=2).collect())
    (_, _, data, offsets), = chunks(pa.array([f"p q r s {a} x y p q r s {b}"]))
    assert quality.statistics(data, offsets)[0, 4] == 0


def test_families_are_independent_and_long_texts_agree():
    rng = np.random.default_rng(6)
    text = b" ".join(bytes(rng.integers(97, 123, rng.integers(1, 12), dtype=np.uint8)) for _ in range(1000)) + b" "
    one = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    times = (5 << 20) // len(text) + 1
    many = Words(np.frombuffer(text * times, np.uint8), np.array([0, len(text) * times]))
    for family in (0, 1):
        assert (many.hashes(family=family) == np.tile(one.hashes(family=family), times)).all()
    assert not (one.hashes() == one.hashes(family=1)).any()


def test_without_repeats_with_clashing_columns(spark):
    common = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"a {common}", "x", 7), (2, f"{common}  b", "y", 8), (3, "c  c", "z", 9)], "doc_id long, text string, text_before string, c1 long").withColumns({"row": F.lit(1), "n_removed": F.lit("q"), "a.b": F.lit(2)})
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.text_before, r.c1) for r in out.collect()) == [(1, "a", "x", 7), (2, "b", "y", 8), (3, "c  c", "z", 9)]


def test_index_that_lasts(spark, tmp_path):
    rng = np.random.default_rng(12)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 300, n))
    shared = [word(40) for _ in range(4)]
    texts = [[f"{word(10)} {shared[(k + b) % 4]} {word(20)}" if k % 2 else word(50) for k in range(8)] + [None, ""] for b in range(4)]
    path = str(tmp_path / "index")
    for b, part in enumerate(texts):
        index = substring_dedup.FingerprintIndex.open(spark, path, most_runs=2)
        assert len(index.batches) == b
        index.append(spark.createDataFrame([(100 * b + k, t or "") for k, t in enumerate(part)], "id long, text string"))
        so_far = [t for p in texts[: b + 1] for t in p]
        want = brute_substring(so_far, 35)[10 * b :]
        got = {r.id: (r.n_words, r.n_removed, r.kept) for r in index.judge(b).collect()}
        assert [got[100 * b + k] for k in range(10)] == want
    later = substring_dedup.FingerprintIndex.open(spark, path)
    assert len(later.runs) <= 2 and later.most_runs == 2
    assert sorted((r.n_words, r.n_removed, r.kept) for r in later.judge().collect()) == sorted(brute_substring([t for p in texts for t in p], 35))
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{path}/batch4")
    again = substring_dedup.FingerprintIndex.open(spark, path)
    again.append(spark.createDataFrame([(900, texts[0][1])], "id long, text string"))
    assert again.judge(4).collect()[0].n_removed == again.judge(4).collect()[0].n_words
    runs = {p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("run")}
    assert len(runs) <= 6 and len(list((tmp_path / "index").glob("manifest-*"))) == 2
