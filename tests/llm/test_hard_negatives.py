from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.llm import hard_negatives as hn


def brute(rows, anchor, positives=5, negatives=3, low=50, high=95):
    out = []
    for a, (i, label, v) in enumerate(rows):
        if not anchor(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, other == label) for b, (j, other, w) in enumerate(rows) if b != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fit = [(n, j) for n, j, same in scored if not same and low * -s <= 100 * -n <= high * -s]
            out += [(i, p, k + 1, j, -s, -n) for k, (n, j) in enumerate(fit[:negatives])]
    return sorted(out)


def got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def made(rng, n, dim, labels=4, spread=30):
    centres = rng.integers(-60, 60, (6, dim))
    return [(int(i), int(rng.integers(labels)), (centres[rng.integers(6)] + rng.integers(-spread, spread, dim)).tolist()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, label int, v array<long>")


@pytest.mark.parametrize(("dim", "cell", "leaf"), [(1, 64, 8), (2, 40, 4), (16, 1000, 256), (16, 50, 8), (64, 90, 16)])
def test_equals_all_pairs(spark, monkeypatch, dim, cell, leaf):
    monkeypatch.setattr(hn, "LEAF", leaf)
    rows = made(np.random.default_rng(dim), 400, dim)
    rows += [(1000 + i, i % 2, rows[0][2]) for i in range(150)]
    assert got(hn.hard_negatives(frame(spark, rows), "id % 10 = 0", cell_rows=cell)) == brute(rows, lambda i: i % 10 == 0)


def test_tree_search_prunes_and_is_exact(monkeypatch):
    monkeypatch.setattr(hn, "LEAF", 16)
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (20, 6))
    v = centres[rng.integers(20, size=3000)] + rng.integers(-9, 9, (3000, 6))
    label, bound = rng.integers(0, 9, 3000), float((v.astype(float) ** 2).sum(axis=1).max())
    tree = hn.VantageTree(np.arange(3000), np.arange(3000), label, v, bound)
    seen = []
    lexsort = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: seen.append(len(keys[0])) or lexsort(keys))
    for i in range(0, 3000, 300):
        scores = v @ v[i]
        windows = [(int(s // 2), int(s * 95 // 100)) for s in np.sort(scores)[-4:]]
        want = [[(int(-s), int(j)) for s, j in sorted((-scores[j], j) for j in range(3000) if label[j] != label[i] and a <= scores[j] <= b)[:3]] for a, b in windows]
        assert tree.search(v[i], i, int(label[i]), False, windows, 3) == want
    assert sum(seen) < 0.5 * 10 * 3000


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = made(rng, 120, 8)
    rows += [(10, 2, rows[3][2]), (10, 2, rows[3][2]), (20, 1, [0] * 8), (21, 1, [0] * 8), (30, 1, []), (31, 2, []), (32, 1, []), (40, 1, [5, 5]), (50, 1, [4, 4]), (60, 2, [3, 4])]
    rows += [(200 + i, 1, [2**29, -(2**29)] + [i] * 6) for i in range(12)] + [(300 + i, 2, [2**28, -(2**28)] + [i] * 6) for i in range(8)]
    bad = [(None, 1, [1] * 8), (70, None, [1] * 8), (80, 1, None), (90, 1, [None] + [1] * 7), (100, 1, [2**40] * 8)]
    df = frame(spark, rows + bad).withColumns({"row": F.lit("x"), "place": F.lit(1), "dim": F.lit(0), "scores": F.lit(2)})
    want = brute(rows, lambda i: i % 10 == 0)
    assert got(hn.hard_negatives(df, "id % 10 = 0", cell_rows=32)) == want and any(x[4] > 2**53 for x in want)
    assert hn.hard_negatives(df.limit(0), "id % 10 = 0").collect() == [] and hn.hard_negatives(df, "id = 5000").collect() == []
    one_label = frame(spark, [(i, 1, [i, 1]) for i in range(60)])
    assert hn.hard_negatives(one_label, "id % 10 = 0", cell_rows=10).collect() == []


def test_a_hot_vector_is_split_over_cells(spark):
    rows = [(i, i % 3, [3, 4]) for i in range(600)] + [(1000 + i, i % 3, [2 + i % 2, 3]) for i in range(300)]
    forest = hn.VantageForest(frame(spark, rows), cell_rows=50)
    sizes = [r["count"] for r in forest.cells(forest.rows).groupBy("cell").count().collect()]
    assert sum(sizes) == 900 and max(sizes) < 120
    assert got(hn.hard_negatives(frame(spark, rows), "id % 100 = 0", cell_rows=50)) == brute(rows, lambda i: i % 100 == 0)
