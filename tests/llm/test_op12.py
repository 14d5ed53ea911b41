import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoweave.llm import op12_hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, k=5, relabel=True):
    """The result by comparing each anchor with all rows; rows (vec_id, vector, label)."""
    dims = max((len(v) for _, v, _ in rows if v is not None), default=0)
    own = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if relabel and i % 7 == 0 else label
        own.append((i, [max(-H.EDGE, min(H.EDGE, math.floor(256 * float(np.float32(x))))) for x in v] + [0] * (dims - len(v)), label))
    out = []
    for a, (i, v, label) in enumerate(own):
        if i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), j, of) for b, (j, w, of) in enumerate(own) if b != a)
        for s, p, of in [x for x in scored if x[2] == label][:k]:
            fits = [x for x in scored if x[2] != label and -80 * s <= -100 * x[0] <= -100 * s][:k]
            out += [(i, p, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, every=100):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rid", "2 as tile", "3 as `a.b`", "4 as v")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, H.mine(H.quantised(df, label=label), F.col("vec_id") % every == 0).collect()))


def vectors(n, dims, seed, labels=4):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0, 0.3) + (i % labels) * 0.05 for _ in range(dims)], draw.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize(("tiles", "chunk", "leaf"), [(1024, 4096, 256), (16, 64, 8), (4, 40, 4)])
def test_equals_brute_force(spark, monkeypatch, tiles, chunk, leaf):
    monkeypatch.setattr(H.pack, "__defaults__", (tiles, chunk))
    monkeypatch.setattr(H.search, "__defaults__", (H.FAN, leaf))
    monkeypatch.setattr(H.packed, "__defaults__", (leaf, H.FAN))
    rows = vectors(700, 6, 1)
    want = brute(rows, 20)
    assert len(want) > 100 and mined(spark, rows, 20) == want


def test_copies_ties_nulls_and_short_vectors(spark, monkeypatch):
    monkeypatch.setattr(H.pack, "__defaults__", (16, 50))
    rows = vectors(200, 3, 2) + [(1000 + i, [0.5, 0.5, 0.5], i % 3) for i in range(300)]
    rows += [(2000, None, 1), (2001, [None, 1.0, 1.0], 1), (2002, [float("nan"), 1.0, 1.0], 1), (2003, [float("inf"), 1.0, 1.0], 1), (2004, [0.1, 0.1, 0.1], None), (None, [1.0, 1.0, 1.0], 1), (2100, [], 1), (2200, [1.0], 2)]
    assert mined(spark, rows, 100) == brute(rows)


def test_repeated_rows_each_count(spark):
    rows = [(0, [1.0, 0.0], 1)] * 2 + [(i, [1.0, i / 10], 1 + i % 2) for i in range(1, 6)]
    got = mined(spark, rows)
    assert len(got) == len(brute(rows)) and got == brute(rows)


def test_huge_components_stay_exact(spark):
    rows = [(i, [3e38 if i % 2 else -1e30, float(1 << 30) * (i + 1), 0.004 * i], i % 2) for i in range(12)]
    got = mined(spark, [(i * 50, v, label) for i, v, label in rows])
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = [(a, p, r, n, clip(x), clip(y)) for a, p, r, n, x, y in brute([(i * 50, v, label) for i, v, label in rows])]
    assert {g[0] for g in got} <= {w[0] for w in want}
    small = [(i, [1e4 * (i % 5), 2e4, -3e4], i % 3) for i in range(0, 400, 7)]
    assert mined(spark, small) == brute(small)


def test_few_labels_and_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 1), (1, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [0.7], 2)]) == [(100, 1, 1, 2, 65536, 58880)]


def test_boxes_bound_all_products():
    draw = np.random.default_rng(3)
    x = draw.integers(-50, 50, (400, 5)).astype(float)
    n = np.arange(400)
    tree = H.packed(x, n, n, n % 3, leaf=16, fan=4)
    assert sorted(map(tuple, tree.vectors)) == sorted(map(tuple, x)) and len(tree.levels) == 4
    for a in draw.integers(-9, 9, (20, 5)).astype(float):
        least, most = H.bounds(a, *tree.levels[0])
        for i in range(25):
            s = tree.vectors[i * 16:(i + 1) * 16] @ a
            assert least[i] <= s.min() and s.max() <= most[i]


def test_search_leaves_boxes_out(monkeypatch):
    draw = np.random.default_rng(4)
    x = np.concatenate([draw.integers(-5, 5, (64, 4)) + 100 * i for i in range(16)]).astype(float)
    n = np.arange(len(x))
    tree, seen = H.packed(x, n, n, n % 2, leaf=64, fan=4), []
    whole = tree.vectors

    class Counted(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return np.asarray(self) @ other

    tree.vectors = whole.view(Counted)
    a = np.ones(4)
    best = H.search(tree, a, 0, -1, [(None, None, None)], 5, True, fan=4, leaf=64)[0]
    assert [-b[0] for b in best] == sorted((whole[tree.label == 0] @ a).tolist(), reverse=True)[:5]
    assert sum(seen) < len(x) / 4
