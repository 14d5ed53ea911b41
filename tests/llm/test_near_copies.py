import random
from itertools import combinations

import pytest

from isoweave.llm import near_copies as N


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def edited(rng, text, share):
    words = text.split()
    for _ in range(max(1, round(share * len(words)))):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_copies_go_and_different_texts_stay(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(4000)]
    clean = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 400)))) for i in range(400)]
    shared = " ".join(rng.choices(vocabulary, k=60))
    clean += [(1000 + i, f"{shared} " + " ".join(rng.choices(vocabulary, k=120))) for i in range(30)]
    copies = [(5000 + i, t) for i, t in clean[:40]] + [(6000 + i, edited(rng, t, 0.01)) for i, t in clean[40:140] if len(t.split()) > 60]
    group = clean[200][1] + " " + " ".join(rng.choices(vocabulary, k=200))
    copies += [(7000 + i, edited(rng, group, 0.005)) for i in range(300)]
    odd = [(9000, None), (9001, ""), (None, "only null ids " + shared), (9002, "w " * 50000), (9002, "w " * 50000)]
    df = spark.createDataFrame(clean + copies + odd, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component", "3 as vertex")
    left = N.drop_near_copies(df).collect()
    ids = [r.doc_id for r in left]
    assert {i for i, _ in clean} <= set(ids) and len(ids) == len(set(ids))
    assert ids.count(9002) == 1 and None in ids and (9000 in ids) != (9001 in ids)
    missed = [i for i in ids if i is not None and 5000 <= i < 9000]
    assert len(missed) <= 4, missed
    assert left[0].asDict().keys() == {"doc_id", "text", "fp", "component", "vertex"}
    assert N.drop_near_copies(df.limit(0)).count() == 0


def test_recall_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, shingles(r.text)) for r in docs.collect())
    where = {r.doc_id: r.component for r in N.near_copies(docs).collect()}
    pairs = [(a, b, len(x & y) / len(x | y)) for (a, x), (b, y) in combinations(rows, 2) if x & y]
    want = [(a, b) for a, b, j in pairs if j >= 0.8]
    found = sum(where[a] == where[b] for a, b in want)
    far = [(a, b, j) for a, b, j in pairs if j < 0.5 and where[a] == where[b]]
    print("\nrecall", found, len(want), "joined below 0.5:", len(far))
    assert found >= 0.9 * len(want)


def bands(rng, bands, each, size=200):
    """Pairs of texts whose exact Jaccard similarities of five-word shingles lie in the bands."""
    out = []
    for low, high in bands:
        n = 0
        while n < each:
            words = [f"w{rng.randrange(10**9)}" for _ in range(size)]
            other = list(words)
            for at in rng.sample(range(size), rng.randint(1, 12)):
                other[at] = f"x{rng.randrange(10**9)}"
            a, b = " ".join(words), " ".join(other)
            x, y = shingles(a), shingles(b)
            j = len(x & y) / len(x | y)
            if low <= j < high:
                out.append((a, b, low))
                n += 1
    return out


def test_the_line_is_exact_on_both_sides(spark):
    rng = random.Random(21)
    lows = [(0.5, 0.65), (0.65, 0.7), (0.7, 0.75), (0.75, 0.8), (0.8, 0.82), (0.82, 0.9)]
    found = bands(rng, lows, 60)
    line = "one line that comes again and again in both of them "
    odd = [(line * 60 + " ".join(f"p{i}{k}" for k in range(25)), line * 60 + " ".join(f"q{i}{k}" for k in range(25)), 0.0) for i in range(20)]
    rows = [(2 * i + side, pair[side]) for i, pair in enumerate(found + odd) for side in (0, 1)]
    where = {r.doc_id: r.component for r in N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    joined = {}
    for i, (_, _, low) in enumerate(found + odd):
        joined.setdefault(low, []).append(where[2 * i] == where[2 * i + 1])
    print("\njoined by band", {k: f"{sum(v)} of {len(v)}" for k, v in joined.items()})
    assert not any(any(v) for k, v in joined.items() if k < 0.8)
    assert all(all(v) for k, v in joined.items() if k >= 0.8)
    assert N.missed(0.8, N.FIRST) < 1e-4


@pytest.mark.parametrize("leaf", [2, 10000])
def test_hot_buckets_are_compared_by_blocks(spark, monkeypatch, leaf):
    """A group around the line, far above LEAF and BLOCK (both made small): the same components as all pairs, and no task is given a bucket."""
    rng = random.Random(5)
    rows = []
    for g, share in enumerate((0.03, 0.05, 0.056, 0.0)):
        base = [f"g{g}w{i}" for i in range(150)]
        for i in range(250):
            words = list(base)
            start = rng.randrange(150)
            for k in range(round(share * 150 / 5) + (i % 3)):
                words[(start + k * 11) % 150] = f"e{g}x{i}x{k}"
            rows.append((g * 1000 + i, " ".join(words)))
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for (a, x), (b, y) in combinations(sets.items(), 2):
        if a // 1000 == b // 1000 and len(x & y) >= 0.8 * len(x | y):
            root[top(a)] = top(b)
    monkeypatch.setattr(N, "LEAF", leaf)
    monkeypatch.setattr(N, "BLOCK", 40)
    monkeypatch.setattr(N, "PART", 30)
    where = {r.doc_id: r.component for r in N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    got, want = {}, {}
    for i in sets:
        got.setdefault(where[i], set()).add(i)
        want.setdefault(top(i), set()).add(i)
    print("\ncomponents", len(got), "of all pairs", len(want), sorted(map(len, want.values()))[-4:])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
