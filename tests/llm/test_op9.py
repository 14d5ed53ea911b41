import random
import re
from itertools import combinations

import numpy as np
import xxhash

from isoweave.llm import op9_simhash as S
from isoweave.operators.iterate import connected_components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, links):
    root = {x: x for x in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


def brute(rows):
    """(fingerprint, smallest id reachable) of each (id, text)."""
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    distinct = sorted({f for _, f in fps})
    where = components(distinct, [(a, b) for a, b in combinations(distinct, 2) if (a ^ b).bit_count() <= 2])
    least = {}
    for i, f in fps:
        if i is not None:
            least[where[f]] = min(i, least.get(where[f], i))
    return sorted(((i, f"{f:016x}", least.get(where[f])) for i, f in fps), key=str)


def test_whole_table_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in S.op9_simhash(spark, d).collect()), key=str)
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(got)


def test_nulls_ties_long_texts_and_clashing_names(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdé", k=5)) for _ in range(300)]
    long = " ".join(rng.choices(words, k=80000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "one two"), (7, "a b c"), (8, long), (9, long + " tail"), (9, long), (None, "A b\tc"), (None, "only null ids here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component", "3 as least")
    got = sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in S.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)
    assert S.near_duplicates(df.limit(0)).count() == 0


def ball(rng, centre, n, flips):
    out = {centre}
    while len(out) < n:
        out.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, flips))))
    return out


def test_links_lose_nothing_even_in_buckets_dealt_twice(spark, monkeypatch):
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1} | {rng.getrandbits(64) for _ in range(300)}
    for flips in (2, 3, 4):
        fps |= ball(rng, rng.getrandbits(64), 250, flips)
    fps = sorted(fps)
    want = components(fps, [(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 2])
    df = spark.createDataFrame([(S._signed(f),) for f in fps], "fp long")
    for leaf in (4096, 8):
        monkeypatch.setattr(S, "LEAF", leaf)
        found = [(r.src & (1 << 64) - 1, r.dst & (1 << 64) - 1) for r in S.links(df).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in found)
        assert components(fps, found) == want
        assert len(found) < 6 * len(fps)


def test_bit_planes_against_popcounts():
    rng = random.Random(7)
    for n, words in ((2, 64), (63, 64), (65, 64), (700, 2)):
        fps = np.array([rng.getrandbits(64) & 0xF0F00000000000FF for _ in range(n)], np.uint64)
        for radius in (0, 1, 2, 3):
            want = {(i, j) for i, j in combinations(range(n), 2) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
            assert {(i, j) for i, later in S.near(fps, radius, words) for j in later.tolist()} == want


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000), (7000, None), (6001, 6000), (6000, 6001)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1400), 1000), 6000: 6000, 6001: 6000}
    assert connected_components(df.limit(0)).count() == 0
