import random
from itertools import combinations
from math import acos, comb, pi

import numpy as np

import corpus_pipeline as C
from isoweave.llm import near_copies as N
from isoweave.operators.iterate import connected_components
from tests.llm.test_near_copies import bands


def far(a, b):
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


def test_a_bit_is_set_where_over_half_of_the_hashes_have_it():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 7, 300, 9000):
        s = rng.integers(0, 1 << 63, n, np.uint64)
        counts = [0] * N.WIDTH
        for one in s.tolist():
            for w, turn in enumerate(N._turns(N.WIDTH // 64, 2)[0].tolist()):
                h = one * turn % 2**64
                h = (h ^ h >> 32) * 0x9E3779B97F4A7C15 % 2**64
                h ^= h >> 29
                for b in range(64):
                    counts[64 * w + b] += h >> b & 1
        assert N.simhash(s) == sum(1 << b for b, c in enumerate(counts) if 2 * c > n).to_bytes(N.WIDTH // 8, "little")


def test_bit_planes_of_whole_fingerprints_against_popcounts():
    rng = random.Random(8)
    for n in (1, 2, 64, 65, 300):
        base = rng.getrandbits(N.WIDTH)
        blobs = [(base ^ sum(1 << b for b in rng.sample(range(N.WIDTH), rng.randrange(120)))).to_bytes(N.WIDTH // 8, "little") for _ in range(n)]
        prints = N._prints_of(blobs)
        for radius in (0, 1, 31, 84, 128, N.WIDTH):
            assert N.all_within(prints, radius).tolist() == [[far(a, b) <= radius for b in blobs] for a in blobs]
            assert N.pairs_within(prints, prints[::-1], radius).tolist() == [far(a, b) <= radius for a, b in zip(blobs, blobs[::-1])]
    unlike = N._prints_of([(0).to_bytes(N.WIDTH // 8, "little"), (2**N.WIDTH - 1).to_bytes(N.WIDTH // 8, "little")])
    assert not N.pairs_within(unlike[:1], unlike[1:], 84).any()


def chance(both, a, b):
    """That a bit of two sets differs, where so many shingles are in both and in one alone."""
    draws = [[(2 * k - n, comb(n, k) / 2**n) for k in range(n + 1)] for n in (both, a, b)]
    out = 0.0
    for x, p in draws[0]:
        one, two = (sum(q for y, q in d if x + y > 0) for d in draws[1:])
        out += p * (one * (1 - two) + two * (1 - one))
    return out


def test_the_radius_loses_no_pair_at_the_line():
    for similarity in (0.5, 0.8, 0.9):
        line = acos(2 * similarity / (1 + similarity)) / pi
        worst = max(chance(s, a, u - s - a) for u in range(2, 50) for s in range(1, u) if s >= similarity * u for a in range((u - s) // 2 + 1))
        assert line < worst <= 1.26 * line
        radius = N.radius_of(similarity)
        assert sum(comb(N.WIDTH, k) * worst**k * (1 - worst) ** (N.WIDTH - k) for k in range(radius + 1, N.WIDTH + 1)) <= N.BEYOND
    assert N.radius_of(1.0) == 0 and N.radius_of(0.8) < N.WIDTH / 2 - 5 * (N.WIDTH / 4) ** 0.5


def test_op9s_links_are_candidates_and_the_exact_line_decides(spark):
    """No vertex shares a key, so op9's blocks and planes alone name the pairs."""
    rng = random.Random(12)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(3):
        centre = rng.getrandbits(64)
        fps |= {centre ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(30)}
    fps = [*sorted(fps), *sorted(fps)[::3]]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = {(r.src, r.dst) for r in N._closest(spark.createDataFrame(list(enumerate(signed)), "vertex long, fp long")).collect()}
    near = {(a, b) for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2}
    assert found <= near and len(found) < len(near)
    named = [{(r.node, r.component) for r in connected_components(spark.createDataFrame(sorted(x), "src long, dst long")).collect()} for x in (found, near)]
    assert named[0] == named[1]

    sets = [np.arange(100), np.arange(100) + 5, np.arange(100) + 500]  # 0.9 between the first two, nothing shared with the last
    blobs = [x.astype(np.uint32).tobytes() for x in sets]
    rows = [(i, 7, [i], bytes(N.WIDTH // 8), blob) for i, blob in enumerate(blobs)]
    df = spark.createDataFrame(rows, "vertex long, fp long, keys array<long>, print binary, shingles binary")
    assert [tuple(r) for r in N._links_of(df.select("vertex", "fp", "keys"), df.select("vertex", "print", "shingles"), 0.8).collect()] == [(0, 1)]


def test_every_pair_of_the_stage_goes_through_the_comparison(spark, monkeypatch):
    """A radius of no bit leaves no near copy joined; the right one joins all, in joins and in blocks of open buckets."""
    found = bands(random.Random(31), [(0.8, 0.9)], 40)
    docs = spark.createDataFrame([(2 * i + side, pair[side]) for i, pair in enumerate(found) for side in (0, 1)], "doc_id long, text string")
    assert C.near_dedup(spark, docs, "").count() == 40
    prints = [[N.simhash(N.shingles_of(t)) for t in pair[:2]] for pair in found]
    assert all(2 < far(a, b) <= N.radius_of(0.8) for a, b in prints)
    sets = [N._set_of(N._packed(N.shingles_of(t))) for pair in found for t in pair[:2]]
    flat = N._prints_of([p for pair in prints for p in pair])
    assert sorted(N.forest(flat, sets, np.arange(80), 0.8, N.radius_of(0.8))) == [(2 * i, 2 * i + 1) for i in range(40)]
    assert N.forest(flat, sets, np.arange(80), 0.8, 0) == []
    monkeypatch.setattr(N, "radius_of", lambda similarity: 0)
    assert C.near_dedup(spark, docs, "").count() == 80
