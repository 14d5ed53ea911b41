"""Class-split gradients, marks of ascending manifolds, loops, restricted growing and geodesic density, each against a plain version."""

import heapq
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoweave.functions import grid as G
from isoweave.functions.grid import GridMeta
from isoweave.operators import complex as M
from isoweave.operators import gradient as D
from isoweave.operators import hierarchy as H
from isoweave.operators import iterate, merged, regions
from isoweave.runtime import cut
from tests.test_complex import field_of


def faces(c, mesh, way):
    """Facets (way 1) or cofacets (way 0) of a cell given by its coordinates."""
    for a in range(3):
        if c[a] % 2 == way and mesh[a] > 1:
            for s in (-1, 1):
                o = list(c)
                o[a] += s
                if 0 <= o[a] < mesh[a]:
                    yield tuple(o)


def plain_classed(values, shape, label):
    """Every lower star, class by class: pair what has one open facet, lowest first, else the lowest cell of the lowest dimension is critical."""
    mesh = [2 * n - 1 for n in shape]
    cid = lambda c: c[0] + mesh[0] * (c[1] + mesh[1] * c[2])
    vid = lambda v: v[0] + shape[0] * (v[1] + shape[1] * v[2])
    groups, low, dim = defaultdict(list), {}, {}
    for z, y, x in np.ndindex(mesh[2], mesh[1], mesh[0]):
        c = (x, y, z)
        corner = {vid(tuple(k // 2 + (b if k % 2 else 0) for k, b in zip(c, bits))) for bits in np.ndindex(2, 2, 2)}
        order = sorted((values[v], v) for v in corner)
        low[c], dim[c] = order[0], sum(k % 2 for k in c)
        groups[order[-1][1], label.get(cid(c), -1)].append(c)
    stencil = {o: i for i, o in enumerate(c for c in np.ndindex(3, 3, 3) if c != (1, 1, 1))}
    out = {}
    for (owner, _), cells in groups.items():
        at = (2 * (owner % shape[0]), 2 * (owner // shape[0] % shape[1]), 2 * (owner // (shape[0] * shape[1])))
        place = lambda c: stencil.get(tuple(k - a + 1 for k, a in zip(c, at)), -1)  # noqa: E731, B023
        left = set(cells)
        vertex = next((c for c in cells if dim[c] == 0), None)
        if vertex:
            edges = [c for c in cells if dim[c] == 1]
            first = min(edges, key=lambda c: (low[c], place(c)), default=None)
            out[cid(vertex)] = cid(first) if first else cid(vertex)
            left.discard(vertex)
            if first:
                out[cid(first)] = cid(vertex)
                left.discard(first)
        while left:
            ready = [c for c in left if dim[c] > 1 and sum(f in left for f in faces(c, mesh, 1)) == 1]
            if ready:
                c = min(ready, key=lambda c: (low[c], place(c)))
                f = next(f for f in faces(c, mesh, 1) if f in left)
                out[cid(c)], out[cid(f)] = cid(f), cid(c)
                left -= {c, f}
            else:
                least = min(dim[c] for c in left)
                c = min((c for c in left if dim[c] == least), key=lambda c: (low[c], place(c)))
                out[cid(c)] = cid(c)
                left.discard(c)
    return out


@pytest.mark.parametrize(("shape", "tile"), [((11, 9, 1), 4), ((5, 4, 6), 3)])
def test_no_pair_crosses_a_class(spark, shape, tile):
    meta = GridMeta(*shape)
    values, field = field_of(spark, shape, 7)
    draw = random.Random(1)
    label = {c: draw.randrange(2) for c in range(int(np.prod(meta.mesh))) if draw.random() < 0.9}
    grad = D.classed_gradient(field, spark.createDataFrame(list(label.items()), "cid long, label int"), meta, tile)
    got = {r.cid: r.pair_cid for r in grad.collect()}
    assert got == plain_classed(values, shape, label)
    assert all(label.get(a, -1) == label.get(b, -1) for a, b in got.items())
    assert all((r.pair_cid == r.cid) == r.is_critical for r in grad.collect())


def test_one_class_is_the_gradient_and_two_fields_split_it(spark):
    shape = (10, 8, 1)
    meta = GridMeta(*shape)
    values, field = field_of(spark, shape, 3)
    other_values, other = field_of(spark, shape, 4)
    none = spark.createDataFrame([], "cid long, label int")
    want = {tuple(r) for r in D.discrete_gradient(field, meta).collect()}
    assert {tuple(r) for r in D.classed_gradient(field, none, meta, 4).collect()} == want
    assert {tuple(r) for r in D.by_second_field(field, field, meta).collect()} == want
    cells = G.cell_extremes(G.cells(spark, meta).select("cid"), other, meta)
    label = {r.cid: r.vmax for r in cells.collect()}
    assert {r.cid: r.pair_cid for r in D.by_second_field(field, other, meta, 4).collect()} == plain_classed(values, shape, label)
    assert D.classed_gradient(field.limit(0), none, meta).count() == 0
    bnd = {r.cid: r.bnd for r in G.cells(spark, meta).collect()}
    halves = G.cells(spark, meta).select("cid", (F.col("cx") > 8).cast("int").alias("label"))
    grad = D.by_labels(field, halves, meta).collect()
    half = {r.cid: r.label for r in halves.collect()}
    assert all((half[r.cid], bnd[r.cid]) == (half[r.pair_cid], bnd[r.pair_cid]) for r in grad)


def test_marks_prune_saddle_arcs_without_a_change(spark):
    shape = (6, 5, 6)
    meta = GridMeta(*shape)
    _, field = field_of(spark, shape, 4)
    grad = cut(D.discrete_gradient(field, meta))
    marks = cut(D.ascending_dimensions(grad, meta))
    rows = {r.cid: r for r in grad.collect()}
    mesh = meta.mesh
    at = lambda i: (i % mesh[0], i // mesh[0] % mesh[1], i // (mesh[0] * mesh[1]))
    cid = lambda c: c[0] + mesh[0] * (c[1] + mesh[1] * c[2])
    want = {c: 3 for c in rows}
    for k in (1, 2):
        todo = [c for c, r in rows.items() if r.is_critical and r.dim == k]
        while todo:
            c = todo.pop()
            want[c] = 3 - k
            for q in map(cid, faces(at(c), mesh, 0)):
                if not rows[q].is_critical and rows[q].pair_cid != c and want[q] > 3 - k:
                    want[q] = 3 - k
                    todo.append(rows[q].pair_cid)
    want |= {c: 0 for c, r in rows.items() if r.is_critical and r.dim == 3}
    assert {r.cid: r.asc_dim for r in marks.collect()} == want
    arcs = lambda m: sorted(map(tuple, H.saddle_arcs(grad, meta, m).collect()))
    assert arcs(None) == arcs(marks) and arcs(None)
    assert marks.where("asc_dim < 3").join(grad.where("dim = 2"), "cid").count() < grad.where("dim = 2").count()


def test_planted_loops_come_back(spark):
    pointers = [(i, i + 1) for i in range(0, 40)] + [(40, 40)]  # a chain
    pointers += [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(200 + i, 201 + i) for i in range(20)] + [(220, 103)]
    pointers += [(300, 301), (301, 300), (310, None), (311, 310), (312, 999)]
    got = {r.id: (r.loop, r.on_loop) for r in iterate.loops(spark.createDataFrame(pointers, "id long, next long")).collect()}
    assert got == {100 + i: (100, True) for i in range(7)} | {200 + i: (100, False) for i in range(21)} | {300: (300, True), 301: (300, True)}
    assert iterate.loops(spark.createDataFrame([], "id long, next long")).count() == 0


@pytest.mark.parametrize("shape", [(9, 8, 1), (5, 4, 4)])
def test_restricted_growing_equals_a_heap(spark, shape):
    meta, draw = GridMeta(*shape), random.Random(6)
    edges = {r.cid: float(draw.randrange(30)) for r in G.cells(spark, meta, [1]).orderBy("cid").collect() if draw.random() < 0.7}
    mesh = meta.mesh
    at = lambda i: (i % mesh[0], i // mesh[0] % mesh[1], i // (mesh[0] * mesh[1]))
    cid = lambda c: c[0] + mesh[0] * (c[1] + mesh[1] * c[2])
    near = {e: {cid(f) for q in faces(at(e), mesh, 0) for f in faces(q, mesh, 1)} & set(edges) - {e} for e in edges}
    order = lambda e: (edges[e], e)
    queue, label, sure = [(-edges[e], -e) for e in edges], {}, {}
    heapq.heapify(queue)
    while queue:
        e = -heapq.heappop(queue)[1]
        done = [f for f in near[e] if f in label]
        label[e] = label[max(done, key=order)] if done else e
        sure[e] = all(sure[f] and label[f] == label[e] for f in done)
    df = spark.createDataFrame(list(edges.items()), "cid long, value double")
    assert {r.cid: r.label for r in regions.restricted_regions(df, meta).collect()} == label
    assert {r.cid: r.label for r in regions.restricted_regions(df, meta, certain=True).collect()} == {e: x for e, x in label.items() if sure[e]}


@pytest.mark.parametrize("shape", [(12, 9, 1), (6, 6, 5)])
def test_geodesic_density_equals_dijkstra(spark, shape):
    meta, draw = GridMeta(*shape), random.Random(8)
    n = int(np.prod(shape))
    value = [draw.random() for _ in range(n)]
    least, solid, budget = 0.2, 0.6, 3.0
    at = lambda i: (i % shape[0], i // shape[0] % shape[1], i // (shape[0] * shape[1]))
    want = {}
    for seed in range(0, n, 7):
        if value[seed] <= least:
            continue
        best, queue = {seed: 0.0}, [(0.0, seed)]
        while queue:
            d, v = heapq.heappop(queue)
            if d > best[v]:
                continue
            for w in range(n):
                gap = [abs(p - q) for p, q in zip(at(v), at(w))]
                if max(gap) == 1 and value[w] > least:
                    low = min(value[v], value[w], solid)
                    to = d + math.sqrt(sum(gap)) * (1 + (solid - low) / (solid - least))
                    if to <= budget and to < best.get(w, math.inf):
                        best[w] = to
                        heapq.heappush(queue, (to, w))
        want[seed] = len(best)
    field = spark.createDataFrame(list(enumerate(value)), "vid long, value double")
    seeds = spark.createDataFrame([(i,) for i in range(0, n, 7)], "vid long")
    got = regions.geodesic_density(seeds, field, meta, budget, least, solid).collect()
    assert {r.seed: r.volume for r in got} == want
    free = len({o for o in np.ndindex(*[9 if k > 1 else 1 for k in shape]) if (s := sorted((abs(x - 4) if k > 1 else 0 for x, k in zip(o, shape)), reverse=True)) and s[2] * 3 ** 0.5 + (s[1] - s[2]) * 2 ** 0.5 + s[0] - s[1] <= budget})
    assert {r.free for r in got} == {free} and all(r.density == r.volume / free for r in got)


def test_merged_lines_equal_a_recursive_version(spark):
    meta = GridMeta(12, 9)
    _, field = field_of(spark, (12, 9, 1), 2)
    field = cut(field)
    grad = cut(D.discrete_gradient(field, meta))
    nodes, arcs = cut(M.nodes(grad, field, meta)), cut(M.arcs(grad, field, meta))
    found = H.hierarchy(arcs, nodes, 60.0)
    lines = cut(merged.base_lines(grad, meta))
    base, made = defaultdict(dict), defaultdict(list)
    for r in sorted(lines.collect(), key=lambda r: r.pos):
        base[r.lower, r.upper].setdefault(r.side, []).append(r.cid)
    for r in found.made.collect():
        made[r.lower, r.upper].append((r.via_lower, r.via_upper))

    def ways(low, high):
        out = [tuple(c) for c in base[low, high].values()]
        for a, b in made[low, high]:
            out += [p + q[::-1] + r for p in ways(a, high) for q in ways(a, b) for r in ways(low, b)]
        return out

    def short(walk):
        held = []
        for c in walk:
            if held and held[-1] == c:
                continue
            if len(held) > 1 and held[-2] == c:
                held.pop()
            else:
                held.append(c)
        return tuple(held)

    want = {(r.lower, r.upper): sorted(map(short, ways(r.lower, r.upper))) for r in found.live.collect()}
    assert all(len(want[r.lower, r.upper]) == r.mult for r in found.live.collect()) and max(map(len, made.values())) >= 1
    got = defaultdict(dict)
    for r in merged.merged_lines(lines, found, found.live).orderBy("pos").collect():
        got[r.lower, r.upper].setdefault(r.number, []).append(r.cid)
    assert {k: sorted(map(tuple, v.values())) for k, v in got.items()} == want
    assert all(c[0] == k[1] and c[-1] == k[0] for k, v in got.items() for c in v.values())


@pytest.mark.parametrize("shape", [(11, 9, 1), (5, 5, 4)])
def test_convergent_gradient_equals_a_serial_version(spark, shape):
    meta = GridMeta(*shape)
    values, field = field_of(spark, shape, 12)
    n = len(values)
    at = lambda i: (i % shape[0], i // shape[0] % shape[1], i // (shape[0] * shape[1]))
    share, step = {}, {}
    for v in sorted(range(n), key=lambda i: (values[i], i)):
        low = [w for w in range(n) if sum(abs(p - q) for p, q in zip(at(v), at(w))) == 1 and (values[w], w) < (values[v], v)]
        if not low:
            share[v] = {v: 1.0}
            continue
        drops = [values[v] - values[w] for w in low]
        mix = defaultdict(float)
        for w, d in zip(low, drops):
            for dest, p in share[w].items():
                mix[dest] += p * (d / sum(drops) if sum(drops) else 1 / len(low))
        share[v] = dict(mix)
        step[v] = min(low, key=lambda w: (-round(sum(p * mix[dest] for dest, p in share[w].items()), 9), values[w], w))
    grad, got = D.convergent_gradient(field, meta, 4)
    grad, found = cut(grad), defaultdict(dict)
    for r in got.collect():
        found[r.vid][r.dest] = r.share
    assert set(found) == set(share)
    for v, want in share.items():
        assert found[v] == pytest.approx(want) and sum(found[v].values()) == pytest.approx(1)
    mesh = meta.mesh
    cid = lambda c: c[0] + mesh[0] * (c[1] + mesh[1] * c[2])
    rows = {r.cid: r for r in grad.collect()}
    for v in range(n):
        own = cid(tuple(2 * k for k in at(v)))
        want = cid(tuple(p + q for p, q in zip(at(v), at(step[v])))) if v in step else own
        assert rows[own].pair_cid == want
    assert D.violations(grad).count() == 0 and len(rows) == int(np.prod(mesh))
    assert sum((-1) ** r.dim for r in rows.values() if r.is_critical) == 1
    assert any(rows[r.cid].pair_cid != r.pair_cid for r in D.discrete_gradient(field, meta).collect())
