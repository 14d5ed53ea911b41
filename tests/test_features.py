"""Lines of cell graphs, ligaments, pruning, voids, descriptions and text files, against plain versions and round trips."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from isoweave.functions import grid as G
from isoweave.functions.grid import GridMeta
from isoweave.operators import accurate, features, geometry, merged, regions
from isoweave.operators import complex as M
from isoweave.operators import gradient as D
from isoweave.runtime import cut
from tests.test_complex import field_of


@pytest.fixture(scope="module")
def plane(spark):
    meta = GridMeta(12, 9)
    _, field = field_of(spark, (12, 9, 1), 5)
    field = cut(field)
    grad = cut(D.discrete_gradient(field, meta))
    return meta, field, grad, cut(M.nodes(grad, field, meta)), cut(M.arcs(grad, field, meta))


def joined(meta, cids):
    mx = meta.mesh[0]
    return {c: [d for d in (c - 1, c + 1, c - mx, c + mx) if d in cids and abs(d % mx - c % mx) <= 1] for c in cids}


def test_lines_of_a_cell_graph(spark, plane):
    meta, _, grad, _, _ = plane
    soup = cut(geometry.line_soup(geometry.arc_geometry(grad, meta)))
    cids = {r.cid for r in soup.collect()}
    near = joined(meta, cids)
    by = defaultdict(list)
    for r in features.graph_lines(geometry.mesh_graph(soup, meta), meta).orderBy("edge_id", "pos").collect():
        by[r.edge_id].append((r.pos, r.cid))
    seen, pairs = [], []
    for line, rows in by.items():
        assert [p for p, _ in rows] == list(range(len(rows)))
        line = [c for _, c in rows]
        assert all(b in near[a] for a, b in zip(line, line[1:]))
        assert all(len(near[c]) != 2 for c in (line[0], line[-1])) and all(len(near[c]) == 2 for c in line[1:-1]) and line[0] <= line[-1]
        seen += line[1:-1]
        pairs += [frozenset(p) for p in zip(line, line[1:])]
    assert sorted(seen) == sorted(c for c in cids if len(near[c]) == 2)
    assert sorted(map(sorted, pairs)) == sorted(sorted(p) for p in {frozenset((a, b)) for a in near for b in near[a]})
    vertices, ends, lines = features.ridge_graph(soup, meta, smoothing=2)
    assert vertices.count() == sum(len(x) != 2 for x in near.values()) and ends.count() == len(by) and lines.count() == sum(map(len, by.values()))


def test_a_loop_at_one_vertex(spark):
    meta = GridMeta(6, 6)
    at = lambda x, y: x + 11 * y
    ring = [at(2, 2), at(3, 2), at(4, 2), at(4, 3), at(4, 4), at(3, 4), at(2, 4), at(2, 3)]
    soup = spark.createDataFrame([(c,) for c in [*ring, at(1, 2), at(0, 2)]], "cid long")
    got = defaultdict(list)
    for r in features.graph_lines(geometry.mesh_graph(soup, meta), meta).orderBy("edge_id", "pos").collect():
        got[r.edge_id].append(r.cid)
    assert sorted(got.values()) == sorted([[at(0, 2), at(1, 2), at(2, 2)], [at(2, 2), at(3, 2), at(4, 2), at(4, 3), at(4, 4), at(3, 4), at(2, 4), at(2, 3), at(2, 2)]])


def test_ligaments(spark, plane):
    meta, _, grad, nodes, arcs = plane
    lines = cut(merged.base_lines(grad, meta))
    value, dim = ({r.nid: r[k] for r in nodes.collect()} for k in ("value", "dim"))
    by = defaultdict(list)
    for r in lines.orderBy("pos").collect():
        if dim[r.lower] == 1 and dim[r.upper] == 2:
            by[r.lower, r.upper].append(r.cid)
    want = {}
    for s in {s for s, _ in by}:
        tops = sorted(u for a, u in by if a == s)
        if len(tops) == 2 and value[s] >= 50:
            want[s] = by[s, tops[0]] + by[s, tops[1]][-2::-1]
    got = defaultdict(list)
    for r in features.ligament_lines(lines, nodes, meta, 50.0).orderBy("pos").collect():
        got[r.sid].append(r.cid)
    assert got == want and want
    mask = spark.createDataFrame([(c,) for line in want.values() for c in line if c % 3], "cid long")
    cutout = defaultdict(list)
    for r in features.ligament_lines(lines, nodes, meta, 50.0, mask).orderBy("pos").collect():
        assert r.pos == len(cutout[r.sid])
        cutout[r.sid].append(r.cid)
    assert cutout == {s: [c for c in line if c % 3] for s, line in want.items()}


def test_pruned_lines(spark):
    meta = GridMeta(10, 10)
    rows = [(7, 0, 0.5, 5.0), (7, 1, 5.0, 5.0), (8, 0, 3.0, 3.0), (8, 1, 6.0, 6.0), (9, 0, 3.0, 3.0), (9, 1, 4.0, 8.7), (12, 0, 4.0, 4.0), (12, 1, 4.2, 5.0)]
    lines = spark.createDataFrame([(*r, 0.0) for r in rows], "line_id long, pos long, x double, y double, z double")
    kept = features.pruned_lines(lines, meta, 1.0)
    assert sorted((r.line_id, r.x) for r in kept.collect()) == [(0, 3.0), (0, 6.0), (1, 4.0), (1, 4.2)]
    mask = spark.createDataFrame([(3 + 30,), (6 + 60,)], "vid long")
    assert sorted((r.line_id, r.x) for r in features.pruned_lines(lines, meta, 1.0, mask).collect()) == [(0, 3.0), (0, 6.0)]


def test_void_of_known_shape(spark):
    places = {1: (5, 5, 0), 11: (4, 5, 0), 12: (6, 5, 0), 21: (0, 5, 0), 22: (10, 5, 0), 23: (5, 8, 0), 24: (5, 3, 0)}
    nodes = spark.createDataFrame([(i, 0 if i == 1 else 1 if i < 20 else 2, 0, *map(float, p)) for i, p in places.items()], "nid long, dim int, bnd int, x double, y double, z double")
    arcs = spark.createDataFrame([(1, 11), (1, 12), (11, 21), (11, 23), (12, 22), (12, 24)], "lower long, upper long")
    r = features.voids(arcs, nodes, GridMeta(11, 11)).collect()
    assert len(r) == 1 and r[0].n_maxima == 4 and (r[0].length1, r[0].length2, r[0].length3) == pytest.approx((10.0, 5.0, 0.0), abs=1e-6)


def test_descriptions(spark, plane):
    meta, field, *_ = plane
    value = {r.vid: r.value for r in field.collect()}
    for r in features.described(G.cells(spark, meta).select("cid"), meta, field).collect():
        cx, cy = r.cid % 23, r.cid // 23
        corner = [value[x + 12 * y] for x in {cx // 2, (cx + 1) // 2} for y in {cy // 2, (cy + 1) // 2}]
        assert (r.x, r.y, r.dim) == (cx / 2, cy / 2, cx % 2 + cy % 2) and r.value == pytest.approx(sum(corner) / len(corner))
        assert r.vid == (cx // 2 + 12 * (cy // 2) if r.dim == 0 else None)


def test_graph_text_and_sub_volumes_round_trip(spark, tmp_path):
    draw = random.Random(3)
    geometry_rows = [(g, g % 2, p, *(draw.uniform(-5, 5) for _ in range(3))) for g in range(20) for p in range(1 if g % 2 == 0 else draw.randrange(1, 15))]
    geom = spark.createDataFrame(geometry_rows, "geom long, dim int, pos long, x double, y double, z double")
    nodes = spark.createDataFrame([(g,) for g in range(0, 20, 2)], "geom long")
    edges = spark.createDataFrame([(g, g - 1, g + 1) for g in range(1, 19, 2)], "geom long, node1 long, node2 long")
    features.write_graph_text(nodes, edges, geom, f"{tmp_path}/graph")
    for a, b in zip(features.read_graph_text(spark, f"{tmp_path}/graph"), (nodes, edges, geom)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    meta = GridMeta(8, 8)
    labels = cut(regions.components(spark.createDataFrame([(v,) for v in (9, 10, 17, 45, 46)], "vid long"), meta))
    field = cut(spark.range(64).select(F.col("id").alias("vid"), (F.col("id") * 1.0).alias("value")))
    volumes = cut(regions.sub_volumes(labels, field, meta))
    features.write_sub_volumes(volumes, regions.bounding_boxes(labels, meta), f"{tmp_path}/boxes")
    back = spark.read.parquet(f"{tmp_path}/boxes")
    assert sorted(map(tuple, back.select("label", "vid", "value").collect())) == sorted(map(tuple, volumes.collect()))
    assert {r.box for r in back.select("box").distinct().collect()} == {"9_0_0_0_4_4_1", "45_4_4_0_4_3_1"}


def test_skeleton_of_four_regions(spark):
    meta = GridMeta(6, 6, 6)
    x, y, z = F.col("id") % 6, F.floor(F.col("id") / 6) % 6, F.floor(F.col("id") / 36)
    labels = cut(spark.range(216).select(F.col("id").alias("vid"), F.when(z >= 3, 9).when(x < 3, F.when(y < 3, 1).otherwise(2)).otherwise(3).cast("long").alias("label")))
    skeleton, forced = regions.stratified_skeleton(cut(regions.boundary_map(labels, G.cells(spark, meta), meta)))
    graph = {r.cid: r for r in geometry.mesh_graph(skeleton, meta, forced).collect()}
    at = lambda c: (c % 11, c // 11 % 11, c // 121)
    assert {at(r.cid) for r in forced.collect()} == {(5, 5, 5)}
    assert all(5 in at(c) for c in graph) and graph[5 + 11 * 5 + 121 * 5].is_vertex
    # the line between three regions goes down from the point where all four meet
    assert {(5, 5, k) for k in range(5)} <= set(map(at, graph))


def test_accurate_gradient_keeps_to_its_regions(spark):
    meta = GridMeta(13, 9)
    x, y = F.col("id") % 13, F.floor(F.col("id") / 13)
    bowl = lambda cx: F.exp(-((x - cx) * (x - cx) + (y - 4.2) * (y - 4.2)) / 9.0)
    field = spark.range(meta.size).select(F.col("id").alias("vid"), (-bowl(3) - 0.9 * bowl(9.3)).alias("value"))
    grad, labels = accurate.accurate_gradient(field, meta, steps=4, rounds=3)
    label = {r.vid: r.label for r in labels.collect()}
    assert len(label) == meta.size and len(set(label.values())) == 2
    rows = {r.cid: r for r in grad.collect()}
    mx = meta.mesh[0]
    corners = lambda c: {label[a + 13 * b] for a in {c % mx // 2, (c % mx + 1) // 2} for b in {c // mx // 2, (c // mx + 1) // 2}}
    assert all((len(corners(c)) > 1) == (len(corners(r.pair_cid)) > 1) for c, r in rows.items())
    assert sum((-1) ** r.dim for r in rows.values() if r.is_critical) == 1
    ends = {r.cid: r.label for r in M.ends_down(grad, meta).collect()}
    for c, e in ends.items():
        assert corners(c) == corners(e), "a path crossed a border"
    assert math.isclose(sum(r.is_critical and r.dim == 0 for r in rows.values()), sum(1 for c, e in ends.items() if c == e))
