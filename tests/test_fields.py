"""Field operators without SQL, held against plain loops on small grids."""

import heapq
import struct

import numpy as np

from isoweave.functions import calculus as C
from isoweave.functions import grid as G
from isoweave.operators import iterate, lines, regions
from isoweave.sources import raster

META = G.GridMeta(7, 5)


def small(spark, meta=META, seed=1):
    values = np.random.default_rng(seed).permutation(meta.size).astype(float)
    return values, spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "vid long, value double")


def test_cells_facets_and_cofacets_mirror_each_other(spark):
    for meta in (META, G.GridMeta(3, 4, 2), G.GridMeta(4, 3, 1, (True, False, False))):
        cells = G.cells(spark, meta)
        dims = {r.cid: r.dim for r in cells.collect()}
        down = {(r.cid, r.fcid) for r in G.facets(cells.select("cid"), meta).collect()}
        up = {(r.ccid, r.cid) for r in G.cofacets(cells.select("cid"), meta).collect()}
        assert down == up and all(dims[a] == dims[b] + 1 for a, b in down)
        assert sum((-1) ** d for d in dims.values()) == (0 if any(meta.periodic) else 1)
        corners = {}
        for r in G.cell_vertices(cells.select("cid", "dim"), meta).collect():
            corners.setdefault(r.cid, set()).add(r.vid)
        assert all(len(v) == 2 ** dims[c] for c, v in corners.items()) and set(corners) == set(dims)
        near = {(r.cid, r.acid) for r in G.star(cells.select("cid"), meta).collect()}
        assert down <= near and all((b, a) in near for a, b in near)


def test_masks_keep_cells_with_all_their_vertices(spark):
    cells = G.cells(spark, META)
    mask = spark.createDataFrame([(i,) for i in (0, 1, 7, 8, 20)], "vid long")
    kept = {r.cid for r in G.cell_mask(cells, mask, META).collect()}
    assert kept == {0, 1, 2, 13, 15, 26, 27, 28, 14, 20 % 7 * 2 + 20 // 7 * 2 * 13}


def test_interpolation_and_gradients_are_exact_on_planes(spark):
    field = spark.createDataFrame([(i, 3.0 * (i % 7) - 2.0 * (i // 7) + 1) for i in range(35)], "vid long, value double")
    points = spark.createDataFrame([(0, 0.0, 0.0), (1, 2.5, 3.25), (2, 6.0, 4.0), (3, 5.9, 0.1)], "pid long, px double, py double")
    got = {r.pid: r.value for r in C.interpolate(points, field, META).collect()}
    assert all(abs(got[p] - (3 * x - 2 * y + 1)) < 1e-9 for p, x, y in ((0, 0, 0), (1, 2.5, 3.25), (2, 6, 4), (3, 5.9, 0.1)))
    for order in (2, 4, 6, 8):
        assert all(abs(r.dx - 3) < 1e-9 and abs(r.dy + 2) < 1e-9 for r in C.gradient(field, META, order).collect())


def test_convolution_against_loops(spark):
    values, field = small(spark)
    at = values.reshape(5, 7)
    for name, size in (("gauss", 5), ("box", 3), ("sharpen", 3), ("identity", 3), ("sobel_y", 3)):
        for border in ("clamp", "zero"):
            weights = C.kernel(name, size)
            got = {r.vid: r.value for r in C.convolve(field, META, weights, border).collect()}
            for y in range(5):
                for x in range(7):
                    want = 0.0
                    for (dx, dy), w in weights:
                        p, q = x + dx, y + dy
                        if border == "clamp":
                            want += w * at[min(max(q, 0), 4), min(max(p, 0), 6)]
                        elif 0 <= p < 7 and 0 <= q < 5:
                            want += w * at[q, p]
                    assert abs(got.get(x + 7 * y, 0.0) - want) < 1e-9


def test_normalising_masking_and_raw_files(spark, tmp_path):
    values, field = small(spark)
    assert {r.vid: r.value for r in C.normalised(field).collect()} == {i: v / 34 for i, v in enumerate(values)}
    assert C.threshold(field, 10, 20).count() == 10 and C.threshold(field, 10, 20, strict=False).count() == 11
    (tmp_path / "a.raw").write_bytes(b"".join(struct.pack("<f", v) for v in values))
    assert {r.vid: r.value for r in raster.read_raw(spark, f"{tmp_path}/a.raw", META).collect()} == dict(enumerate(values))
    rows = spark.createDataFrame([(y, [float(v) for v in values[7 * y:7 * y + 7]]) for y in range(5)], "row long, values array<double>")
    assert {r.vid: r.value for r in raster.from_rows(rows, META).collect()} == dict(enumerate(values))
    raster.write_table(field, f"{tmp_path}/t")
    assert raster.read_table(spark, f"{tmp_path}/t").count() == 35


def test_boundary_kinds_and_separators(spark):
    labels = spark.createDataFrame([(0, 1), (1, 2), (2, 1), (3, 3)], "vid long, label long")
    meta = G.GridMeta(2, 2)
    kinds = {r.cid: r.kind for r in regions.boundary_map(labels, G.cells(spark, meta), meta).collect()}
    assert kinds == {0: 0, 1: 1, 2: 0, 3: 0, 4: 2, 5: 1, 6: 0, 7: 1, 8: 0}
    assert {(r.cid, r.label1, r.label2) for r in regions.separators(labels, meta).collect()} == {(1, 1, 2), (5, 2, 3), (7, 1, 3)}


def test_certain_regions_and_islands(spark):
    values, field = small(spark, seed=3)
    labels = {r.vid: r.label for r in regions.basins(field, META).collect()}
    certain = {r.vid: r.label for r in regions.certain_regions(field, META).collect()}
    near = lambda v: [w for w in (v - 1 if v % 7 else -1, v + 1 if v % 7 < 6 else -1, v - 7, v + 7) if 0 <= w < 35]
    want = {}
    for v in np.argsort(-values).tolist():
        higher = [w for w in near(v) if values[w] > values[v]]
        if not higher:
            want[v] = v
        elif all(w in want for w in higher) and len({want[w] for w in higher}) == 1:
            want[v] = want[higher[0]]
    assert certain == want and all(labels[v] == x for v, x in want.items())
    meta = G.GridMeta(5, 1)
    line = spark.createDataFrame([(i, v) for i, v in enumerate([9.0, 8.0, 7.0, 6.0, 5.0])], "vid long, value double")
    broken = spark.createDataFrame([(0, 0), (1, 0), (2, 4), (3, 0), (4, 4)], "vid long, label long")
    assert {r.label for r in regions.merge_islands(broken, line, meta).collect()} == {0}


def test_nearest_sources_and_paths_against_dijkstra(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, 25, 70), rng.integers(0, 25, 70), rng.integers(1, 9, 70)) if a != b]
    df = spark.createDataFrame(edges, "src long, dst long, weight long")
    sources = spark.createDataFrame([(0,), (7,)], "vertex long")
    best, heap = {}, [(0, 0, 0), (0, 7, 7)]
    while heap:
        d, s, v = heapq.heappop(heap)
        if v not in best:
            best[v] = (d, s)
            for a, b, w in edges:
                if a == v:
                    heapq.heappush(heap, (d + w, s, b))
    got = {r.vertex: (r.dist, r.source) for r in iterate.nearest_source(df, sources).collect()}
    assert got == best
    far = max(best, key=lambda v: best[v])
    path = iterate.shortest_path(df, sources, spark.createDataFrame([(far,)], "vertex long")).orderBy("pos").collect()
    assert path[-1].vertex == far and path[-1].dist == best[far][0] and path[0].dist == 0


def test_points_lines_and_line_graphs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, p)) for i, p in enumerate(rng.random((60, 3)) * 4)]
    points = spark.createDataFrame(rows, "pid long, x double, y double, z double")
    dist = lambda a, b: float(np.linalg.norm(np.subtract(a[1:], b[1:])))
    got = {(r.pid, r.r_pid) for r in lines.within(points, points, 0.7).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if dist(a, b) <= 0.7}
    near = {r.pid: r.r_pid for r in lines.nearest(points, points.withColumn("x", points["x"] + 0.001), 0.7, "pid", tie="pid").collect()}
    assert near == {i: i for i in range(60)}
    cells = spark.createDataFrame([(1, 0, 0, 3, 1), (2, 2, 2, 2, 2)], "segment_id long, x0 long, y0 long, x1 long, y1 long")
    assert sorted((r.segment_id, r.x, r.y) for r in lines.rasterised(cells).collect()) == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 1), (2, 2, 2)]
    graph = spark.createDataFrame([(1, 10, 11), (2, 11, 12), (3, 11, 13)], "line_id long, vertex1 long, vertex2 long")
    assert {tuple(r) for r in lines.line_graph(graph).collect()} == {(10, 1, -1), (12, 2, -1), (13, 3, -1), (11, 1, 2), (11, 1, 3), (11, 2, 3)}
    straight = spark.createDataFrame([(0, i, float(i), 0.0, 0.0) for i in range(9)], "line_id long, pos long, x double, y double, z double")
    assert [r.x for r in lines.decimate(straight, 0.5).orderBy("pos").collect()] == [0.0, 8.0]
    assert lines.smooth(straight, 3).orderBy("pos").collect()[4].x == 4.0
    from pyspark.sql import functions as F

    assert lines.point_at(straight, F.lit(2.25)).collect()[0].x == 2.25 and lines.point_at(straight, F.lit(8.0)).collect()[0].x == 8.0
