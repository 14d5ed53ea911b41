import numpy as np

from isoweave.functions.grid import GridMeta
from isoweave.operators import advect, meshes
from isoweave.operators.iterate import terminal


def test_mesh_relations_and_functions(spark):
    n = 4
    vertices = spark.createDataFrame([(i + n * j, float(i), float(j), 0.0) for j in range(n) for i in range(n)], "id long, x double, y double, z double")
    tri = [t for j in range(n - 1) for i in range(n - 1) for a in [i + n * j] for t in ((a, a + 1, a + n), (a + 1, a + n + 1, a + n))]
    triangles = spark.createDataFrame([(k, *t) for k, t in enumerate(tri)], "tid long, a long, b long, c long")
    e = meshes.edges_of(triangles)
    assert (e.count(), e.where("is_boundary").count()) == (33, 12)
    assert meshes.euler(triangles).first().euler == 1 and meshes.facets_of(triangles).count() == 3 * len(tri)
    assert meshes.boundary_vertices(triangles).count() == 12
    first = meshes.triangle_centroids(triangles, vertices).where("tid = 0").first()
    assert np.allclose((first.x, first.y, first.z), (1 / 3, 1 / 3, 0))
    values = vertices.select("id", meshes.rotated(0.3).alias("value"))
    to = meshes.steepest(triangles, values).selectExpr("id", "next")
    assert {r.root for r in terminal(to).collect()} == {15}


def test_streamlines_climb_and_say_why_they_stop(spark):
    meta = GridMeta(11, 9)
    hill = spark.createDataFrame([(x + 11 * y, -((x - 5.0) ** 2) - (y - 4.0) ** 2) for y in range(9) for x in range(11)], "vid long, value double")
    seeds = spark.createDataFrame([(0, 1.0, 1.0), (1, 9.0, 7.0), (2, 5.0, 4.0)], "pid long, px double, py double")
    rows = advect.streamlines(seeds, hill, meta, max_steps=14).collect()
    by = {}
    for r in rows:
        by.setdefault(r.pid, []).append((r.step, -((r.px - 5) ** 2) - (r.py - 4) ** 2, r.event))
    assert sorted(by[2])[-1][2] == "flat"
    for p in (0, 1):
        heights = [h for _, h, e in sorted(by[p]) if e == "none"]
        assert all(a <= b + 0.3 for a, b in zip(heights, heights[1:])) and heights[-1] > -1
    down = advect.streamlines(seeds.where("pid < 2"), hill, meta, up=False, max_steps=8).collect()
    assert {r.pid for r in down if r.event == "border"} == {0, 1}
