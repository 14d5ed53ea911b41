"""Surfaces, cross sections, digitised lines and integration labels against known shapes and plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoweave.functions.grid import GridMeta, cells, facets
from isoweave.functions import calculus as C
from isoweave.operators import advect, regions, surfaces
from isoweave.operators import complex as M
from isoweave.operators import gradient as D
from isoweave.runtime import cut


def test_plane_between_two_halves(spark):
    meta = GridMeta(8, 7, 6)
    labels = spark.range(meta.size).select(F.col("id").alias("vid"), F.when(F.col("id") % 8 < 3, 5).otherwise(9).cast("long").alias("label"))
    r = surfaces.separating_surfaces(labels, meta, times=0).collect()[0]
    assert (r.label1, r.label2, r.n_quads) == (5, 9, 5 * 4) and math.isclose(r.area, 20.0)
    assert (r.nx, r.ny, r.nz) == pytest.approx((1, 0, 0)) and (r.x, r.y, r.z) == pytest.approx((2.5, 3.0, 2.5))
    assert (r.e1, r.e2, r.e3) == pytest.approx((35 / 12, 2.0, 0.0), abs=1e-9)  # corners 0.5 .. 5.5 by 0.5 .. 4.5


def test_sphere(spark):
    n, r0 = 21, 7.0
    meta = GridMeta(n, n, n)
    at = [(F.col("vid") % n), F.floor(F.col("vid") / n) % n, F.floor(F.col("vid") / (n * n))]
    ball = sum(((c - 10) * (c - 10) for c in at), F.lit(0.0)) <= r0 * r0
    labels = spark.range(meta.size).withColumnRenamed("id", "vid").select("vid", ball.cast("long").alias("label"))
    r = surfaces.separating_surfaces(labels, meta, times=10).collect()[0]
    assert 0.85 < r.area / (4 * math.pi * r0 * r0) < 1.1
    assert (r.x, r.y, r.z) == pytest.approx((10, 10, 10), abs=1e-6) and r.nx is None
    assert r.e1 == pytest.approx(r.e3, rel=1e-6) and 0.85 < r.e1 * 3 / (r0 * r0) < 1.1


def test_eigenvalues(spark):
    draw = np.random.default_rng(1)
    rows = []
    for _ in range(20):
        m = draw.normal(size=(3, 3))
        m = m @ m.T
        rows.append([float(x) for x in (m[0, 0], m[1, 1], m[2, 2], m[0, 1], m[0, 2], m[1, 2])])
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    got = df.select(*df.columns, *[c.alias(f"v{i}") for i, c in enumerate(surfaces.eigenvalues(*[F.col(c) for c in df.columns]))]).collect()
    for r in got:
        m = np.array([[r.a, r.d, r.e], [r.d, r.b, r.f], [r.e, r.f, r.c]])
        assert [r.v0, r.v1, r.v2] == pytest.approx(sorted(np.linalg.eigvalsh(m), reverse=True), abs=1e-6)


def test_cross_sections_of_tubes(spark):
    meta = GridMeta(21, 21, 12)
    x, y = F.col("id") % 21, F.floor(F.col("id") / 21) % 21
    tube = lambda cx, cy, r: r - F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))
    field = cut(spark.range(meta.size).select(F.col("id").alias("vid"), F.greatest(tube(7, 10, 4.0), tube(16, 10, 3.0)).alias("value")))
    points = [(1, 7.0, 10.0, 5.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0), (2, 16.0, 10.0, 5.0, 0.0, 0.0, 2.0, 1.0, 0.0, 0.0), (3, 0.0, 0.0, 5.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame(points, "pid long, x double, y double, z double, nx double, ny double, nz double, ux double, uy double, uz double")
    got = {r.pid: r for r in surfaces.cross_sections(df, field, meta, 41, 10.0).collect()}
    assert set(got) == {1, 2}
    for pid, r0 in ((1, 4.0), (2, 3.0)):
        assert got[pid].area == pytest.approx(math.pi * r0 * r0, rel=0.1)
        assert got[pid].perimeter == pytest.approx(8 * r0, rel=0.12) and got[pid].walk_out == pytest.approx(r0, abs=0.5)


@pytest.mark.parametrize("shape", [(9, 7, 1), (6, 5, 7)])
def test_digitised_cells_are_incident(spark, shape):
    meta, draw = GridMeta(*shape), random.Random(2)
    rows = []
    for pid in range(12):
        for step in range(9):
            rows.append((pid, step, *[float(draw.choice([draw.uniform(-1, n), draw.randrange(n)])) if n > 1 else 0.0 for n in shape]))
    df = spark.createDataFrame(rows, "pid long, step int, px double, py double, pz double")
    incident = set()
    for r in facets(cells(spark, meta).select("cid"), meta).collect():
        incident |= {(r.cid, r.fcid), (r.fcid, r.cid)}
    top, by = len(meta.axes), {}
    for r in advect.digitised(df, meta).orderBy("pid", "pos").collect():
        by.setdefault(r.pid, []).append(r.cid)
    dim = {r.cid: r.dim for r in cells(spark, meta).collect()}
    assert set(by) == set(range(12))
    for pid, line in by.items():
        assert all(p in incident for p in zip(line, line[1:]))
        assert [dim[c] for c in line] == [top if i % 2 == 0 else top - 1 for i in range(len(line))]
        mesh = meta.mesh
        spot = [min(max(v, 0.0), n - 1.0) for v, n in zip([r for r in rows if r[0] == pid][-1][2:], shape)]
        box = [2 * min(math.floor(v), n - 2) + 1 if n > 1 else 0 for v, n in zip(spot, shape)]
        assert line[-1] == box[0] + mesh[0] * (box[1] + mesh[1] * box[2])


def test_integration_labels_of_two_hills(spark):
    meta = GridMeta(17, 9)
    x, y = F.col("id") % 17, F.floor(F.col("id") / 17)
    hill = lambda cx: F.exp(-((x - cx) * (x - cx) + (y - 4) * (y - 4)) / 8.0)
    field = cut(spark.range(meta.size).select(F.col("id").alias("vid"), (hill(4) + hill(12)).alias("value")))
    peaks = {4 + 17 * 4: 4, 12 + 17 * 4: 12}
    near = [(i, p) for i in range(meta.size) for p, cx in peaks.items() if abs(i % 17 - cx) <= 1 and abs(i // 17 - 4) <= 1]
    got = {r.vid: r.label for r in advect.integration_labels(field, spark.createDataFrame(near, "vid long, label long"), meta, steps=6, rounds=6).collect()}
    assert set(got) == set(range(meta.size))
    assert all(got[i] == 4 + 17 * 4 for i in got if i % 17 < 8) and all(got[i] == 12 + 17 * 4 for i in got if i % 17 > 8)
    some = advect.integration_labels(field, spark.createDataFrame(near, "vid long, label long"), meta, steps=6, rounds=6, background=0.5)
    assert {r.vid for r in some.collect()} == {r.vid for r in field.where("value > 0.5").collect()} | {i for i, _ in near}


def test_descents_from_saddles(spark):
    meta = GridMeta(17, 13)
    field = spark.range(meta.size).selectExpr("id as vid", "1000 * sin(id % 17 * 0.8D) * cos(floor(id / 17) * 0.7D) + id * 0.01D as value")
    grad = D.discrete_gradient(field, meta)
    saddles = M.nodes(grad, field, meta).where("dim = 1")
    paths = cut(advect.saddle_descents(saddles, field, meta, max_steps=8))
    assert paths.select("pid").distinct().count() == 2 * saddles.count() > 4
    points = paths.selectExpr("pid * 1000 + step as pid", "px", "py", "pz" if "pz" in paths.columns else "0D as pz")
    value = {r.pid: r.value for r in C.interpolate(points, field, meta).collect()}
    ends = {}
    for r in paths.where("event = 'none'").collect():
        ends.setdefault(r.pid, []).append((r.step, value[r.pid * 1000 + r.step]))
    # each path goes down, but for what linear interpolation adds within a box
    assert all(max(v)[1] <= min(v)[1] + 25 for v in ends.values()) and sum(max(v)[1] < min(v)[1] for v in ends.values()) > 0.8 * len(ends)
