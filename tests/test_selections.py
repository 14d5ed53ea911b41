"""Small selections over nodes, arcs, lines and grids."""

import math

from pyspark.sql import functions as F

from isoweave.functions import calculus as C
from isoweave.functions import grid as G
from isoweave.operators import complex as M
from isoweave.operators import gradient as D
from isoweave.operators import lines
from isoweave.sources import raster

META = G.GridMeta(4, 3)


def test_arcs_and_nodes(spark):
    arcs = spark.createDataFrame([(1, 10, 0, 1, 5.0), (2, 10, 0, 1, 4.0), (10, 20, 1, 2, 3.0), (11, 20, 1, 1, 6.0), (2, 11, 0, 2, 1.0)], "lower long, upper long, dim int, mult long, persistence double")
    nodes = spark.createDataFrame([(1, 0, 0.0), (2, 0, 1.0), (10, 1, 5.0), (11, 1, 2.0), (20, 2, 8.0)], "nid long, dim int, value double")
    weight = {(r.lower, r.upper): r.weight for r in M.arc_weight(arcs).collect()}
    assert weight == {(1, 10): 0, (2, 10): 2, (10, 20): 2, (11, 20): 0, (2, 11): 2}
    assert {(r.nid, r.lower, r.upper) for r in M.incident(arcs, nodes.where("nid = 10")).collect()} == {(10, 1, 10), (10, 2, 10), (10, 10, 20)}
    assert {r.sid: r.ends for r in M.saddle_ends(arcs, 0).collect()} == {10: [1, 2], 11: [2]}
    assert {r.dim: r.n for r in M.summary(nodes).collect()} == {0: 2, 1: 2, 2: 1}
    assert M.valley_arcs(arcs).count() == 3 and M.ridge_arcs(arcs, META).count() == 2
    assert {(r.lower, r.upper) for r in M.filtered_arcs(arcs, nodes, low=1.0, high=5.0).collect()} == {(2, 10), (2, 11)}
    edges = spark.createDataFrame([(1, 2, 10, 5.0), (2, 1, 12, 4.0), (1, 3, 13, 9.0)], "e1 long, e2 long, sid long, svalue double")
    assert {(r.e1, r.e2, r.sid) for r in M.representative_saddles(edges).collect()} == {(1, 2, 12), (1, 3, 13)}
    assert {(r.limit, r.sid) for r in M.minimal_network(edges, [0.0, 5.0]).collect()} == {(0.0, 12), (0.0, 13), (5.0, 13)}
    pairs = spark.createDataFrame([(1, 2, 10, 1.0), (2, 3, 11, 2.0), (4, 3, 12, 9.0)], "nid long, into long, sid long, persistence double")
    assert {r.nid: r.root for r in M.constituents(pairs, 5.0).collect()} == {1: 3, 2: 3}
    assert M.limit_for_extrema(pairs, 2, 4).first().limit == 2.0


def test_grids_and_fields(spark):
    field = spark.createDataFrame([(i, float(i)) for i in range(12)], "vid long, value double")
    cells = G.cells(spark, META)
    assert {r.dim: r.n for r in G.dual(cells, META).groupBy("dim").agg(F.count("*").alias("n")).collect()} == {2: 12, 1: 17, 0: 6}
    mask = spark.createDataFrame([(i,) for i in (0, 1, 4, 5, 10)], "vid long")
    grad = D.restricted(field, mask, META)
    assert grad.count() == 9 + 1 and D.violations(grad).count() == 0
    assert raster.masked(field, mask).count() == 5
    assert {r.value for r in C.negate(field).collect()} == {-float(i) for i in range(12)}
    assert C.value_range(field).first().range == 11
    assert {r.vid: r.a for r in C.sample(mask, {"a": field}).collect()} == {i: float(i) for i in (0, 1, 4, 5, 10)}
    weighed = {r.vid: r.value for r in C.weigh(field, field).collect()}
    assert math.isclose(weighed[11], 1.001) and weighed[0] == 0
    near = {(r.vid, r.nvid) for r in G.neighbours(field, META, same_boundary=True).collect()}
    assert (5, 6) in near and (1, 2) in near and (0, 1) not in near and (1, 5) not in near
    assert {r.vid: round(r.value, 6) for r in C.magnitude(field, META).collect()}[5] == round(math.hypot(8, 32), 6)


def test_lines_and_planes(spark):
    rows = [(0, i, float(i), 0.0, 0.0) for i in range(5)] + [(1, i, float(i), 0.4 if i == 2 else 9.0, 0.0) for i in range(5)]
    df = spark.createDataFrame(rows, "line_id long, pos long, x double, y double, z double")
    left = {(r.line_id, r.pos) for r in lines.apart(df, 0.5).collect()}
    assert left == {(a, b) for a, b, *_ in rows} - {(0, 2), (1, 2)}
    assert {(r.line_id, r.side) for r in lines.graph_difference(df.where("line_id = 0"), df.where("pos < 4 and line_id = 0")).collect()} == {(0, "left")}
    plane = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0)], "pid long, x double, y double, z double, nx double, ny double, nz double, ux double, uy double, uz double")
    patch = {(round(r.px, 6), round(r.py, 6), r.pz) for r in lines.plane_patch(plane, 3, 3, 2.0).collect()}
    assert patch == {(float(a), float(b), 5.0) for a in (-2, 0, 2) for b in (-2, 0, 2)}
    assert math.isclose({r.line_id: r.gyration for r in lines.radius_of_gyration(df).collect()}[0], math.sqrt(2))


def test_slices_at_the_ends_and_at_one_place_have_no_angle(spark):
    at = [(0, 0.0, 0.0), (1, 3.0, 4.0), (2, 3.0, 4.0), (3, 3.0, 5.0), (4, 4.0, 5.0)]
    df = spark.createDataFrame([(7, p, 2.0, x, y, 0.0, 0.0) for p, x, y in at], "line_id long, pos long, area double, x double, y double, z double, arc double")
    got = {r.pos: (r.chord, r.angle) for r in lines.slice_records(df).collect()}
    assert [got[p][0] for p in range(5)] == [5.0, 0.0, 1.0, 1.0, None]
    assert [got[p][1] is None for p in range(5)] == [True, True, True, False, True] and abs(got[3][1] - 1.5707963) < 1e-6
