"""Surfaces between regions of a volume, and plane cross sections through it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoweave.functions import grid as G
from isoweave.functions.calculus import interpolate
from isoweave.functions.grid import GridMeta
from isoweave.operators.iterate import connected_components
from isoweave.operators.lines import plane_patch
from isoweave.operators.regions import separators
from isoweave.runtime import cut, cut_in_loop

NAMES = ("x", "y", "z")


def separating_quads(labels: DataFrame, meta: GridMeta) -> DataFrame:
    """(label1, label2, cid, way, corner, vertex): the dual quad of every edge between two regions, its corners in order.

    Corners are the four volume cells around the edge; ``way`` is 1 where the region ahead along the edge is ``label2``.  Edges on the grid's border have
    no whole quad and are left out.
    """
    edges = separators(labels, meta)
    at = G.coordinates(F.col("cid"), meta.mesh)
    corners, whole = [], F.lit(False)
    for a in range(3):
        b, c = (a + 1) % 3, (a + 2) % 3
        own, inner = at[a] % 2 == 1, F.lit(True)
        for k in (b, c):
            if not meta.periodic[k]:
                inner = inner & at[k].between(1, meta.mesh[k] - 2)
        whole = whole | (own & inner)
        for i, (p, q) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1))):
            to = list(at)
            to[b], to[c] = G.wrapped(at[b] + p, meta.mesh[b], meta.periodic[b]), G.wrapped(at[c] + q, meta.mesh[c], meta.periodic[c])
            corners.append(F.when(own, F.struct(F.lit(i).alias("corner"), G.index(meta.mesh, *to).alias("vertex"))))
    ahead = [F.least(F.floor((k + 1) / 2), F.lit(n - 1)) if not p else F.pmod(F.floor((k + 1) / 2), F.lit(n)) for k, n, p in zip(at, meta.shape, meta.periodic)]
    met = edges.where(whole).withColumn("_ahead", G.index(meta.shape, *ahead)).join(labels.select(F.col("vid").alias("_ahead"), F.col("label").alias("_l")), "_ahead")
    out = met.select("label1", "label2", "cid", F.when(F.col("_l") == F.col("label2"), 1).otherwise(-1).alias("way"), F.explode(F.array_compact(F.array(*corners))).alias("c"))
    return out.select("label1", "label2", "cid", "way", "c.corner", "c.vertex")


def smoothed_vertices(quads: DataFrame, meta: GridMeta, times: int, weight: float = 0.5) -> DataFrame:
    """(label1, label2, vertex, x, y, z): the corners of each surface, moved ``times`` times towards the mean of their neighbours."""
    key = ["label1", "label2", "vertex"]
    points = quads.select(*key).distinct()
    points = cut_in_loop(points.select(*key, *[(c * 0.5).alias(n) for c, n in zip(G.coordinates(F.col("vertex"), meta.mesh), NAMES)]))
    ring = quads.select("label1", "label2", "cid", "corner", "vertex")
    after = ring.select("label1", "label2", "cid", F.pmod(F.col("corner") - 1, F.lit(4)).alias("corner"), F.col("vertex").alias("other"))
    sides = ring.join(after, ["label1", "label2", "cid", "corner"]).select(*key, "other")
    sides = cut_in_loop(sides.union(sides.select("label1", "label2", "other", "vertex")).distinct())
    for _ in range(times):
        near = sides.join(points.withColumnRenamed("vertex", "other"), ["label1", "label2", "other"]).groupBy(*key).agg(*[F.avg(n).alias(f"_{n}") for n in NAMES])
        points = cut_in_loop(points.join(near, key).select(*key, *[(F.col(n) * (1 - weight) + F.col(f"_{n}") * weight).alias(n) for n in NAMES]))
    return points


def eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> list[Column]:
    """The eigenvalues of a symmetric 3 x 3 matrix, largest first, by the angle of its scaled determinant."""
    mean = (xx + yy + zz) / 3
    size = F.sqrt(((xx - mean) * (xx - mean) + (yy - mean) * (yy - mean) + (zz - mean) * (zz - mean) + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    a, b, c, d, e, f = ((xx - mean) / size, (yy - mean) / size, (zz - mean) / size, xy / size, xz / size, yz / size)
    half = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    angle = F.acos(F.greatest(F.least(half, F.lit(1.0)), F.lit(-1.0))) / 3
    turned = [F.when(size < 1e-300, mean).otherwise(mean + 2 * size * F.cos(angle + k * 2 * math.pi / 3)) for k in (0, 2, 1)]
    return turned


def separating_surfaces(labels: DataFrame, meta: GridMeta, times: int = 5, values: DataFrame | None = None) -> DataFrame:
    """One row for each two regions with a common border: (label1, label2, n_quads, area, x, y, z, nx, ny, nz, e1, e2, e3[, mean, low, high]).

    The centre and the eigenvalues are those of the smoothed corners; the normal is the sum of the quads' normals, to length 1, from ``label1`` to
    ``label2``, and null where that sum is 0.  ``values`` (cid, value) of volume cells gives mean, least and greatest over the corners.
    """
    quads = cut(separating_quads(labels, meta))
    points = cut(smoothed_vertices(quads, meta, times))
    key = ["label1", "label2"]
    met = quads.join(points, [*key, "vertex"]).groupBy(*key, "cid", "way").agg(F.array_sort(F.collect_list(F.struct("corner", *NAMES))).alias("c"))  # four corners
    diagonal = lambda i, j: [F.col("c")[j][n] - F.col("c")[i][n] for n in NAMES]
    p, q = diagonal(0, 2), diagonal(1, 3)
    cross = [(p[(k + 1) % 3] * q[(k + 2) % 3] - p[(k + 2) % 3] * q[(k + 1) % 3]) / 2 for k in range(3)]
    faced = met.select(*key, F.sqrt(sum((c * c for c in cross), F.lit(0.0))).alias("area"), *[(c * F.col("way")).alias(f"n{n}") for c, n in zip(cross, NAMES)])
    sums = faced.groupBy(*key).agg(F.count("*").alias("n_quads"), F.sum("area").alias("area"), *[F.sum(f"n{n}").alias(f"n{n}") for n in NAMES])
    length = F.sqrt(sum((F.col(f"n{n}") * F.col(f"n{n}") for n in NAMES), F.lit(0.0)))
    sums = sums.select(*key, "n_quads", "area", *[F.when(length > 1e-9 * F.col("area"), F.col(f"n{n}") / length).alias(f"n{n}") for n in NAMES])
    told = points if values is None else points.join(values.select(F.col("cid").alias("vertex"), "value"), "vertex", "left")
    pairs = [("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")]
    more = [] if values is None else [F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")]
    shape = told.groupBy(*key).agg(*[F.avg(n).alias(n) for n in NAMES], *[F.covar_pop(a, b).alias(f"_{a}{b}") for a, b in pairs], *more)
    eigen = eigenvalues(*[F.col(f"_{a}{b}") for a, b in pairs])
    shape = shape.select(*key, *NAMES, *[e.alias(f"e{i}") for i, e in enumerate(eigen, 1)], *[c for c in ("mean", "low", "high") if values is not None])
    return sums.join(shape, key)


def cross_sections(normals: DataFrame, field: DataFrame, meta: GridMeta, n: int, radius: float, least: float = 0.0) -> DataFrame:
    """(pid, area, perimeter, walk_out) of the slice through each point (pid, x, y, z, nx, ny, nz, ux, uy, uz).

    A slice is an n x n patch of side 2 radius, n odd, sampled from the field; its section is the connected piece of samples of at least ``least`` that
    holds the point.  ``area`` is that of its samples, ``perimeter`` the length of the sides between it and samples that are not in it, and ``walk_out`` the
    distance from the point to the nearest sample outside the piece; null where the patch has none.  No row where the point itself is under ``least``.
    """
    step = 2 * radius / (n - 1)
    patch = plane_patch(normals, n, n, radius).select("pid", "i", "j", (F.col("pid") * (n * n) + F.col("j") * n + F.col("i")).alias("sid"), "px", "py", "pz")
    ok = F.lit(True)
    for c, size in zip(("px", "py", "pz"), meta.shape):
        ok = ok & F.col(c).between(0, size - 1)
    value = interpolate(patch.where(ok), field, meta, key="sid")
    held = cut(patch.select("pid", "i", "j", "sid").join(value, "sid", "left").withColumn("on", F.coalesce(F.col("value") >= least, F.lit(False))))
    on = held.where("on").select("pid", "i", "j", "sid")
    links = on.select("sid", "i", "j", F.explode(F.array(F.when(F.col("i") < n - 1, F.col("sid") + 1), F.when(F.col("j") < n - 1, F.col("sid") + n))).alias("to")).where("to is not null")
    links = links.join(on.select(F.col("sid").alias("to")), "to", "left_semi").select(F.col("sid").alias("src"), F.col("to").alias("dst"))
    piece = connected_components(links)
    named = on.join(piece, on["sid"] == piece["node"], "left").select("pid", "i", "j", "sid", F.coalesce("component", "sid").alias("piece"))
    middle = (n - 1) // 2
    core = named.where((F.col("i") == middle) & (F.col("j") == middle)).select("pid", F.col("piece").alias("own"))
    inside = cut(named.join(core, "pid").where("piece = own").select("pid", "i", "j", "sid"))
    around = F.explode(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("s")
    sides = inside.select("pid", around).select("pid", "s.i", "s.j").join(inside.select("pid", "i", "j"), ["pid", "i", "j"], "left_anti").groupBy("pid").agg(F.count("*").alias("n_sides"))
    outside = held.select("pid", "i", "j", "sid").join(inside.select("sid"), "sid", "left_anti")
    away = F.sqrt((F.col("i") - middle) * (F.col("i") - middle) + (F.col("j") - middle) * (F.col("j") - middle)) * step
    out = outside.groupBy("pid").agg(F.min(away).alias("walk_out"))
    area = inside.groupBy("pid").agg((F.count("*") * step * step).alias("area"))
    return area.join(sides, "pid", "left").join(out, "pid", "left").select("pid", "area", (F.coalesce("n_sides", F.lit(0)) * step).alias("perimeter"), "walk_out")
