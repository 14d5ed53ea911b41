"""Polylines and points: lengths, smoothing, metrics, spatial searches.

A polyline table is (line_id, pos, x, y, z[, ...]); windows run over one line, ordered by pos.
"""

from __future__ import annotations

import heapq
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from isoweave.functions.grid import NAMES
from isoweave.runtime import cut_in_loop


def _line() -> WindowSpec:
    return Window.partitionBy("line_id").orderBy("pos")


def _distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b)), F.lit(0.0)))


def with_arc_length(lines: DataFrame) -> DataFrame:
    """``lines`` with ``step`` (from the previous point) and ``arc`` (from the first)."""
    step = F.coalesce(_distance([F.col(n) for n in NAMES], [F.lag(n).over(_line()) for n in NAMES]), F.lit(0.0))
    return lines.withColumn("step", step).withColumn("arc", F.sum("step").over(_line().rowsBetween(Window.unboundedPreceding, 0)))


def lengths(lines: DataFrame) -> DataFrame:
    return with_arc_length(lines).groupBy("line_id").agg(F.sum("step").alias("length"), F.count("*").alias("n_points"))


def point_at(lines: DataFrame, at: Column) -> DataFrame:
    """(line_id, x, y, z) at an arc length; no row beyond the line's ends."""
    w = with_arc_length(lines).withColumns({f"n_{c}": F.lead(c).over(_line()) for c in (*NAMES, "arc")}).withColumn("_at", at)
    last = F.col("n_arc").isNull() & (F.col("arc") == F.col("_at"))
    held = w.where(((F.col("arc") <= F.col("_at")) & (F.col("_at") < F.col("n_arc"))) | last)
    share = F.when(last, 0.0).otherwise((F.col("_at") - F.col("arc")) / (F.col("n_arc") - F.col("arc")))
    return held.select("line_id", *[F.when(last, F.col(n)).otherwise(F.col(n) + share * (F.col(f"n_{n}") - F.col(n))).alias(n) for n in NAMES])


def smooth(lines: DataFrame, times: int, drift: float | None = None) -> DataFrame:
    """Weights 1/4, 1/2, 1/4 applied ``times`` times with fixed ends; ``drift`` bounds each coordinate's distance to the original.

    A step is a window of three points; all steps keep the one partitioning and order by line, and the plan is cut every 20.
    """
    at, given = lines.withColumns({f"_{n}": F.col(n) for n in NAMES}), lines.columns
    for k in range(times):
        made = {}
        for n in NAMES:
            before, after = F.lag(n).over(_line()), F.lead(n).over(_line())
            made[n] = F.when(before.isNull() | after.isNull(), F.col(n)).otherwise(before / 4 + F.col(n) / 2 + after / 4)
            if drift is not None:
                made[n] = F.greatest(F.least(made[n], F.col(f"_{n}") + drift), F.col(f"_{n}") - drift)
        at = at.withColumns(made)
        if k % 20 == 19 and k + 1 < times:
            at = cut_in_loop(at)
    return at.select(*given)


def decimate(lines: DataFrame, limit: float) -> DataFrame:
    """Drop, again and again, the inner point nearest to the line through its neighbours while that is under ``limit``.

    Which point goes next depends on all before it, so a line is one group; a heap keeps its work at n log n.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        at, n = pdf[list(NAMES)].to_numpy(float).tolist(), len(pdf)
        before, after, kept = np.arange(n) - 1, np.arange(n) + 1, np.ones(n, bool)

        def gap(i: int) -> float:
            (x, y, z), (ax, ay, az), (bx, by, bz) = at[i], at[before[i]], at[after[i]]
            x, y, z, cx, cy, cz = x - ax, y - ay, z - az, bx - ax, by - ay, bz - az
            share = (x * cx + y * cy + z * cz) / max(cx * cx + cy * cy + cz * cz, 1e-300)
            x, y, z = x - cx * share, y - cy * share, z - cz * share
            return (x * x + y * y + z * z) ** 0.5

        gaps = np.array([gap(i) if 0 < i < n - 1 else np.inf for i in range(n)])
        queue = [(g, i) for i, g in enumerate(gaps) if g < limit]
        heapq.heapify(queue)
        while queue:
            g, i = heapq.heappop(queue)
            if not kept[i] or g != gaps[i]:
                continue
            kept[i] = False
            after[before[i]], before[after[i]] = after[i], before[i]
            for j in (before[i], after[i]):
                if 0 < j < n - 1:
                    gaps[j] = gap(j)
                    if gaps[j] < limit:
                        heapq.heappush(queue, (gaps[j], int(j)))
        return pdf[kept]

    return lines.groupBy("line_id").applyInPandas(run, lines.schema)


def ends(lines: DataFrame) -> DataFrame:
    """(line_id, a, b): first and last point as structs."""
    point = F.struct(*NAMES)
    return lines.groupBy("line_id").agg(F.min_by(point, "pos").alias("a"), F.max_by(point, "pos").alias("b"))


def orientation(lines: DataFrame) -> DataFrame:
    """(line_id, angle_x, angle_y, angle_z) in degrees of the vector between the ends; null for a closed line."""
    e = ends(lines)
    d = [F.col(f"b.{n}") - F.col(f"a.{n}") for n in NAMES]
    length = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return e.select("line_id", *[F.when(length > 0, F.degrees(F.acos(F.greatest(F.least(p / length, F.lit(1.0)), F.lit(-1.0))))).alias(f"angle_{n}") for p, n in zip(d, NAMES)])


def centroids(lines: DataFrame) -> DataFrame:
    return lines.groupBy("line_id").agg(*[F.avg(n).alias(n) for n in NAMES])


def curvature(lines: DataFrame, step: int = 10, smoothing: int = 0) -> DataFrame:
    """(line_id, total, mean): angles at every ``step``-th point between the chords to the points ``step`` back and ahead.

    A point counts where both chords exist and have length; ``smoothing`` steps are applied first.
    """
    at = smooth(lines, smoothing) if smoothing else lines
    back = [F.col(n) - F.lag(n, step).over(_line()) for n in NAMES]
    ahead = [F.lead(n, step).over(_line()) - F.col(n) for n in NAMES]
    norm = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    dot = sum((p * q for p, q in zip(back, ahead)), F.lit(0.0))
    w = at.select("line_id", "pos", dot.alias("dot"), (norm(back) * norm(ahead)).alias("size"))
    angle = F.when((F.col("size") > 0) & (F.col("pos") % step == 0), F.acos(F.greatest(F.least(F.col("dot") / F.col("size"), F.lit(1.0)), F.lit(-1.0))))
    return w.groupBy("line_id").agg(F.coalesce(F.sum(angle), F.lit(0.0)).alias("total"), F.avg(angle).alias("mean"))


def slices(lines: DataFrame, spacing: float, value: str = "value") -> DataFrame:
    """Points of ``lines`` where a slice falls: every ``spacing`` along the line, anchored at its lowest point."""
    arc = with_arc_length(lines)
    low = arc.groupBy("line_id").agg(F.min_by("arc", F.struct(value, "pos")).alias("anchor"))
    w = arc.join(low, "line_id").withColumn("from_lowest", F.col("arc") - F.col("anchor"))
    number = F.floor(F.col("from_lowest") / spacing)
    w = w.withColumn("slice", number).withColumn("_before", F.lag("slice").over(_line()))
    return w.where(F.col("_before").isNull() | (F.col("_before") != F.col("slice"))).drop("_before", "anchor")


def slice_records(records: DataFrame) -> DataFrame:
    """Slices (line_id, pos, area, x, y, z, arc) with equivalent radius, chord displacement and angle to the next slice; no angle at the ends or between slices at one place."""
    nxt = [F.lead(n).over(_line()) - F.col(n) for n in NAMES]
    before = [F.col(n) - F.lag(n).over(_line()) for n in NAMES]
    norm = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    dot = sum((p * q for p, q in zip(before, nxt)), F.lit(0.0)) / F.nullif(norm(before) * norm(nxt), F.lit(0.0))
    return records.withColumns({"radius": F.sqrt(F.col("area") / np.pi), "chord": norm(nxt), "angle": F.when(dot.isNotNull(), F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0))))})


def radius_of_gyration(points: DataFrame, key: str = "line_id") -> DataFrame:
    """Root mean square distance of each group's points to their centre."""
    return points.groupBy(key).agg(F.sqrt(sum((F.var_pop(n) for n in NAMES), F.lit(0.0))).alias("gyration"))


def metrics(lines: DataFrame, positive: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """One row for each line: length, mean value, centroid, orientation, and means of the positive entries of some columns."""
    arc = with_arc_length(lines)
    base = arc.groupBy("line_id").agg(
        F.sum("step").alias("length"), F.avg(value).alias("mean_value"), *[F.avg(n).alias(f"mean_{n}") for n in NAMES], *[F.avg(F.when(F.col(c) > 0, F.col(c))).alias(f"mean_{c}") for c in positive])
    return base.join(orientation(lines), "line_id")


def plane_patch(normals: DataFrame, n: int, m: int, radius: float) -> DataFrame:
    """``normals`` (pid, x, y, z, nx, ny, nz, ux, uy, uz) with an n x m grid of points (i, j, px, py, pz) in the plane.

    The normal is scaled to length 1 and up made orthogonal to it; left is normal x up.  Point (0, 0) lies at up + left, i moves
    against left and j against up.  No point where the normal is 0 or parallel to up.
    """
    unit = lambda v: [c / F.nullif(F.sqrt(sum((d * d for d in v), F.lit(0.0))), F.lit(0.0)) for c in v]
    norm, up = (unit([F.col(k + a) for a in NAMES]) for k in "nu")
    dot = sum((p * q for p, q in zip(norm, up)), F.lit(0.0))
    base = normals.withColumns({f"_n{a}": c for a, c in zip(NAMES, norm)} | {f"_u{a}": q - p * dot for a, p, q in zip(NAMES, norm, up)})
    norm, up = [F.col(f"_n{a}") for a in NAMES], unit([F.col(f"_u{a}") for a in NAMES])
    left = [norm[(k + 1) % 3] * up[(k + 2) % 3] - norm[(k + 2) % 3] * up[(k + 1) % 3] for k in range(3)]
    out = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    s, t = ((1 - 2 * F.col(c) / max(1, k - 1)) * radius for c, k in (("i", n), ("j", m)))
    out = out.withColumns({f"p{a}": F.col(a) + s * p + t * q for a, p, q in zip(NAMES, left, up)})
    return out.where("px is not null").drop(*[f"_{k}{a}" for k in "nu" for a in NAMES])


def _bucketed(points: DataFrame, size: float, columns: tuple[str, ...]) -> DataFrame:
    return points.withColumns({f"_b{i}": F.floor(F.col(c) / size).cast("long") for i, c in enumerate(columns)})


def within(left: DataFrame, right: DataFrame, radius: float, columns: tuple[str, ...] = NAMES, prefix: str = "r_") -> DataFrame:
    """Pairs of points at most ``radius`` apart with ``dist``; the right side's columns get the prefix.

    Points meet in buckets of the radius and the neighbouring ones: an equi-join, refined by distance.  Buckets past the range of
    long are that range's last one, which has no neighbour: so far out, only equal numbers are within the radius.
    """
    keys = [f"_b{i}" for i in range(len(columns))]
    spread = F.explode(F.array(*[F.struct(*[F.try_add(F.col(k), F.lit(d)).alias(k) for k, d in zip(keys, o)]) for o in product((-1, 0, 1), repeat=len(keys))]))
    a = _bucketed(left, radius, columns).withColumn("_near", spread).drop(*keys).select("*", "_near.*").drop("_near")
    b = _bucketed(right, radius, columns).select(*keys, *[F.col(c).alias(prefix + c) for c in right.columns])
    dist = _distance([F.col(c).cast("double") for c in columns], [F.col(prefix + c).cast("double") for c in columns])
    return a.join(b, keys).drop(*keys).withColumn("dist", dist).where(F.col("dist") <= radius)


def around(left: DataFrame, right: DataFrame, radius: float, key: str, columns: tuple[str, ...] = NAMES) -> DataFrame:
    """Left rows with a right row at most ``radius`` away, with ``n``, how many such rows there are, and ``first``, their least ``key``.

    Rows at one place count as one point with their number and least key: places are paired, never the rows at them.
    """
    places = right.groupBy(*columns).agg(F.count("*").alias("n"), F.min(key).alias("first"))
    met = within(left.select(*columns).distinct(), places, radius, columns)
    return left.join(met.groupBy(*columns).agg(F.sum("r_n").alias("n"), F.min("r_first").alias("first")), list(columns))


def nearest(left: DataFrame, right: DataFrame, radius: float, key: str, columns: tuple[str, ...] = NAMES, tie: str | None = None) -> DataFrame:
    """For each left row the nearest right row within the radius; ties by ``tie`` of the right side."""
    pairs = within(left, right, radius, columns)
    others = [c for c in pairs.columns if c not in left.columns and c != "dist"]
    order = F.struct("dist", *([f"r_{tie}"] if tie else []))
    return pairs.groupBy(key).agg(F.min_by(F.struct("dist", *others), order).alias("_best")).select(key, "_best.*")


def apart(lines: DataFrame, radius: float) -> DataFrame:
    """Points without a point of another line within the radius."""
    met = within(lines, lines.select("line_id", "pos", *NAMES), radius).where("line_id != r_line_id")
    return lines.join(met.select("line_id", "pos").distinct(), ["line_id", "pos"], "left_anti")


def rasterised(segments: DataFrame) -> DataFrame:
    """(segment_id, pos, x, y): grid cells of an integer line from (x0, y0) to (x1, y1)."""
    n = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    at = segments.withColumn("_n", n).withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long"))))
    share = F.when(F.col("_n") == 0, 0.0).otherwise(F.col("pos") / F.col("_n"))
    return at.select("segment_id", "pos", *[F.floor(F.col(f"{c}0") + share * (F.col(f"{c}1") - F.col(f"{c}0")) + 0.5).cast("long").alias(c) for c in ("x", "y")])


def line_graph(lines: DataFrame) -> DataFrame:
    """(vertex, line1, line2) of polylines (line_id, vertex1, vertex2): lines that share a vertex; a free end has line2 -1."""
    at = lines.select(F.col("vertex1").alias("vertex"), "line_id").union(lines.select(F.col("vertex2").alias("vertex"), "line_id")).distinct()
    pairs = at.withColumnRenamed("line_id", "line1").join(at.withColumnRenamed("line_id", "line2"), "vertex").where("line1 < line2")
    free = at.groupBy("vertex").agg(F.count("*").alias("n"), F.min("line_id").alias("line1")).where("n = 1").select("vertex", "line1", F.lit(-1).cast("long").alias("line2"))
    return pairs.select("vertex", "line1", "line2").union(free)


def graph_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one graph that the other lacks, with ``side``."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))

