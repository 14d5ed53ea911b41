"""Regular grids as tables: coordinates, neighbourhoods and the cells of the doubled lattice, as column expressions.

A field is a table (vid, x, y[, z], value).  A cell id is the linear index on the doubled lattice of 2n - 1 points an axis
(2n where the axis is periodic); a cell's dimension is the number of its odd coordinates.  Nothing here collects data.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridMeta:
    nx: int
    ny: int
    nz: int = 1
    periodic: tuple[bool, bool, bool] = (False, False, False)

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.nx, self.ny, self.nz

    @property
    def axes(self) -> list[int]:
        """Axes with more than one sample."""
        return [a for a in range(3) if self.shape[a] > 1]

    @property
    def mesh(self) -> tuple[int, int, int]:
        return tuple(2 * n if p else 2 * n - 1 for n, p in zip(self.shape, self.periodic))

    @property
    def size(self) -> int:
        return self.nx * self.ny * self.nz


NAMES, CELL_NAMES = ("x", "y", "z"), ("cx", "cy", "cz")


def index(shape: tuple[int, int, int], x: Column, y: Column, z: Column | None = None) -> Column:
    out = x + y * F.lit(shape[0])
    return (out if z is None else out + z * F.lit(shape[0] * shape[1])).cast("long")


def coordinates(of: Column, shape: tuple[int, int, int]) -> list[Column]:
    """x, y and z of a linear index."""
    nx, ny = shape[:2]
    return [(of % nx).cast("long"), (F.floor(of / nx) % ny).cast("long"), F.floor(of / (nx * ny)).cast("long")]


def with_coordinates(df: DataFrame, meta: GridMeta, key: str = "vid") -> DataFrame:
    return df.withColumns(dict(zip(NAMES, coordinates(F.col(key), meta.shape))))


def inside(c: Column, n: int, periodic: bool) -> Column:
    return F.lit(True) if periodic else c.between(0, n - 1)


def wrapped(c: Column, n: int, periodic: bool) -> Column:
    return F.pmod(c, F.lit(n)) if periodic else c


def clamped(c: Column, n: int) -> Column:
    return F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))


def offsets(meta: GridMeta, kind: str = "face") -> list[tuple[int, int, int]]:
    """``face``: one step along one axis; ``full``: all cells that touch."""
    steps = [(-1, 0, 1) if n > 1 else (0,) for n in meta.shape]
    every = [o for o in product(*steps) if any(o)]
    return [o for o in every if sum(map(abs, o)) == 1] if kind == "face" else every


def boundary_of(columns: list[Column], meta: GridMeta, shape: tuple[int, int, int] | None = None) -> Column:
    """Number of non-periodic axes on whose border the point lies."""
    shape = shape or meta.shape
    out = F.lit(0)
    for a in meta.axes:
        if not meta.periodic[a]:
            out = out + ((columns[a] == 0) | (columns[a] == shape[a] - 1)).cast("int")
    return out


def distance_to_boundary(columns: list[Column], meta: GridMeta) -> Column:
    """Steps to the nearest border of a non-periodic axis; null where every axis is periodic."""
    parts = [p for a in meta.axes if not meta.periodic[a] for p in (columns[a], F.lit(meta.shape[a] - 1) - columns[a])]
    return F.least(*parts) if parts else F.lit(None).cast("long")


def _moved(base: list[Column], shape: tuple[int, int, int], periodic: tuple[bool, bool, bool], steps) -> Column:
    """Array of the linear indices at these steps that are inside; ``steps`` may hold (offset, condition)."""
    out = []
    for step in steps:
        o, when = step if isinstance(step[0], tuple) else (step, None)
        at = [wrapped(b + d, n, p) for b, d, n, p in zip(base, o, shape, periodic)]
        ok = F.lit(True) if when is None else when
        for b, d, n, p in zip(base, o, shape, periodic):
            if d and not p:
                ok = ok & inside(b + d, n, p)
        out.append(F.when(ok, index(shape, *at)))
    return F.array_compact(F.array(*out))


def neighbour_ids(df: DataFrame, meta: GridMeta, kind: str = "face", key: str = "vid") -> DataFrame:
    """``df`` with ``nvid``, one row for each neighbour on the grid; no join."""
    base = coordinates(F.col(key), meta.shape)
    return df.withColumn("nvid", F.explode(_moved(base, meta.shape, meta.periodic, offsets(meta, kind))))


def neighbours(field: DataFrame, meta: GridMeta, kind: str = "face", same_boundary: bool = False) -> DataFrame:
    """(vid, value, nvid, nvalue) of neighbours that both have a row; ``same_boundary`` keeps those of equal boundary class."""
    pairs = neighbour_ids(field.select("vid", "value"), meta, kind)
    out = pairs.join(field.select(F.col("vid").alias("nvid"), F.col("value").alias("nvalue")), "nvid")
    if same_boundary:
        classes = [boundary_of(coordinates(F.col(c), meta.shape), meta) for c in ("vid", "nvid")]
        out = out.where(classes[0] == classes[1])
    return out.select("vid", "value", "nvid", "nvalue")


def line_neighbours(field: DataFrame, meta: GridMeta, axis: int, radius: int) -> DataFrame:
    """(vid, offset, nvid, nvalue) along one axis; the neighbourhood shrinks at the border."""
    base = coordinates(F.col("vid"), meta.shape)
    shape, periodic = meta.shape, meta.periodic[axis]
    steps = F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("offset")
    out = field.select("vid", steps)
    at = [wrapped(b + F.col("offset"), shape[axis], periodic) if a == axis else b for a, b in enumerate(base)]
    out = out.where(inside(base[axis] + F.col("offset"), shape[axis], periodic)).withColumn("nvid", index(shape, *at))
    return out.join(field.select(F.col("vid").alias("nvid"), F.col("value").alias("nvalue")), "nvid").select("vid", "offset", "nvid", "nvalue")


def corners(points: DataFrame, meta: GridMeta, columns: tuple[str, ...] = ("px", "py", "pz")) -> DataFrame:
    """``points`` with (vid, weight), one row for each of the 4 or 8 samples around it; weights are multilinear."""
    axes = meta.axes
    low = {a: F.least(F.greatest(F.floor(F.col(columns[a])), F.lit(0)), F.lit(meta.shape[a] - (1 if meta.periodic[a] else 2))) for a in axes}
    out = []
    for pick in product((0, 1), repeat=len(axes)):
        at, weight = [F.lit(0)] * 3, F.lit(1.0)
        for a, d in zip(axes, pick):
            at[a] = wrapped(low[a] + d, meta.shape[a], meta.periodic[a])
            share = F.col(columns[a]) - low[a]
            weight = weight * (share if d else 1 - share)
        out.append(F.struct(index(meta.shape, *at).alias("vid"), weight.alias("weight")))
    return points.withColumn("_corner", F.explode(F.array(*out))).select(*points.columns, "_corner.vid", "_corner.weight")


def cells(spark: SparkSession, meta: GridMeta, dims: list[int] | None = None) -> DataFrame:
    """(cid, cx, cy, cz, dim, bnd) of every cell, or of those of some dimensions; generated, not read."""
    mesh = meta.mesh
    df = spark.range(mesh[0] * mesh[1] * mesh[2]).withColumnRenamed("id", "cid")
    df = df.withColumns(dict(zip(CELL_NAMES, coordinates(F.col("cid"), mesh))))
    df = df.withColumns({"dim": dimension(), "bnd": boundary_of([F.col(c) for c in CELL_NAMES], meta, mesh)})
    return df if dims is None else df.where(F.col("dim").isin(dims))


def dimension() -> Column:
    return (F.col("cx") % 2 + F.col("cy") % 2 + F.col("cz") % 2).cast("int")


def centroid() -> list[Column]:
    """World position of a cell."""
    return [F.col(c) * 0.5 for c in CELL_NAMES]


def _cell_base(key: str, meta: GridMeta) -> list[Column]:
    return coordinates(F.col(key), meta.mesh)


def facets(df: DataFrame, meta: GridMeta, key: str = "cid", name: str = "fcid") -> DataFrame:
    """``df`` with one row for each facet: one step along an odd axis."""
    base = _cell_base(key, meta)
    steps = [(tuple(s if b == a else 0 for b in range(3)), base[a] % 2 == 1) for a in meta.axes for s in (-1, 1)]
    return df.withColumn(name, F.explode(_moved(base, meta.mesh, meta.periodic, steps)))


def cofacets(df: DataFrame, meta: GridMeta, key: str = "cid", name: str = "ccid") -> DataFrame:
    """``df`` with one row for each cofacet: one step along an even axis, inside the mesh."""
    base = _cell_base(key, meta)
    steps = [(tuple(s if b == a else 0 for b in range(3)), base[a] % 2 == 0) for a in meta.axes for s in (-1, 1)]
    return df.withColumn(name, F.explode(_moved(base, meta.mesh, meta.periodic, steps)))


def star(df: DataFrame, meta: GridMeta, key: str = "cid", name: str = "acid") -> DataFrame:
    """``df`` with one row for each adjacent cell, that is, all that touch it."""
    wide = GridMeta(*meta.mesh, periodic=meta.periodic)
    return df.withColumn(name, F.explode(_moved(_cell_base(key, meta), meta.mesh, meta.periodic, offsets(wide, "full"))))


def cell_vertices(df: DataFrame, meta: GridMeta, key: str = "cid") -> DataFrame:
    """``df`` with ``vid``, one row for each vertex of the cell."""
    base = _cell_base(key, meta)
    lows = [F.floor(b / 2) for b in base]
    out = []
    for pick in product((0, 1), repeat=3):
        if any(d and a not in meta.axes for a, d in enumerate(pick)):
            continue
        ok, at = F.lit(True), []
        for a, d in enumerate(pick):
            if d:
                ok = ok & (base[a] % 2 == 1)
            at.append(wrapped(lows[a] + d, meta.shape[a], meta.periodic[a]))
        out.append(F.when(ok, index(meta.shape, *at)))
    return df.withColumn("vid", F.explode(F.array_compact(F.array(*out))))


def vertex_cell(vid: Column, meta: GridMeta) -> Column:
    """Cell id of a vertex."""
    return index(meta.mesh, *[c * 2 for c in coordinates(vid, meta.shape)])


def order_of(value: str = "value", key: str = "vid") -> Column:
    """The total order: value first, then index."""
    return F.struct(F.col(value).alias("v"), F.col(key).alias("i"))


def cell_extremes(cell_df: DataFrame, field: DataFrame, meta: GridMeta) -> DataFrame:
    """(cid, vmax, vmin, max_value, min_value, avg_value, n_vertices, n_present) of each cell with a sample."""
    pairs = cell_vertices(cell_df.select("cid", F.lit(1).alias("_")), meta).join(field.select("vid", "value"), "vid", "left")
    present = F.col("value").isNotNull()
    return pairs.groupBy("cid").agg(
        F.max(F.when(present, order_of())).alias("_high"), F.min(F.when(present, order_of())).alias("_low"), F.avg("value").alias("avg_value"),
        F.count("*").alias("n_vertices"), F.count("value").alias("n_present"),
    ).select("cid", F.col("_high.i").alias("vmax"), F.col("_low.i").alias("vmin"), F.col("_high.v").alias("max_value"), F.col("_low.v").alias("min_value"), "avg_value", "n_vertices", "n_present")


def cell_mask(cell_df: DataFrame, mask: DataFrame, meta: GridMeta) -> DataFrame:
    """``cell_df`` without the cells of which a vertex is not in ``mask`` (vid)."""
    marked = mask.select("vid").distinct().withColumn("value", F.lit(1))
    whole = cell_extremes(cell_df, marked, meta).where("n_vertices = n_present")
    return cell_df.join(whole.select("cid"), "cid", "left_semi")


def dual(cell_df: DataFrame, meta: GridMeta) -> DataFrame:
    """The complement grid: the same ids with dimension d - dim; its facets are the cofacets here and the other way round."""
    return cell_df.withColumn("dim", F.lit(len(meta.axes)) - F.col("dim"))
