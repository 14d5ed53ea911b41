"""Field calculus: finite differences, interpolation, convolution, and combinations of fields."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoweave.functions.grid import GridMeta, coordinates, corners, index, inside, line_neighbours, wrapped

#: Central difference weights of the samples 1..order/2 steps away; the other side is negated.
CENTRAL = {2: [1 / 2], 4: [2 / 3, -1 / 12], 6: [3 / 4, -3 / 20, 1 / 60], 8: [4 / 5, -1 / 5, 4 / 105, -1 / 280]}


def gradient(field: DataFrame, meta: GridMeta, order: int = 2) -> DataFrame:
    """(vid, dx, dy, dz): central differences of the order that still fits at the vertex; one-sided on the border."""
    out = field.select("vid")
    for a, name in enumerate(("dx", "dy", "dz")):
        if a not in meta.axes:
            out = out.withColumn(name, F.lit(0.0))
            continue
        n, periodic = meta.shape[a], meta.periodic[a]
        at = coordinates(F.col("vid"), meta.shape)[a]
        room = F.lit(order // 2) if periodic else F.least(at, F.lit(n - 1) - at, F.lit(order // 2))
        steps = F.abs("offset")
        weight = F.lit(0.0)
        for half in range(1, order // 2 + 1):
            for k, w in enumerate(CENTRAL[2 * half], 1):
                weight = F.when((F.col("_room") == half) & (steps == k), F.signum("offset") * w).otherwise(weight)
        side = F.when(at == 0, F.lit(1)).otherwise(F.lit(-1))
        edge = F.when(F.col("offset") == 0, -side).when(F.col("offset") == side, side).otherwise(0)
        pairs = line_neighbours(field, meta, a, order // 2).withColumn("_room", room)
        weight = F.when(F.col("_room") == 0, edge.cast("double")).otherwise(weight)
        part = pairs.groupBy("vid").agg(F.sum(weight * F.col("nvalue")).alias(name))
        out = out.join(part, "vid", "left")
    return out


def interpolate(points: DataFrame, field: DataFrame, meta: GridMeta, key: str = "pid", names: tuple[str, ...] = ("value",), columns: tuple[str, ...] = ("px", "py", "pz")) -> DataFrame:
    """(key, names...): multilinear values at points; pass a gradient table with names dx, dy, dz for gradients."""
    near = corners(points.select(key, *columns[:max(meta.axes) + 1]), meta, columns)
    joined = near.join(field.select("vid", *names), "vid")
    return joined.groupBy(key).agg(*[F.sum(F.col("weight") * F.col(n)).alias(n) for n in names])


def kernel(name: str, size: int = 3, dims: int = 2) -> list[tuple[tuple[int, ...], float]]:
    """(offset, weight): identity, box, gauss (sigma = size / 6), sobel_x, sobel_y, sobel_z, laplacian, sharpen."""
    from itertools import product

    half = size // 2
    every = list(product(range(-half, half + 1), repeat=dims))
    if name == "identity":
        return [((0,) * dims, 1.0)]
    if name == "box":
        return [(o, 1 / len(every)) for o in every]
    if name == "gauss":
        raw = [math.exp(-sum(d * d for d in o) / (2 * (size / 6) ** 2)) for o in every]
        return [(o, w / sum(raw)) for o, w in zip(every, raw)]
    if name.startswith("sobel_"):
        axis = "xyz".index(name[-1])
        near = list(product((-1, 0, 1), repeat=dims))
        weights = [(o, float(o[axis] * math.prod(2 - abs(d) for a, d in enumerate(o) if a != axis))) for o in near]
        return [(o, w) for o, w in weights if w]
    ones = [tuple(s if a == b else 0 for b in range(dims)) for a in range(dims) for s in (-1, 1)]
    laplace = [((0,) * dims, -2.0 * dims)] + [(o, 1.0) for o in ones]
    if name == "laplacian":
        return laplace
    if name == "sharpen":
        return [((0,) * dims, 1 + 2.0 * dims)] + [(o, -1.0) for o in ones]
    raise ValueError(name)


def convolve(field: DataFrame, meta: GridMeta, weights: list[tuple[tuple[int, ...], float]], border: str = "clamp") -> DataFrame:
    """(vid, value): sum of weight times the sample at the offset. ``border``: clamp, zero, or the grid's own period.

    Every sample is sent to its targets and pre-aggregated by them before the one shuffle; nothing is joined.  With ``clamp`` a
    sample on the border also stands for the positions beyond it, so it may reach a target several times.
    """
    shape, entries = meta.shape, []
    base = coordinates(F.col("vid"), shape)
    for o, w in weights:
        o = (*o, 0, 0)[:3]
        at, ok = [], F.lit(True)
        for b, d, n, p in zip(base, o, shape, meta.periodic):
            at.append(wrapped(b - d, n, p))
            if d and not p:
                ok = ok & inside(b - d, n, False)
        entries.append(F.when(ok, F.struct(index(shape, *at).alias("to"), F.lit(float(w)).alias("w"))))
    sent = field.select("value", "vid", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.to", (F.col("e.w") * F.col("value")).alias("part"))
    if border == "clamp":
        sent = sent.union(_beyond(field, meta, weights))
    sums = sent.groupBy(F.col("to").alias("vid")).agg(F.sum("part").alias("value"))
    return sums


def _beyond(field: DataFrame, meta: GridMeta, weights: list[tuple[tuple[int, ...], float]]) -> DataFrame:
    """(to, part) of targets whose offset leaves the grid: they read the nearest border sample instead."""
    shape = meta.shape
    base = coordinates(F.col("vid"), shape)
    wants = []
    for o, w in weights:
        o = (*o, 0, 0)[:3]
        out, at = F.lit(False), []
        for b, d, n, p in zip(base, o, shape, meta.periodic):
            out = out | (F.lit(False) if p or not d else ~inside(b + d, n, False))
            at.append(wrapped(b + d, n, p) if p else F.least(F.greatest(b + d, F.lit(0)), F.lit(n - 1)))
        wants.append(F.when(out, F.struct(index(shape, *at).alias("source"), F.lit(float(w)).alias("w"))))
    asks = field.select(F.col("vid").alias("to"), F.explode(F.array_compact(F.array(*wants))).alias("e")).select("to", F.col("e.source").alias("vid"), "e.w")
    return asks.join(field.select("vid", "value"), "vid").select("to", (F.col("w") * F.col("value")).alias("part"))


def magnitude(field: DataFrame, meta: GridMeta, border: str = "clamp") -> DataFrame:
    """(vid, value): length of the Sobel gradient."""
    dims = len(meta.axes)
    parts = [convolve(field, meta, kernel(f"sobel_{'xyz'[a]}", dims=dims), border).select("vid", (F.col("value") * F.col("value")).alias("value")) for a in meta.axes]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("vid").agg(F.sqrt(F.sum("value")).alias("value"))


def negate(field: DataFrame) -> DataFrame:
    return field.withColumn("value", -F.col("value"))


def value_range(field: DataFrame) -> DataFrame:
    """One row: low, high and range."""
    return field.agg(F.min("value").alias("low"), F.max("value").alias("high")).withColumn("range", F.col("high") - F.col("low"))


def threshold(field: DataFrame, low: float | None = None, high: float | None = None, strict: bool = True) -> DataFrame:
    """Samples over ``low`` (or at it, unless strict) and not over ``high``."""
    c = F.col("value")
    out = field if low is None else field.where(c > low if strict else c >= low)
    return out if high is None else out.where(c <= high)


def normalised(field: DataFrame) -> DataFrame:
    """Values scaled to 0..1; 0 where all are equal."""
    span = value_range(field)
    scaled = F.when(F.col("range") == 0, 0.0).otherwise((F.col("value") - F.col("low")) / F.col("range"))
    return field.join(F.broadcast(span)).withColumn("value", scaled).select(*field.columns)  # one row


def remap(value: Column, gamma: float = 1.0, scale: float = 1.0, shift: float = 0.0) -> Column:
    return F.pow(value, F.lit(gamma)) * scale + shift


def weigh(mask: DataFrame, field: DataFrame) -> DataFrame:
    """(vid, value): normalised mask times normalised field, the field lifted off zero."""
    a, b = normalised(mask).select("vid", F.col("value").alias("m")), normalised(field).select("vid", F.col("value").alias("f"))
    return a.join(b, "vid").select("vid", (F.col("m") * (F.col("f") + 0.001)).alias("value"))


def sample(points: DataFrame, fields: dict[str, DataFrame], key: str = "vid") -> DataFrame:
    """``points`` with one column for each named field, by equal keys."""
    for name, field in fields.items():
        points = points.join(field.select(F.col("vid").alias(key), F.col("value").alias(name)), key, "left")
    return points
