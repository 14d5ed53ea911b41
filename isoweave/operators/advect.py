"""Numeric integration: tables of seeds that advance together, one distributed step a round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from isoweave.functions.calculus import gradient, interpolate
from isoweave.functions.grid import GridMeta, coordinates, corners, index, wrapped
from isoweave.operators.iterate import loops, terminal
from isoweave.runtime import cut


def streamlines(seeds: DataFrame, field: DataFrame, meta: GridMeta, up: bool = True, step: float = 0.5, error: float = 0.01, flat: float = 1e-9, least: float = 1e-3, max_steps: int = 50) -> DataFrame:
    """(pid, step, px, py, pz, event) of paths along the unit gradient from seeds (pid, px, py, pz).

    Adaptive Euler: one full step is held against two half steps; apart by over ``error`` the step is halved and tried again,
    else the half steps are taken and the step grows up to ``step``.  Events: none, flat (gradient under ``flat``), border (the path
    left the grid), small (steps under ``least``), limit.
    """
    slopes = cut(gradient(field, meta).fillna(0.0))
    axes, sign = meta.axes, 1.0 if up else -1.0
    names, slope = [("px", "py", "pz")[a] for a in axes], [("dx", "dy", "dz")[a] for a in axes]

    def direction(points: DataFrame, at: list[str], tag: str) -> DataFrame:
        moved = points.select("pid", *[F.col(c).alias(n) for c, n in zip(at, names)])
        got = interpolate(moved, slopes, meta, names=tuple(slope))
        size = F.sqrt(sum((F.col(s) * F.col(s) for s in slope), F.lit(0.0)))
        return got.select("pid", size.alias(f"{tag}size"), *[F.when(size > 0, F.col(s) / size * sign).otherwise(0.0).alias(f"{tag}{s}") for s in slope])

    live = cut(seeds.select("pid", F.lit(0).alias("step"), *names, F.lit(float(step)).alias("h")))
    out = live.select("pid", "step", *names, F.lit("none").alias("event"))
    for _ in range(max_steps):
        here = live.join(direction(live, names, "a_"), "pid")
        half = here.withColumns({f"m{n}": F.col(n) + F.col("h") / 2 * F.col(f"a_{s}") for n, s in zip(names, slope)})
        inside = F.lit(True)
        for n, a in zip(names, axes):
            inside = inside & F.col(f"m{n}").between(0, meta.shape[a] - 1)
        half = half.withColumn("inside", inside)
        clipped = half.withColumns({f"c{n}": F.least(F.greatest(F.col(f"m{n}"), F.lit(0.0)), F.lit(meta.shape[a] - 1.0)) for n, a in zip(names, axes)})
        both = clipped.join(direction(clipped, [f"c{n}" for n in names], "b_"), "pid")
        both = both.withColumns({f"f{n}": F.col(f"m{n}") + F.col("h") / 2 * F.col(f"b_{s}") for n, s in zip(names, slope)})
        for n, a in zip(names, axes):
            both = both.withColumn("inside", F.col("inside") & F.col(f"f{n}").between(0, meta.shape[a] - 1))
        apart = F.sqrt(sum(((F.col(f"f{n}") - F.col(n) - F.col("h") * F.col(f"a_{s}")) ** 2 for n, s in zip(names, slope)), F.lit(0.0)))
        refuse = (apart > error) & (F.col("h") / 2 >= least)
        event = F.when(F.col("a_size") < flat, "flat").when(refuse, "retry").when(apart > error, "small").when(~F.col("inside"), "border").otherwise("none")
        done = cut(both.withColumn("event", event))
        taken = done.where("event in ('none', 'small')")
        out = out.union(taken.select("pid", F.col("step") + 1, *[F.col(f"f{n}") for n in names], "event")).union(done.where("event in ('flat', 'border')").select("pid", F.col("step") + 1, *names, "event"))
        again = done.where("event = 'retry'").select("pid", "step", *names, (F.col("h") / 2).alias("h"))
        live = cut(done.where("event = 'none'").select("pid", F.col("step") + 1, *[F.col(f"f{n}").alias(n) for n in names], F.least(F.col("h") * 2, F.lit(float(step))).alias("h")).toDF("pid", "step", *names, "h").union(again))
        if live.isEmpty():
            return out
    return out.union(live.select("pid", F.col("step") + 1, *names, F.lit("limit")))


def last_points(paths: DataFrame) -> DataFrame:
    """(pid, step, px, py, pz, event) of the end of each streamline."""
    rest = [c for c in paths.columns if c != "pid"]
    return paths.groupBy("pid").agg(F.max(F.struct(*rest)).alias("_last")).select("pid", "_last.*")


def integration_labels(field: DataFrame, labels: DataFrame, meta: GridMeta, up: bool = True, steps: int = 4, rounds: int = 8, background: float | None = None, **how) -> DataFrame:
    """(vid, label): where the integral line of each sample ends, for ``labels`` (vid, label) of some samples.

    All samples without a label advance together, ``steps`` steps a round, and stop where all corners around them have one label.  What
    has not stopped after ``rounds`` rounds, or has come to rest, points to the sample nearest to its last place; these pointers are followed to a
    label, or to a sample that points to itself and names a region of its own.  Samples of at most ``background`` in size are left out.
    """
    names = [("px", "py", "pz")[a] for a in meta.axes]
    known = cut(labels.select("vid", "label"))
    own = field if background is None else field.where(F.abs("value") > background)
    at = coordinates(F.col("vid"), meta.shape)
    live = own.join(known, "vid", "left_anti").select(F.col("vid").alias("pid"), *[at[a].cast("double").alias(n) for a, n in zip(meta.axes, names)])
    live, found, rest = cut(live), None, None
    for _ in range(rounds):
        ends = cut(last_points(streamlines(live, field, meta, up=up, max_steps=steps, **how)).select("pid", *names, "event"))
        near = corners(ends.select("pid", *names), meta).join(known, "vid", "left")
        held = near.groupBy("pid").agg(F.min("label").alias("label"), F.max("label").alias("_other"), F.count("label").alias("_n"), F.count("*").alias("_all"))
        held = held.where("label = _other and _n = _all").select(F.col("pid").alias("vid"), "label")
        stopped = cut(held)
        found = stopped if found is None else found.union(stopped)
        left = ends.join(stopped.select(F.col("vid").alias("pid")), "pid", "left_anti")
        still = left.where("event in ('flat', 'small', 'border')").select("pid", *names)
        rest = still if rest is None else rest.union(still)
        live = cut(left.where("event not in ('flat', 'small', 'border')").select("pid", *names))
        if live.isEmpty():
            break
    rest = rest.union(live)
    spot = [F.lit(0).cast("long")] * 3
    for a, n in zip(meta.axes, names):
        spot[a] = wrapped(F.floor(F.col(n) + 0.5), meta.shape[a], meta.periodic[a])
    pointers = rest.select(F.col("pid").alias("id"), index(meta.shape, *spot).alias("next"))
    named = known.union(found)
    # a pointer to a labelled sample ends there; samples that point to each other in a loop name the least of them
    open_ = cut(pointers.join(named.select(F.col("vid").alias("id")), "id", "left_anti"))
    looped = loops(open_).where("on_loop").select("id", F.col("loop").alias("_loop"))
    straight = open_.join(looped, "id", "left").select("id", F.coalesce("_loop", "next").alias("next"))
    roots = terminal(straight).select(F.col("id").alias("vid"), "root")
    late = roots.join(named.select(F.col("vid").alias("root"), "label"), "root", "left").select("vid", F.coalesce("label", "root").alias("label"))
    return named.union(late)


def _crossings(planes: Column, name: str, axis: int, way: Column) -> Column:
    """Where along a segment it meets each of some planes."""
    return F.transform(planes, lambda p: F.struct(((p - F.col(f"_{name}")) / (F.col(name) - F.col(f"_{name}"))).alias("t"), F.lit(axis).alias("axis"), way.alias("way")))


def _passed(axis: int) -> Column:
    """Boxes gone along an axis with the first ``i`` + 1 crossings."""
    return F.aggregate(F.slice("crossed", F.lit(1), F.col("i") + 1), F.lit(0), lambda acc, x: acc + F.when(x["axis"] == axis, x["way"]).otherwise(0))


def digitised(paths: DataFrame, meta: GridMeta) -> DataFrame:
    """(pid, pos, cid): the cells that polylines (pid, step, px, py[, pz]) pass through, from one full cell through a face to the next.

    Cells that follow each other are always incident: where a segment passes several faces, it does so in the order of its
    crossings, and faces crossed at once follow by axis.  Points outside count as on the border.
    """
    axes = meta.axes
    names = [("px", "py", "pz")[a] for a in axes]
    w = Window.partitionBy("pid").orderBy("step")
    inside = {n: F.least(F.greatest(F.col(n), F.lit(0.0)), F.lit(meta.shape[a] - 1.0)) for a, n in zip(axes, names)}
    seg = paths.select("pid", "step", *[c.alias(n) for n, c in inside.items()])
    seg = seg.withColumns({f"_{n}": F.lag(n).over(w) for n in names})  # null at the first point
    box = lambda c, a: F.least(F.floor(c), F.lit(meta.shape[a] - 2)).cast("int")
    start = [box(F.coalesce(f"_{n}", n), a) for a, n in zip(axes, names)]
    stop = [box(F.col(n), a) for a, n in zip(axes, names)]
    seg = seg.withColumns({f"s{a}": s for a, s in zip(axes, start)} | {f"e{a}": e for a, e in zip(axes, stop)})
    crossed = []
    for a, n in zip(axes, names):
        s, e = F.col(f"s{a}"), F.col(f"e{a}")
        way = F.when(e > s, 1).otherwise(-1)
        # the plane between box i and the next one on the way
        planes = F.when(e != s, F.sequence(F.when(e > s, s + 1).otherwise(s), F.when(e > s, e).otherwise(e + 1), way))
        crossed.append(F.coalesce(_crossings(planes, n, a, way), F.array().cast("array<struct<t:double,axis:int,way:int>>")))
    seg = seg.withColumn("crossed", F.array_sort(F.concat(*crossed)))
    first = seg.where(F.col(f"_{names[0]}").isNull()).select("pid", "step", F.lit(-1).alias("i"), F.lit(1).alias("half"), *[F.col(f"e{a}").alias(f"b{a}") for a in axes], F.lit(-1).alias("axis"), F.lit(0).alias("way"))
    walk = seg.where(F.col(f"_{names[0]}").isNotNull()).select("pid", "step", *[f"s{a}" for a in axes], "crossed", F.posexplode("crossed").alias("i", "c"))
    passed = {a: _passed(a) for a in axes}
    walk = walk.select("pid", "step", "i", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"), *[(F.col(f"s{a}") + passed[a]).alias(f"b{a}") for a in axes], F.col("c.axis").alias("axis"), F.col("c.way").alias("way"))
    cell = [F.lit(0).cast("long")] * 3
    for a in axes:
        # the box itself, or the face through which it was entered
        cell[a] = (2 * F.col(f"b{a}") + 1 - F.when((F.col("half") == 0) & (F.col("axis") == a), F.col("way")).otherwise(0)).cast("long")
    out = first.union(walk).withColumn("cid", index(meta.mesh, *cell))
    order = Window.partitionBy("pid").orderBy("step", "i", "half")
    return out.select("pid", (F.row_number().over(order) - 1).cast("long").alias("pos"), "cid")


def saddle_descents(nodes: DataFrame, field: DataFrame, meta: GridMeta, **how) -> DataFrame:
    """``streamlines`` downwards from both sides of every 1-saddle (nid, dim): half a step beyond it along its edge."""
    saddles = nodes.where("dim = 1").select("nid")
    at = coordinates(F.col("nid"), meta.mesh)
    sides = F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")
    odd = [c % 2 == 1 for c in at]
    moved = [(c * 0.5 + F.when(o, 0.25 * F.col("side")).otherwise(0.0)).alias(n) for c, o, n in zip(at, odd, ("px", "py", "pz"))]
    seeds = saddles.select("nid", sides).select((F.col("nid") * 2 + (F.col("side") > 0).cast("int")).alias("pid"), *[moved[a] for a in meta.axes])
    return streamlines(seeds, field, meta, up=False, **how)
