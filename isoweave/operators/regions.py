"""Regions and labels: components of a mask, steepest pointers, basins and mountains, separators and region statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoweave.functions import grid as G
from isoweave.functions.grid import GridMeta
from isoweave.operators.iterate import connected_components, dense_ids, terminal
from isoweave.runtime import cut, cut_in_loop


def extrema(field: DataFrame, meta: GridMeta, same_boundary: bool = False) -> DataFrame:
    """(vid, value, is_min, is_max) of the vertices without a lower, or without a higher, face neighbour."""
    near = G.neighbours(field, meta, same_boundary=same_boundary)
    own, other = G.order_of(), G.order_of("nvalue", "nvid")
    seen = near.groupBy("vid").agg(F.max((other < own).cast("int")).alias("lower"), F.max((other > own).cast("int")).alias("higher"))
    out = field.select("vid", "value").join(seen, "vid", "left").fillna(0, ["lower", "higher"])
    return out.select("vid", "value", (F.col("lower") == 0).alias("is_min"), (F.col("higher") == 0).alias("is_max")).where("is_min or is_max")


def steepest(field: DataFrame, meta: GridMeta, up: bool = True, same_boundary: bool = False) -> DataFrame:
    """(vid, next): the highest (or lowest) face neighbour beyond the vertex itself; an extremum points to itself."""
    near = G.neighbours(field, meta, same_boundary=same_boundary)
    other = G.order_of("nvalue", "nvid")
    best = near.groupBy("vid").agg((F.max(other) if up else F.min(other)).alias("best"))
    joined = field.select("vid", "value").join(best, "vid", "left")
    own = G.order_of()
    beyond = F.col("best") > own if up else F.col("best") < own
    return joined.select("vid", F.when(beyond, F.col("best.i")).otherwise(F.col("vid")).alias("next"))


def basins(field: DataFrame, meta: GridMeta, up: bool = True) -> DataFrame:
    """(vid, label): the extremum that the steepest path from each vertex ends at."""
    return terminal(steepest(field, meta, up).select(F.col("vid").alias("id"), "next")).select(F.col("id").alias("vid"), F.col("root").alias("label"))


def components(mask: DataFrame, meta: GridMeta, kind: str = "face") -> DataFrame:
    """(vid, label) of a mask (vid): connected pieces named by their smallest vertex."""
    own = mask.select("vid").distinct()
    pairs = G.neighbour_ids(own, meta, kind).where("vid < nvid")
    edges = pairs.join(own.select(F.col("vid").alias("nvid")), "nvid").select(F.col("vid").alias("src"), F.col("nvid").alias("dst"))
    found = connected_components(edges)
    return own.join(found, own["vid"] == found["node"], "left").select("vid", F.coalesce("component", "vid").alias("label"))


def relabel_dense(labels: DataFrame, label: str = "label") -> DataFrame:
    """``labels`` with labels 0..k-1 in the order of the old ones."""
    return labels.join(dense_ids(labels, label), label).drop(label).withColumnRenamed("dense_id", label)


def bounding_boxes(labels: DataFrame, meta: GridMeta, margin: int = 1) -> DataFrame:
    """(label, n, x0, x1, y0, y1, z0, z1): boxes widened by ``margin`` and clipped to the grid."""
    at = G.with_coordinates(labels, meta)
    out = [F.count("*").alias("n")]
    for name, size in zip(G.NAMES, meta.shape):
        out.append(F.greatest(F.min(name) - margin, F.lit(0)).alias(f"{name}0"))
        out.append(F.least(F.max(name) + margin, F.lit(size - 1)).alias(f"{name}1"))
    return at.groupBy("label").agg(*out)


def sub_volumes(labels: DataFrame, field: DataFrame, meta: GridMeta, margin: int = 1, tile: int = 16) -> DataFrame:
    """(label, vid, value): each component's box; its own samples keep their value and the others are 0.

    Boxes meet samples on tiles, an equi-join, and are refined by coordinates.
    """
    boxes = bounding_boxes(labels, meta, margin)
    spans = [F.sequence(F.floor(F.col(f"{n}0") / tile), F.floor(F.col(f"{n}1") / tile)) for n in G.NAMES]
    boxes = boxes.withColumn("tx", F.explode(spans[0])).withColumn("ty", F.explode(spans[1])).withColumn("tz", F.explode(spans[2]))
    samples = G.with_coordinates(field.select("vid", "value"), meta).join(labels.withColumnRenamed("label", "own"), "vid", "left")
    samples = samples.withColumns({f"t{n}": F.floor(F.col(n) / tile) for n in G.NAMES})
    met = boxes.join(samples, ["tx", "ty", "tz"])
    for n in G.NAMES:
        met = met.where(F.col(n).between(F.col(f"{n}0"), F.col(f"{n}1")))
    return met.select("label", "vid", F.when(F.col("own") == F.col("label"), F.col("value")).otherwise(0).alias("value"))


def separators(labels: DataFrame, meta: GridMeta) -> DataFrame:
    """(cid, label1, label2): edges of the grid between two regions."""
    pairs = G.neighbour_ids(labels.select("vid", "label"), meta).where("vid < nvid")
    met = pairs.join(labels.select(F.col("vid").alias("nvid"), F.col("label").alias("nlabel")), "nvid").where("label != nlabel")
    a, b = (G.coordinates(F.col(c), meta.shape) for c in ("vid", "nvid"))
    # midway on the doubled lattice; across a period the edge follows the higher end
    middle = [F.when(F.abs(q - p) > 1, F.lit(m - 1)).otherwise(p + q) for p, q, m in zip(a, b, meta.mesh)]
    return met.select(G.index(meta.mesh, *middle).alias("cid"), F.least("label", "nlabel").alias("label1"), F.greatest("label", "nlabel").alias("label2"))


def boundary_map(labels: DataFrame, cell_df: DataFrame, meta: GridMeta) -> DataFrame:
    """(cid, dim, n_labels, is_boundary, kind) of every cell: how many regions its vertices lie in.

    An edge between two regions is a boundary, and so is a quad with such an edge and a voxel with such a quad.  Kind 0: none; 1: a boundary;
    2: a quad of the boundary with over two regions; 3: a voxel with over three that also has over two quads of kind 2.
    Unlabelled vertices are skipped.
    """
    pairs = G.cell_vertices(cell_df.select("cid", "dim"), meta).join(labels.select("vid", "label"), "vid")
    seen = pairs.groupBy("cid", "dim").agg(F.countDistinct("label").alias("n_labels"))
    edges = cut_in_loop(seen.where("dim = 1 and n_labels = 2").select("cid"))
    quads = G.cofacets(edges, meta).select(F.col("ccid").alias("cid")).distinct()
    voxels = G.cofacets(quads, meta).select(F.col("ccid").alias("cid")).distinct()
    seen = seen.join(edges.union(quads).union(voxels).withColumn("_on", F.lit(True)), "cid", "left")
    base = seen.withColumn("kind", F.when(F.col("_on").isNull(), 0).when((F.col("dim") >= 2) & (F.col("n_labels") > 2), 2).otherwise(1))
    quads = base.where("dim = 2 and kind = 2")
    held = G.cofacets(quads.select("cid"), meta).groupBy(F.col("ccid").alias("cid")).agg(F.count("*").alias("n2"))
    out = base.join(held, "cid", "left").withColumn(
        "kind", F.when((F.col("dim") == 3) & (F.col("n_labels") > 3) & (F.col("n2") > 2), 3).when((F.col("dim") == 3) & F.col("n2").isNull() & (F.col("kind") > 1), 1).otherwise(F.col("kind")))
    return out.select("cid", "dim", "n_labels", (F.col("kind") > 0).alias("is_boundary"), "kind")


def region_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("area"))


def region_statistics(labels: DataFrame, total: int) -> DataFrame:
    """One row: regions, labelled and unlabelled vertices, smallest, largest and mean area."""
    sizes = region_sizes(labels.where("label is not null"))
    return sizes.agg(F.count("*").alias("regions"), F.coalesce(F.sum("area"), F.lit(0)).alias("labelled"), F.min("area").alias("min_area"), F.max("area").alias("max_area"), F.avg("area").alias("mean_area")).withColumn(
        "unlabelled", F.lit(total) - F.col("labelled"))


def certain_regions(field: DataFrame, meta: GridMeta, up: bool = True) -> DataFrame:
    """(vid, label): a vertex takes a label if all its earlier neighbours have it; others stay out.

    Earlier means higher for maxima.  Vertices whose steepest path and whose every other rising path agree are certain: a
    vertex is uncertain as soon as one of its earlier neighbours is uncertain or differs, which spreads downhill.
    """
    labels = basins(field, meta, up)
    near = G.neighbours(field, meta)
    earlier = G.order_of("nvalue", "nvid") > G.order_of() if up else G.order_of("nvalue", "nvid") < G.order_of()
    links = near.where(earlier).select("vid", "nvid").join(labels, "vid").join(labels.select(F.col("vid").alias("nvid"), F.col("label").alias("nlabel")), "nvid")
    links = cut(links)
    doubt = cut(links.where("label != nlabel").select("vid").distinct())
    front = doubt
    while not front.isEmpty():
        reached = links.join(front.select(F.col("vid").alias("nvid")), "nvid").select("vid").distinct()
        front = cut(reached.join(doubt, "vid", "left_anti"))
        doubt = cut(doubt.union(front))
    return labels.join(doubt, "vid", "left_anti")


def merge_islands(labels: DataFrame, field: DataFrame, meta: GridMeta, up: bool = True) -> DataFrame:
    """(vid, label) where a connected piece whose earliest vertex has an earlier neighbour in another region takes that region's label."""
    pairs = G.neighbour_ids(labels, meta).join(labels.select(F.col("vid").alias("nvid"), F.col("label").alias("nlabel")), "nvid")
    found = connected_components(pairs.where("label = nlabel").select(F.col("vid").alias("src"), F.col("nvid").alias("dst")))
    pieces = labels.join(found, labels["vid"] == found["node"], "left").select("vid", "label", F.coalesce("component", "vid").alias("piece"))
    own = pieces.join(field.select("vid", "value"), "vid")
    first = own.groupBy("piece", "label").agg((F.max(G.order_of()) if up else F.min(G.order_of())).alias("first"))
    near = G.neighbours(field, meta).join(first, F.col("vid") == F.col("first.i")).join(pieces.select(F.col("vid").alias("nvid"), F.col("piece").alias("npiece")), "nvid")
    other = G.order_of("nvalue", "nvid")
    earlier = near.where((other > F.col("first") if up else other < F.col("first")) & (F.col("npiece") != F.col("piece")))
    to = earlier.groupBy("piece").agg((F.max(F.struct(other, "npiece")) if up else F.min(F.struct(other, "npiece")))["npiece"].alias("next"))
    roots = terminal(first.select(F.col("piece").alias("id")).join(to.withColumnRenamed("piece", "id"), "id", "left"))
    named = roots.join(first.select(F.col("piece").alias("root"), "label"), "root").select(F.col("id").alias("piece"), "label")
    return pieces.drop("label").join(named, "piece").select("vid", "label")


def active_cells(extremes: DataFrame, iso: float) -> DataFrame:
    """Cells of an extremes table that an isosurface crosses."""
    return extremes.where((F.col("min_value") < iso) & (F.col("max_value") >= iso))


def crossings(field: DataFrame, meta: GridMeta, iso: float) -> DataFrame:
    """(vid, nvid, px, py, pz): where grid edges cross the level, by linear interpolation."""
    pairs = G.neighbours(field, meta).where("vid < nvid").where((F.least("value", "nvalue") < iso) & (F.greatest("value", "nvalue") >= iso))
    share = (F.lit(iso) - F.col("value")) / (F.col("nvalue") - F.col("value"))
    a, b = (G.coordinates(F.col(c), meta.shape) for c in ("vid", "nvid"))
    return pairs.select("vid", "nvid", *[(p + share * (q - p)).alias(n) for p, q, n in zip(a, b, ("px", "py", "pz"))])


def restricted_regions(edges: DataFrame, meta: GridMeta, certain: bool = False) -> DataFrame:
    """(cid, label) of a set of edges (cid, value): regions that grow from the highest edge down, inside the set alone.

    Edges of a quad are neighbours; the order is (value, id).  The highest edge without a region takes that of its highest neighbour that has
    one, or begins a new one.  So each edge points to its highest higher neighbour, and all regions grow at once by pointer doubling.
    ``certain`` keeps the edges whose higher neighbours are all certain and of one region.
    """
    own = cut(edges.select("cid", "value"))
    near = G.cofacets(own.select(F.col("cid").alias("a")), meta, "a", "quad")
    near = G.facets(near, meta, "quad", "cid").where("a != cid").select("a", "cid").distinct()
    met = near.join(own, "cid").join(own.select(F.col("cid").alias("a"), F.col("value").alias("_v")), "a")
    higher = cut(met.where(F.struct("value", "cid") > F.struct(F.col("_v").alias("value"), F.col("a").alias("cid"))).select("a", "cid", "value"))
    best = higher.groupBy("a").agg(F.max(F.struct("value", "cid"))["cid"].alias("next"))
    labels = terminal(own.select(F.col("cid").alias("id")).join(best.withColumnRenamed("a", "id"), "id", "left")).select(F.col("id").alias("cid"), F.col("root").alias("label"))
    if not certain:
        return labels
    labels = cut(labels)
    links = cut(higher.select("a", "cid").join(labels, "cid").join(labels.select(F.col("cid").alias("a"), F.col("label").alias("_l")), "a"))
    doubt = front = cut(links.where("label != _l").select(F.col("a").alias("cid")).distinct())
    while not front.isEmpty():
        front = cut_in_loop(links.join(front, "cid").select(F.col("a").alias("cid")).distinct().join(doubt, "cid", "left_anti"))
        doubt = cut_in_loop(doubt.union(front))
    return labels.join(doubt, "cid", "left_anti")


def region_graph(labels: DataFrame, meta: GridMeta) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions as a graph: nodes (label, area), edges (label1, label2, n_edges) and the cells of the border of each two (label1, label2, cid)."""
    border = cut(separators(labels, meta).select("label1", "label2", "cid"))
    return region_sizes(labels).select("label", "area"), border.groupBy("label1", "label2").agg(F.count("*").alias("n_edges")), border


def stratified_skeleton(boundary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(skeleton, forced) cells (cid) of a boundary map: where over two regions meet, and where over three do."""
    return boundary.where("kind >= 2").select("cid"), boundary.where("kind >= 3").select("cid")


def geodesic_density(seeds: DataFrame, field: DataFrame, meta: GridMeta, budget: float, least: float, solid: float, slow: float = 1.0) -> DataFrame:
    """(seed, volume, free, density): samples that a walk from each seed (vid) reaches within a budget, and their share of a free ball's.

    Steps go to all neighbours and cost their length times one plus a slowdown, which is 0 where both samples are at least ``solid`` and rises
    to ``slow`` for one at ``least``; samples at or under ``least`` cannot be entered.  All seeds walk together; a round sends on what got cheaper.
    """
    grid = field.select("vid", F.col("value").cast("double").alias("value")).where(F.col("value") > least)
    offers = []
    base = G.coordinates(F.col("vid"), meta.shape)
    for o in G.offsets(meta, "full"):
        at = [G.wrapped(b + d, n, p) for b, d, n, p in zip(base, o, meta.shape, meta.periodic)]
        ok = F.lit(True)
        for b, d, n, p in zip(base, o, meta.shape, meta.periodic):
            ok = ok & (G.inside(b + d, n, p) if d and not p else F.lit(True))
        offers.append(F.when(ok, F.struct(G.index(meta.shape, *at).alias("nvid"), F.lit(float(sum(map(abs, o)) ** 0.5)).alias("step"))))
    every = F.explode(F.array_compact(F.array(*offers))).alias("s")
    met = grid.select("vid", "value", every).select("vid", "value", "s.nvid", "s.step").join(grid.select(F.col("vid").alias("nvid"), F.col("value").alias("nvalue")), "nvid")
    low = F.least("value", "nvalue", F.lit(float(solid)))
    cost = F.col("step") * (1 + slow * (solid - low) / (solid - least))
    edges = cut(met.select("vid", "nvid", cost.alias("cost")))
    begun = seeds.select("vid").distinct().join(grid, "vid", "left_semi").select(F.col("vid").alias("seed"), "vid", F.lit(0.0).alias("dist"))
    state = front = cut_in_loop(begun)
    while not front.isEmpty():
        sent = front.join(edges, "vid").select("seed", F.col("nvid").alias("vid"), (F.col("dist") + F.col("cost")).alias("dist")).where(F.col("dist") <= budget)
        best = sent.groupBy("seed", "vid").agg(F.min("dist").alias("dist"))
        front = cut_in_loop(best.join(state.withColumnRenamed("dist", "_old"), ["seed", "vid"], "left").where("_old is null or dist < _old").select("seed", "vid", "dist"))
        state = cut_in_loop(state.join(front.select("seed", "vid"), ["seed", "vid"], "left_anti").union(front))
    free = len(_ball(len(meta.axes), budget))
    return state.groupBy("seed").agg(F.count("*").alias("volume")).select("seed", "volume", F.lit(free).alias("free"), (F.col("volume") / free).alias("density"))


def _ball(dims: int, budget: float) -> set[tuple[int, ...]]:
    """Offsets that free steps to all neighbours reach within a budget: as many diagonal steps as possible, longest first."""
    from itertools import product

    reach, out = int(budget), set()
    for o in product(range(-reach, reach + 1), repeat=dims):
        sizes = sorted(map(abs, o), reverse=True) + [0] * (3 - dims)
        if sizes[2] * 3 ** 0.5 + (sizes[1] - sizes[2]) * 2 ** 0.5 + (sizes[0] - sizes[1]) <= budget + 1e-9:
            out.add(o)
    return out
