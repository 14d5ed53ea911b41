"""Features of a complex that users read: ordered lines of a cell graph, ridge graphs, ligaments, voids, and their text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isoweave.functions import grid as G
from isoweave.functions.calculus import interpolate
from isoweave.functions.grid import GridMeta
from isoweave.operators import geometry as L
from isoweave.operators.iterate import dense_ids
from isoweave.operators.lines import smooth
from isoweave.runtime import cut, cut_in_loop


def ranked(pointers: DataFrame) -> DataFrame:
    """(id, root, hops): where each chain of (id, next) ends and how many steps that takes; ends point to themselves.

    Steps double each round, as in ``terminal``; chains on a loop are left out.
    """
    state = cut_in_loop(pointers.select("id", F.col("next").alias("root"), (F.col("id") != F.col("next")).cast("long").alias("hops")))
    for _ in range(64):
        jump = state.select(F.col("id").alias("root"), F.col("root").alias("_to"), F.col("hops").alias("_more"))
        moved = cut_in_loop(state.join(jump, "root").select("id", F.col("_to").alias("root"), (F.col("hops") + F.col("_more")).alias("hops"), (F.col("_more") > 0).alias("_moved")))
        state = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return state
    ends = state.join(pointers.where("id = next").select(F.col("id").alias("root")), "root", "left_semi")
    return ends.select("id", "root", "hops")


def graph_lines(graph: DataFrame, meta: GridMeta) -> DataFrame:
    """(edge_id, pos, cid) of the chains of ``geometry.mesh_graph``, vertices at both ends included, from the end with the smaller vertex.

    Every two joined cells are two half-edges, each pointing to the next one on its way; their distances to the ends are found by pointer doubling.
    A chain between two vertices that are one, or that meet it on both sides alike, begins at the side with the smaller cell; closed chains have no
    end and are left out.
    """
    cells = cut(graph.select("cid", "is_vertex", "edge_id"))
    near = G.facets(cells.select("cid"), meta).join(cells.select(F.col("cid").alias("fcid")), "fcid", "left_semi")
    both = cut(near.select(F.col("cid").alias("a"), F.col("fcid").alias("b")).union(near.select("fcid", "cid")))
    inner = cells.where("not is_vertex").select(F.col("cid").alias("b"))
    onward = both.join(inner, "b").join(both.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").where("c != a")
    half = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    going = onward.select(half("a", "b").alias("id"), half("b", "c").alias("next"))
    ended = both.join(cells.where("is_vertex").select(F.col("cid").alias("b")), "b").select(half("a", "b").alias("id"), half("a", "b").alias("next"))
    far = ranked(going.union(ended))
    # for an inner cell, its two ways out: (vertex, last cell before it) and the steps there
    ways = far.where("hops >= 0").select(F.col("id.a").alias("cid"), F.struct(F.col("root.b").alias("vertex"), F.col("root.a").alias("last")).alias("end"), (F.col("hops") + 1).alias("steps"))
    chain = cells.where("not is_vertex").select("cid", "edge_id")
    first = ways.join(chain, "cid").groupBy("edge_id", "cid").agg(F.min(F.struct("end", "steps")).alias("m"), F.max(F.struct("end", "steps")).alias("n"))
    rows = cut(first.select("edge_id", F.col("m.steps").alias("pos"), "cid", F.col("m.end.vertex").alias("v"), F.col("n.end.vertex").alias("w"), (F.col("m.steps") + F.col("n.steps")).alias("total")))
    ends = rows.groupBy("edge_id").agg(F.min("v").alias("v"), F.max("w").alias("w"), F.max("total").alias("total"))
    out = rows.select("edge_id", "pos", "cid").union(ends.select("edge_id", F.lit(0).cast("long"), "v")).union(ends.select("edge_id", "total", "w"))
    # two vertices that touch are joined without a cell between them
    direct = near.join(cells.where("is_vertex").select("cid"), "cid", "left_semi").join(cells.where("is_vertex").select(F.col("cid").alias("fcid")), "fcid", "left_semi")
    named = direct.select((-1 - F.col("cid") * 6 - _side("cid", "fcid", meta)).alias("edge_id"), F.least("cid", "fcid").alias("p"), F.greatest("cid", "fcid").alias("q"))
    return out.union(named.select("edge_id", F.lit(0).cast("long"), "p")).union(named.select("edge_id", F.lit(1).cast("long"), "q"))


def _side(cell: str, facet: str, meta: GridMeta) -> Column:
    """Which of the six sides of a cell a facet is, as a number."""
    a, b = G.coordinates(F.col(cell), meta.mesh), G.coordinates(F.col(facet), meta.mesh)
    out = F.lit(0)
    for k in range(3):
        out = F.when(a[k] != b[k], F.lit(2 * k) + (b[k] > a[k]).cast("int")).otherwise(out)
    return out


def positioned(lines: DataFrame, meta: GridMeta, smoothing: int = 0) -> DataFrame:
    """Lines of cells (edge_id, pos, cid) as polylines (line_id, pos, x, y, z) in world positions, smoothed with fixed ends."""
    at = [(c * 0.5).alias(n) for c, n in zip(G.coordinates(F.col("cid"), meta.mesh), G.NAMES)]
    out = lines.select(F.col("edge_id").alias("line_id"), "pos", *at)
    return smooth(out, smoothing) if smoothing else out


def ridge_graph(soup: DataFrame, meta: GridMeta, forced: DataFrame | None = None, smoothing: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph of a line soup (cid): vertices (cid, degree, x, y, z), edges (line_id, vertex1, vertex2, n_cells) and polylines."""
    graph = cut(L.mesh_graph(soup, meta, forced))
    lines = cut(graph_lines(graph, meta))
    at = [(c * 0.5).alias(n) for c, n in zip(G.coordinates(F.col("cid"), meta.mesh), G.NAMES)]
    ends = lines.groupBy(F.col("edge_id").alias("line_id")).agg(F.min_by("cid", "pos").alias("vertex1"), F.max_by("cid", "pos").alias("vertex2"), (F.count("*") - 2).alias("n_cells"))
    return graph.where("is_vertex").select("cid", "degree", *at), ends, positioned(lines, meta, smoothing)


def ligament_lines(lines: DataFrame, nodes: DataFrame, meta: GridMeta, least: float = 0.0, mask: DataFrame | None = None) -> DataFrame:
    """(sid, e1, e2, pos, cid): for each top saddle of at least ``least`` between two different maxima, the cells from the smaller maximum over it to the other.

    ``lines`` (lower, upper, side, pos, cid) run from a maximum to the saddle; ``mask`` (cid) leaves out the points outside it, and what is
    left is numbered on.
    """
    top = len(meta.axes)
    saddles = nodes.where((F.col("dim") == top - 1) & (F.col("value") >= least)).select(F.col("nid").alias("lower"))
    own = lines.join(saddles, "lower", "left_semi").join(nodes.where(F.col("dim") == top).select(F.col("nid").alias("upper")), "upper", "left_semi")
    ends = own.groupBy("lower").agg(F.min("upper").alias("e1"), F.max("upper").alias("e2")).where("e1 < e2")
    met = own.join(ends, "lower")
    length = met.groupBy("lower", "upper").agg(F.max("pos").alias("length"))
    met = met.join(length, ["lower", "upper"])
    # down from the first maximum, then up to the other; the saddle once
    place = F.when(F.col("upper") == F.col("e1"), F.col("pos") - F.col("length")).otherwise(F.col("length") - F.col("pos"))
    walk = met.where("upper = e1 or pos < length").select(F.col("lower").alias("sid"), "e1", "e2", place.alias("_at"), "cid")
    if mask is not None:
        walk = walk.join(mask.select("cid").distinct(), "cid", "left_semi")
    pos = F.row_number().over(Window.partitionBy("sid").orderBy("_at")) - 1
    return walk.select("sid", "e1", "e2", pos.cast("long").alias("pos"), "cid")


def pruned_lines(lines: DataFrame, meta: GridMeta, margin: float = 1.0, mask: DataFrame | None = None) -> DataFrame:
    """Polylines (line_id, pos, x, y, z) without those that end within ``margin`` of the border or, for a ``mask`` (vid), end where the nearest
    sample is not in it; the ids of the others are 0, 1, ... in order."""
    tip = F.struct(*G.NAMES)
    ends = lines.groupBy("line_id").agg(F.min_by(tip, "pos").alias("a"), F.max_by(tip, "pos").alias("b"))
    ends = cut(ends.select("line_id", F.explode(F.array("a", "b")).alias("p")).select("line_id", *[F.col(f"p.{n}").alias(n) for n in G.NAMES]))
    out = F.lit(False)
    for a in meta.axes:
        if not meta.periodic[a]:
            out = out | (F.col(G.NAMES[a]) < margin) | (F.col(G.NAMES[a]) > meta.shape[a] - 1 - margin)
    bad = ends.where(out).select("line_id")
    if mask is not None:
        spot = [G.clamped(F.floor(F.col(n) + 0.5), k) for n, k in zip(G.NAMES, meta.shape)]
        bad = bad.union(ends.select("line_id", G.index(meta.shape, *spot).alias("vid")).join(mask.select("vid"), "vid", "left_anti").select("line_id"))
    kept = cut(lines.join(bad.distinct(), "line_id", "left_anti"))
    named = dense_ids(kept, "line_id", "_id")
    rest = [c for c in kept.columns if c != "line_id"]
    return kept.join(named, "line_id").select(F.col("_id").alias("line_id"), *rest)


def voids(arcs: DataFrame, nodes: DataFrame, meta: GridMeta) -> DataFrame:
    """(nid, n_maxima, length1, length2, length3): for each inner minimum the maxima around it, and the sides of a box about them.

    In a volume the ring goes from the minimum over 1-saddles and 2-saddles, in a plane over its saddles.  The longest side joins the two maxima
    that are farthest apart, the second those that are so across it, the third across both; ties go to the smaller ids.
    """
    top, near = len(meta.axes), arcs.select("lower", "upper").distinct()
    ring = nodes.where("dim = 0 and bnd = 0").select("nid", F.col("nid").alias("at"))
    for _ in range(top):
        ring = ring.join(near, ring["at"] == near["lower"]).select("nid", F.col("upper").alias("at")).distinct()
    where = nodes.select(F.col("nid").alias("at"), *G.NAMES)
    points = cut(ring.join(where, "at"))
    size = points.groupBy("nid").agg(F.count("*").alias("n_maxima"))
    axes: list[DataFrame] = []
    lengths, flat = None, points.select("nid", "at", *[F.col(n).cast("double").alias(n) for n in G.NAMES])
    for i in range(3):
        # the farthest of the farthest: from the mean to a tip, from there to the other, as a ring may be large
        mean = flat.groupBy("nid").agg(*[F.avg(n).alias(f"_{n}") for n in G.NAMES])
        tips = []
        for _ in range(2):
            away = F.sqrt(sum(((F.col(n) - F.col(f"_{n}")) * (F.col(n) - F.col(f"_{n}")) for n in G.NAMES), F.lit(0.0)))
            far = flat.join(mean, "nid").groupBy("nid").agg(F.max(F.struct(F.round(away, 9).alias("d"), (-F.col("at")).alias("i"), *G.NAMES)).alias("f"))
            mean = cut(far.select("nid", *[F.col(f"f.{n}").alias(f"_{n}") for n in G.NAMES], F.col("f.d").alias("_d")))
            tips.append(mean)
            mean = mean.drop("_d")
        a, b = (t.select("nid", *[F.col(f"_{n}").alias(f"{k}{n}") for n in G.NAMES], *([F.col("_d").alias(f"length{i + 1}")] if k == "b" else [])) for k, t in zip("ab", tips))
        axis = cut(a.join(b, "nid"))
        axes.append(axis)
        lengths = axis.select("nid", f"length{i + 1}") if lengths is None else lengths.join(axis.select("nid", f"length{i + 1}"), "nid")
        along = {n: F.when(F.col(f"length{i + 1}") > 0, (F.col(f"b{n}") - F.col(f"a{n}")) / F.col(f"length{i + 1}")).otherwise(0.0) for n in G.NAMES}
        met = flat.join(axis, "nid").withColumns({f"u{n}": c for n, c in along.items()})
        share = sum(((F.col(n) - F.col(f"a{n}")) * F.col(f"u{n}") for n in G.NAMES), F.lit(0.0))
        flat = cut(met.withColumn("_s", share).select("nid", "at", *[(F.col(n) - F.col("_s") * F.col(f"u{n}")).alias(n) for n in G.NAMES]))
    return size.join(lengths, "nid")


def described(cells: DataFrame, meta: GridMeta, field: DataFrame | None = None, key: str = "cid") -> DataFrame:
    """``cells`` with vid (of a vertex, else null), dim, bnd and world position, and the field's interpolated value there."""
    at = G.coordinates(F.col(key), meta.mesh)
    dim = sum((c % 2 for c in at[1:]), at[0] % 2).cast("int")
    vid = F.when(dim == 0, G.index(meta.shape, *[F.floor(c / 2) for c in at]))
    out = cells.withColumns({"vid": vid, "dim": dim, "bnd": G.boundary_of(at, meta, meta.mesh), "x": at[0] * 0.5, "y": at[1] * 0.5, "z": at[2] * 0.5})
    if field is None:
        return out
    spots = out.select(F.col(key).alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz")).distinct()
    return out.join(interpolate(spots, field, meta).select(F.col("pid").alias(key), "value"), key)


def write_graph_text(nodes: DataFrame, edges: DataFrame, geometry: DataFrame, path: str) -> None:
    """Text files of a graph: ``geometry`` (geom, dim, pos, x, y, z) as "geom dim x y z x y z ...", ``nodes`` (geom) and ``edges`` (geom, node1, node2)."""
    point = F.concat_ws(" ", *[F.col(n).cast("double").cast("string") for n in G.NAMES])
    lines = geometry.groupBy("geom", "dim").agg(F.array_sort(F.collect_list(F.struct("pos", point.alias("p")))).alias("ps"))
    lines = lines.select(F.concat_ws(" ", F.col("geom").cast("string"), F.col("dim").cast("string"), F.array_join(F.transform("ps", lambda p: p["p"]), " ")).alias("value"))
    for name, df in (("nodes", nodes.select(F.col("geom").cast("string").alias("value"))), ("edges", edges.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("geom", "node1", "node2")]).alias("value"))), ("geom", lines)):
        df.write.mode("overwrite").text(f"{path}/{name}")


def read_graph_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, geometry) of ``write_graph_text``."""
    part = F.split("value", " ")
    nodes = spark.read.text(f"{path}/nodes").select(F.col("value").cast("long").alias("geom"))
    edges = spark.read.text(f"{path}/edges").select(*[part[i].cast("long").alias(c) for i, c in enumerate(("geom", "node1", "node2"))])
    rows = spark.read.text(f"{path}/geom").select(part[0].cast("long").alias("geom"), part[1].cast("int").alias("dim"), F.slice(part, F.lit(3), F.size(part)).alias("c"))
    rows = rows.select("geom", "dim", "c", F.explode(F.sequence(F.lit(0), F.floor(F.size("c") / 3).cast("int") - 1)).alias("pos"))
    return nodes, edges, rows.select("geom", "dim", F.col("pos").cast("long").alias("pos"), *[F.get("c", F.col("pos") * 3 + i).cast("double").alias(n) for i, n in enumerate(G.NAMES)])


def write_sub_volumes(volumes: DataFrame, boxes: DataFrame, path: str) -> None:
    """Samples (label, vid, value) of components in one folder each, whose name has the label, the box's first sample and its size."""
    size = [F.col(f"{n}1") - F.col(f"{n}0") + 1 for n in G.NAMES]
    name = F.concat_ws("_", F.col("label").cast("string"), *[F.col(f"{n}0").cast("string") for n in G.NAMES], *[s.cast("string") for s in size])
    named = volumes.join(boxes.select("label", name.alias("box")), "label")
    named.repartition("box").write.mode("overwrite").partitionBy("box").parquet(path)
