"""Lines of the complex: arc geometry, manifolds, line soups, and the tables that are written from a simplified complex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isoweave.functions import grid as G
from isoweave.functions.grid import GridMeta
from isoweave.operators import complex as M
from isoweave.operators.iterate import connected_components, dense_ids
from isoweave.runtime import cut_in_loop


def arc_geometry(grad: DataFrame, meta: GridMeta, up: bool = False) -> DataFrame:
    """(sid, side, pos, cid): the cells of each arc from its saddle to the extremum, 1-saddles to minima or top saddles to maxima.

    Every cell of a path is reached by jumps of 1, 2, 4, ... steps that double each round, so there are as many rounds as the longest
    path's length has binary digits.  A path that leaves the grid ends at its last cell.
    """
    top = len(meta.axes)
    pointers = (M._up if up else M._down)(grad, meta).join(grad.select(F.col("cid").alias("id"), F.col("pair_cid").alias("via")), "id")
    pointers = cut_in_loop(pointers.where("next != id").select("id", "via", "next"))
    saddles = grad.where(F.col("is_critical") & (F.col("dim") == (top - 1 if up else 1))).select(F.col("cid").alias("sid"), "cid")
    first = (G.cofacets(saddles, meta, name="tip") if up else G.facets(saddles, meta, name="tip")).select("sid", "tip")
    # both sides of a saddle may lead to the same cell only across a period, so the tip tells the sides apart
    known = cut_in_loop(first.select("sid", F.col("tip").alias("side"), F.lit(0).cast("long").alias("n"), "tip"))
    saddle = known.select("sid", "side", F.lit(0).cast("long").alias("pos"), F.col("sid").alias("cid"))
    jump, step = pointers.where("next >= 0").select("id", "next"), 1
    while True:
        more = cut_in_loop(known.join(jump, known["tip"] == jump["id"]).select("sid", "side", (F.col("n") + step).alias("n"), F.col("next").alias("tip")))
        if more.isEmpty():
            break
        known = cut_in_loop(known.union(more))
        further = jump.select(F.col("id").alias("next"), F.col("next").alias("_to"))
        jump, step = cut_in_loop(jump.join(further, "next").select("id", F.col("_to").alias("next"))), 2 * step
    tips = known.select("sid", "side", (2 * F.col("n") + 1).alias("pos"), F.col("tip").alias("cid"))
    between = known.join(pointers, known["tip"] == pointers["id"]).select("sid", "side", (2 * F.col("n") + 2).alias("pos"), F.col("via").alias("cid"))
    return saddle.union(tips).union(between)


def manifold(labels: DataFrame, extrema: DataFrame) -> DataFrame:
    """(nid, cid): the cells that flow to each extremum of a set (nid); ``labels`` (cid, label)."""
    return labels.join(extrema.select(F.col("nid").alias("label")), "label", "left_semi").select(F.col("label").alias("nid"), "cid")


def line_soup(geometry: DataFrame, arcs: DataFrame | None = None) -> DataFrame:
    """(cid): the different cells of the lines, or of those whose saddle is in ``arcs`` (sid)."""
    kept = geometry if arcs is None else geometry.join(arcs.select("sid").distinct(), "sid", "left_semi")
    return kept.select("cid").distinct()


def mean_along(geometry: DataFrame, values: DataFrame) -> DataFrame:
    """(sid, side, n_cells, mean_value) of each line; ``values`` (cid, value)."""
    return geometry.join(values, "cid").groupBy("sid", "side").agg(F.count("*").alias("n_cells"), F.avg("value").alias("mean_value"))


def line_saddle_ends(line_df: DataFrame) -> DataFrame:
    """(line_id, vertex1, vertex2) from a line graph (vertex, line1, line2), the inverse of ``lines.line_graph``."""
    at = line_df.select("vertex", F.col("line1").alias("line_id")).union(line_df.select("vertex", F.col("line2").alias("line_id"))).where("line_id >= 0").distinct()
    return at.groupBy("line_id").agg(F.min("vertex").alias("vertex1"), F.max("vertex").alias("vertex2"))


def cancellation_history(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(rank, nid, sid, persistence, cum_persistence, left): merges in order of persistence with the extrema that are left after each.

    ``counts`` has one row with ``n``, the extrema at first.  Ranks come from a range partitioning and its offsets.  Merges are in
    order, so the running maximum of the persistence is the persistence itself.
    """
    order = pairs.withColumn("key", F.struct("persistence", "nid"))
    ranked = order.join(dense_ids(order, "key", "rank"), "key").crossJoin(F.broadcast(counts.select("n")))  # one row
    return ranked.select("rank", "nid", "sid", "persistence", F.col("persistence").alias("cum_persistence"), (F.col("n") - F.col("rank") - 1).alias("left"))


def persistence_pairs(arcs: DataFrame, nodes: DataFrame, living: DataFrame) -> DataFrame:
    """(lower, upper, lower_value, upper_value) of the arcs whose ends are both living nodes (nid)."""
    value, own = nodes.select("nid", "value"), living.select("nid")
    out = arcs.join(own.withColumnRenamed("nid", "lower"), "lower", "left_semi").join(own.withColumnRenamed("nid", "upper"), "upper", "left_semi")
    for end in ("lower", "upper"):
        out = out.join(value.select(F.col("nid").alias(end), F.col("value").alias(f"{end}_value")), end)
    return out.select("lower", "upper", "lower_value", "upper_value")


def blocking_reasons(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(reason, n): why arcs cannot be cancelled: ends of unequal boundary class, several arcs between them, or nothing."""
    bnd = nodes.select("nid", "bnd")
    met = arcs.join(bnd.select(F.col("nid").alias("lower"), F.col("bnd").alias("_l")), "lower").join(bnd.select(F.col("nid").alias("upper"), F.col("bnd").alias("_u")), "upper")
    return met.groupBy(F.when(F.col("_l") != F.col("_u"), "boundary").when(F.col("mult") > 1, "multiplicity").otherwise("none").alias("reason")).agg(F.count("*").alias("n"))


def endpoint_histogram(arcs: DataFrame) -> DataFrame:
    """(lower, upper, n): arcs between each two nodes."""
    return arcs.groupBy("lower", "upper").agg(F.sum("mult").alias("n"))


def blobs(labels: DataFrame, field: DataFrame, maxima: DataFrame, meta: GridMeta) -> DataFrame:
    """(vid, label): samples above 0 in the regions of chosen maxima; ``labels`` (vid, label), ``maxima`` (vid)."""
    return labels.join(maxima.select(F.col("vid").alias("label")), "label", "left_semi").join(field.where("value > 0").select("vid"), "vid", "left_semi").select("vid", "label")


def numbered(geometry: DataFrame) -> DataFrame:
    """``geometry`` as polylines (line_id, pos, cid): one line for each saddle and side, ordered from the saddle."""
    line = F.struct("sid", "side")
    lines = dense_ids(geometry.select(line.alias("line")), "line", "line_id")
    pos = F.row_number().over(Window.partitionBy("line_id").orderBy("pos")) - 1
    return geometry.withColumn("line", line).join(lines, "line").select("line_id", pos.cast("long").alias("pos"), "cid")


def mesh_graph(soup: DataFrame, meta: GridMeta, forced: DataFrame | None = None) -> DataFrame:
    """(cid, degree, is_vertex, edge_id) of a set of cells (cid) as a graph.

    Two cells of the set are joined where one is a facet of the other.  Cells of a degree other than 2, and those in ``forced`` (cid), are
    vertices; the other cells form chains, and ``edge_id`` is the least cell of a chain.  Null for vertices.
    """
    own = cut_in_loop(soup.select("cid").distinct())
    met = G.facets(own, meta).join(own.withColumnRenamed("cid", "fcid"), "fcid", "left_semi")
    met = cut_in_loop(met.select(F.col("cid").alias("a"), F.col("fcid").alias("b")))
    degree = met.select(F.col("a").alias("cid")).union(met.select("b")).groupBy("cid").agg(F.count("*").alias("degree"))
    cells = own.join(degree, "cid", "left").select("cid", F.coalesce("degree", F.lit(0)).cast("long").alias("degree")).withColumn("is_vertex", F.col("degree") != 2)
    if forced is not None:
        cells = cells.join(forced.select("cid").distinct().withColumn("_forced", F.lit(True)), "cid", "left").select("cid", "degree", (F.col("is_vertex") | F.col("_forced").isNotNull()).alias("is_vertex"))
    cells = cut_in_loop(cells)
    inner = cells.where("not is_vertex").select("cid")
    links = met.join(inner.withColumnRenamed("cid", "a"), "a", "left_semi").join(inner.withColumnRenamed("cid", "b"), "b", "left_semi")
    chains = connected_components(links, "a", "b").select(F.col("node").alias("cid"), "component")
    return cells.join(chains, "cid", "left").select("cid", "degree", "is_vertex", F.when(~F.col("is_vertex"), F.coalesce("component", "cid")).alias("edge_id"))


def forced_vertices(geometry: DataFrame, values: DataFrame, cuts: list[float]) -> DataFrame:
    """(cid): both ends of every line, and the cells at which a line's value passes one of a few cut points."""
    w = Window.partitionBy("sid", "side").orderBy("pos")
    met = geometry.join(values.select("cid", "value"), "cid").withColumns({"_before": F.lag("value").over(w), "_end": F.lag("pos").over(w).isNull() | F.lead("pos").over(w).isNull()})
    passes = F.lit(False)
    for c in cuts:
        passes = passes | ((F.col("_before") < c) != (F.col("value") < c))
    return met.where(F.col("_end") | (F.col("_before").isNotNull() & passes)).select("cid").distinct()


def graph_edges(graph: DataFrame, meta: GridMeta) -> DataFrame:
    """(edge_id, n_cells, vertex1, vertex2) of the chains of ``mesh_graph``; the vertices are null for a closed chain."""
    cells = cut_in_loop(graph)
    ends = cells.where("is_vertex").select("cid")
    near = G.facets(cells.select("cid"), meta).select(F.col("cid").alias("a"), F.col("fcid").alias("b"))
    near = near.union(near.select("b", "a"))
    chain = cells.where("not is_vertex").select(F.col("cid").alias("a"), "edge_id")
    touched = near.join(chain, "a").join(ends.withColumnRenamed("cid", "b"), "b", "left_semi").groupBy("edge_id").agg(F.min("b").alias("vertex1"), F.max("b").alias("vertex2"))
    size = chain.groupBy("edge_id").agg(F.count("*").alias("n_cells"))
    return size.join(touched, "edge_id", "left").select("edge_id", "n_cells", "vertex1", "vertex2")


def death_records(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sid, nid, saddle_value, value, persistence): the saddle and the extremum of each merge with their values."""
    at = nodes.select("nid", "value")
    out = pairs.select("nid", "sid", "persistence").join(at, "nid").join(at.select(F.col("nid").alias("sid"), F.col("value").alias("saddle_value")), "sid")
    return out.select("sid", "nid", "saddle_value", "value", "persistence")


def sampled_soup(soup: DataFrame, fields: dict[str, DataFrame]) -> DataFrame:
    """(cid, one column for each field): the cells of a soup with the values (cid, value) of several fields."""
    out = soup.select("cid").distinct()
    for name, values in fields.items():
        out = out.join(values.select("cid", F.col("value").alias(name)), "cid", "left")
    return out
