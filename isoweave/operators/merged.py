"""Geometry of a simplified complex: lines of merged arcs, and the manifolds that living nodes have taken over."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from isoweave.functions import grid as G
from isoweave.functions.grid import GridMeta
from isoweave.operators import geometry as L
from isoweave.operators.hierarchy import Hierarchy
from isoweave.operators.iterate import dense_ids
from isoweave.runtime import cut_in_loop


def base_lines(grad: DataFrame, meta: GridMeta) -> DataFrame:
    """(lower, upper, side, pos, cid): the cells of every arc between a saddle and an extremum, from its upper node to its lower one."""
    out = None
    for up in (False, True):
        line = cut_in_loop(L.arc_geometry(grad, meta, up))
        last = line.groupBy("sid", "side").agg(F.max(F.struct("pos", "cid")).alias("last"))
        end = last.select("sid", "side", F.col("last.cid").alias("end"), F.col("last.pos").alias("length")).join(grad.where("is_critical").select(F.col("cid").alias("end")), "end", "left_semi")
        met = line.join(end, ["sid", "side"])
        ends = [F.col("sid"), F.col("end")] if up else [F.col("end"), F.col("sid")]
        part = met.select(ends[0].alias("lower"), ends[1].alias("upper"), "side", (F.col("length") - F.col("pos") if up else F.col("pos")).alias("pos"), "cid")
        out = part if out is None else out.union(part)
    return out


def _options(lines: DataFrame, made: DataFrame) -> DataFrame:
    """(lower, upper, first, n, side, via_lower, via_upper, inner): the ways of each two nodes, numbered on.

    A given line is one way.  What a cancellation made of the ways of two others is their product, ``inner`` being the number of the
    ways below the cancelled upper node.
    """
    given = lines.select("lower", "upper", "side").distinct()
    every = given.select("lower", "upper", F.lit(-1).alias("round"), F.lit(1).cast("long").alias("n"), "side", F.lit(None).cast("long").alias("via_lower"), F.lit(None).cast("long").alias("via_upper"))
    every = every.union(made.select("lower", "upper", "round", F.col("mult").alias("n"), F.lit(None).cast("long"), "via_lower", "via_upper"))
    total = every.groupBy(F.col("lower").alias("_w"), F.col("upper").alias("_u")).agg(F.sum("n").alias("inner"))
    before = Window.partitionBy("lower", "upper").orderBy("round", "side", "via_lower", "via_upper").rowsBetween(Window.unboundedPreceding, -1)
    placed = every.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    return placed.join(total, (F.col("lower") == F.col("_w")) & (F.col("via_upper") == F.col("_u")), "left").select("lower", "upper", "first", "n", "side", "via_lower", "via_upper", "inner")


def merged_lines(lines: DataFrame, found: Hierarchy, arcs: DataFrame) -> DataFrame:
    """(lower, upper, number, pos, cid): the cells of living arcs (lower, upper, mult), from the upper node to the lower one; ``mult`` lines each.

    An arc that the cancellation of L-U made between W and X is X-L, then L-U backwards, then U-W.  All arcs are taken apart together, a level
    of such pieces a round, down to given lines.  A piece keeps its place as the list of its turns at each level.  At last the pieces'
    cells follow each other, and what is walked back at once is left out; lines stream through, one after the other.
    """
    options = cut_in_loop(_options(lines, found.made))
    whole = arcs.select("lower", "upper", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mult") - 1)).alias("number"))
    front = whole.select(F.struct("lower", "upper", "number").alias("line"), F.array().cast("array<int>").alias("place"), "lower", "upper", F.col("number").alias("way"), F.lit(True).alias("ahead"))
    done, front = None, cut_in_loop(front)
    while not front.isEmpty():
        met = front.join(options, ["lower", "upper"]).where((F.col("way") >= F.col("first")) & (F.col("way") < F.col("first") + F.col("n")))
        met = cut_in_loop(met.withColumn("rest", F.col("way") - F.col("first")))
        ready = met.where("side is not null").select("line", "place", "lower", "upper", "side", "ahead")
        done = ready if done is None else done.union(ready)
        turn = lambda i: F.when(F.col("ahead"), F.lit(i)).otherwise(F.lit(2 - i)).alias("turn")
        piece = lambda i, low, high, way, ahead: F.struct(turn(i), F.col(low).alias("lower"), F.col(high).alias("upper"), way.alias("way"), ahead.alias("ahead"))
        over, under = F.floor(F.col("rest") / F.col("inner")).cast("long"), F.col("rest") % F.col("inner")
        pieces = F.array(
            piece(0, "via_lower", "upper", over, F.col("ahead")), piece(1, "via_lower", "via_upper", F.lit(0).cast("long"), ~F.col("ahead")), piece(2, "lower", "via_upper", under, F.col("ahead")))
        opened = met.where("side is null").select("line", "place", F.explode(pieces).alias("p"))
        front = cut_in_loop(opened.select("line", F.concat("place", F.array("p.turn")).alias("place"), "p.lower", "p.upper", "p.way", "p.ahead"))
    if done is None:
        return lines.select("lower", "upper", F.lit(0).cast("long").alias("number"), "pos", "cid").limit(0)
    cells = done.join(lines, ["lower", "upper", "side"]).select("line", "place", F.when(F.col("ahead"), F.col("pos")).otherwise(-F.col("pos")).alias("pos"), "cid")
    return reduced(cells.select("line.lower", "line.upper", "line.number", "place", "pos", "cid"))


def reduced(walks: DataFrame) -> DataFrame:
    """(lower, upper, number, pos, cid): walks (lower, upper, number, place, pos, cid) without repeated cells in a row and without steps back.

    One line's cells are held while it lasts.
    """
    keys = ["lower", "upper", "number"]
    made = StructType([StructField(c, LongType()) for c in (*keys, "pos", "cid")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        told = lambda: pa.RecordBatch.from_arrays([pa.array([k] * len(held), pa.int64()) for k in now] + [pa.array(range(len(held)), pa.int64()), pa.array(held, pa.int64())], made.names)
        for batch in batches:
            for *line, cid in zip(*(batch.column(c).to_pylist() for c in (*keys, "cid"))):
                if line != now:
                    if now:
                        yield told()
                    now, held = line, []
                if held and held[-1] == cid:
                    continue
                if len(held) > 1 and held[-2] == cid:
                    held.pop()
                else:
                    held.append(cid)
        if now:
            yield told()

    return walks.repartition(*keys).sortWithinPartitions(*keys, "place", "pos").select(*keys, "cid").mapInArrow(run, made)


def constituents(parts: DataFrame, nodes: DataFrame, limit: float | None = None) -> DataFrame:
    """(nid, part, descending): nodes whose descending or ascending manifold belongs to each living node (nid), itself included.

    A node that dies leaves its manifold, with all that it had taken over, to the nodes that ``parts`` names; so the parts are what can be
    reached, a step a round.
    """
    taken = parts if limit is None else parts.where(F.col("time") <= limit)
    taken = cut_in_loop(taken.select(F.col("nid").alias("part"), F.col("part").alias("further"), "descending").distinct())
    front = nodes.select("nid", F.col("nid").alias("part"), F.explode(F.array(F.lit(True), F.lit(False))).alias("descending"))
    every = front = cut_in_loop(front)
    while True:
        reached = front.join(taken, ["part", "descending"]).select("nid", F.col("further").alias("part"), "descending").distinct()
        front = cut_in_loop(reached.join(every, ["nid", "part", "descending"], "left_anti"))
        if front.isEmpty():
            return every
        every = cut_in_loop(every.union(front))


def flow_manifolds(grad: DataFrame, meta: GridMeta, dim: int, descending: bool = True) -> DataFrame:
    """(nid, cid): the cells of dimension ``dim`` on the paths down from each critical cell of it (or up to it), the cell itself included.

    Down: from a cell through a facet to the other cell that the facet is paired with.  Paths branch and meet again; each cell is kept once.
    """
    own = cut_in_loop(grad.where(F.col("dim") == dim).select("cid", "pair_cid", "is_critical"))
    step = dim - 1 if descending else dim + 1
    gates = grad.where((F.col("dim") == step) & ~F.col("is_critical")).select(F.col("cid").alias("gate"), F.col("pair_cid").alias("next"))
    near = (G.facets if descending else G.cofacets)(own.select("cid"), meta, "cid", "gate")
    ways = near.join(gates, "gate").where("next != cid").join(own.select(F.col("cid").alias("next")), "next", "left_semi")
    ways = cut_in_loop(ways.select("cid", "next"))
    every = front = cut_in_loop(own.where("is_critical").select(F.col("cid").alias("nid"), "cid"))
    while True:
        reached = front.join(ways, "cid").select("nid", F.col("next").alias("cid")).distinct()
        front = cut_in_loop(reached.join(every, ["nid", "cid"], "left_anti"))
        if front.isEmpty():
            return every
        every = cut_in_loop(every.union(front))


def living_manifolds(manifolds: DataFrame, owned: DataFrame) -> DataFrame:
    """(nid, cid): the cells of each living node: those of all its parts (nid, part); ``manifolds`` (nid, cid) of the given nodes."""
    return owned.join(manifolds.select(F.col("nid").alias("part"), "cid"), "part").select("nid", "cid").distinct()


def skeleton(nodes: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, arcs and geometry of a simplified complex under dense ids, as ``raster.write_skeleton`` takes them.

    ``nodes`` are the living nodes and ``lines`` their merged lines (lower, upper, number, pos, cid).  Nodes get ``node`` in the order of nid; arcs
    (arc, lower, upper, number, n_cells) are in the order of their nodes and number, and the geometry is (arc, pos, cid).
    """
    ids = cut_in_loop(dense_ids(nodes, "nid", "node"))
    keyed = lines.withColumn("key", F.struct("lower", "upper", "number"))
    arc_ids = cut_in_loop(dense_ids(keyed, "key", "arc"))
    size = keyed.groupBy("key").agg(F.count("*").alias("n_cells"))
    arcs = arc_ids.join(size, "key").select("arc", "key.*", "n_cells")
    for end in ("lower", "upper"):
        arcs = arcs.join(ids.select(F.col("nid").alias(end), F.col("node").alias(f"_{end}")), end)
    arcs = arcs.select("arc", F.col("_lower").alias("lower"), F.col("_upper").alias("upper"), "number", "n_cells")
    return nodes.join(ids, "nid"), arcs, keyed.join(arc_ids, "key").select("arc", "pos", "cid")
