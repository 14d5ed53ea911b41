"""Morse-Smale complex: critical points, arcs, the merge graph's persistence pairs and selections by threshold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoweave.functions import grid as G
from isoweave.functions.grid import GridMeta
from isoweave.operators.iterate import connected_components, terminal
from isoweave.runtime import cut_in_loop


def nodes(grad: DataFrame, field: DataFrame, meta: GridMeta) -> DataFrame:
    """(nid, cid, dim, bnd, value, x, y, z): critical cells with the value of their highest vertex and world position."""
    at = G.coordinates(F.col("cid"), meta.mesh)
    found = grad.where("is_critical").join(field.select(F.col("vid").alias("owner"), "value"), "owner")
    return found.select(F.col("cid").alias("nid"), "cid", "dim", G.boundary_of(at, meta, meta.mesh).alias("bnd"), "value", *[(c * 0.5).alias(n) for c, n in zip(at, G.NAMES)])


def _down(grad: DataFrame, meta: GridMeta) -> DataFrame:
    """(id, next) over vertices: across the paired edge to its other end; minima stay."""
    own = grad.where("dim = 0").select("cid", "pair_cid", "is_critical")
    a, b = G.coordinates(F.col("cid"), meta.mesh), G.coordinates(F.col("pair_cid"), meta.mesh)
    beyond = [G.wrapped(p + 2 * _step(q - p, n), n, w) for p, q, n, w in zip(a, b, meta.mesh, meta.periodic)]
    return own.select(F.col("cid").alias("id"), F.when(F.col("is_critical"), F.col("cid")).otherwise(G.index(meta.mesh, *beyond)).alias("next"))


def _step(d, n: int):
    """A difference of neighbouring coordinates, across the period if need be."""
    return F.when(d > 1, -1).when(d < -1, 1).otherwise(d)


def _up(grad: DataFrame, meta: GridMeta) -> DataFrame:
    """(id, next) over top cells: through the paired facet to its other cofacet; maxima stay, and null ends at the border."""
    top = len(meta.axes)
    own = grad.where(F.col("dim") == top).select("cid", "pair_cid", "is_critical")
    a, b = G.coordinates(F.col("cid"), meta.mesh), G.coordinates(F.col("pair_cid"), meta.mesh)
    beyond, ok = [], F.lit(True)
    for p, q, n, w in zip(a, b, meta.mesh, meta.periodic):
        at = p + 2 * _step(q - p, n)
        ok = ok & G.inside(at, n, w)
        beyond.append(G.wrapped(at, n, w))
    return own.select(F.col("cid").alias("id"), F.when(F.col("is_critical"), F.col("cid")).when(ok, G.index(meta.mesh, *beyond)).otherwise(F.lit(-1).cast("long")).alias("next"))


def ends_down(grad: DataFrame, meta: GridMeta) -> DataFrame:
    """(cid, label): the minimum that each vertex flows to."""
    return terminal(_down(grad, meta)).select(F.col("id").alias("cid"), F.col("root").alias("label"))


def ends_up(grad: DataFrame, meta: GridMeta) -> DataFrame:
    """(cid, label): the maximum that each top cell flows to; no row where the path leaves the grid."""
    return terminal(_up(grad, meta)).where("root >= 0").select(F.col("id").alias("cid"), F.col("root").alias("label"))


def arcs(grad: DataFrame, field: DataFrame, meta: GridMeta, low: bool = True, high: bool = True) -> DataFrame:
    """(lower, upper, dim, mult, persistence): arcs of minima with 1-saddles (``low``) and of top saddles with maxima (``high``)."""
    if not low and not high:
        raise ValueError("no kind of arcs is chosen")
    top = len(meta.axes)
    return _with_persistence([part for wanted, part in ((low, _low_arcs), (high, _high_arcs)) if wanted], grad, field, meta, top)


def _low_arcs(grad: DataFrame, meta: GridMeta, top: int) -> DataFrame:
    saddles = grad.where("is_critical and dim = 1").select("cid")
    low = G.facets(saddles, meta).join(ends_down(grad, meta).withColumnRenamed("cid", "fcid"), "fcid")
    low = low.groupBy(F.col("label").alias("lower"), F.col("cid").alias("upper")).agg(F.count("*").alias("mult")).withColumn("dim", F.lit(0))
    return low.select("lower", "upper", "dim", "mult")


def _high_arcs(grad: DataFrame, meta: GridMeta, top: int) -> DataFrame:
    saddles = grad.where(F.col("is_critical") & (F.col("dim") == top - 1)).select("cid")
    high = G.cofacets(saddles, meta).join(ends_up(grad, meta).withColumnRenamed("cid", "ccid"), "ccid")
    high = high.groupBy(F.col("cid").alias("lower"), F.col("label").alias("upper")).agg(F.count("*").alias("mult")).withColumn("dim", F.lit(top - 1))
    return high.select("lower", "upper", "dim", "mult")


def _with_persistence(parts: list, grad: DataFrame, field: DataFrame, meta: GridMeta, top: int) -> DataFrame:
    value = nodes(grad, field, meta).select("nid", "value")
    out = reduce(DataFrame.union, [part(grad, meta, top) for part in parts])
    out = out.join(value.select(F.col("nid").alias("lower"), F.col("value").alias("_l")), "lower").join(value.select(F.col("nid").alias("upper"), F.col("value").alias("_u")), "upper")
    return out.select("lower", "upper", "dim", "mult", (F.col("_u") - F.col("_l")).alias("persistence"))


def extremum_graph(arc_df: DataFrame, node_df: DataFrame, meta: GridMeta, maxima: bool = True) -> DataFrame:
    """(e1, e2, sid, svalue): saddles that join two different extrema."""
    top = len(meta.axes)
    saddle, end = ("lower", "upper") if maxima else ("upper", "lower")
    own = arc_df.where(F.col("dim") == (top - 1 if maxima else 0))
    pairs = own.groupBy(F.col(saddle).alias("sid")).agg(F.min(end).alias("e1"), F.max(end).alias("e2")).where("e1 != e2")
    return pairs.join(node_df.select(F.col("nid").alias("sid"), F.col("value").alias("svalue")), "sid").select("e1", "e2", "sid", "svalue")


def merge_pairs(edges: DataFrame, extrema: DataFrame, maxima: bool = True) -> DataFrame:
    """(nid, into, sid, persistence): the elder rule over an extremum graph.

    ``extrema`` has nid and value; the total order is (value, id).  An extremum whose best saddle leads to a more extreme neighbour
    dies there: no earlier saddle touches it, so it is still alone when its component meets the elder one.  All such
    extrema die in the same round; edges then move to the ends of the chains of ``into``, and parallel ones keep their best saddle.
    ``into`` is the extremum across the saddle in the graph as given, so it does not depend on rounds.
    """
    sign = 1 if maxima else -1
    rank = lambda value, key: F.struct((F.col(value) * sign).alias("v"), (F.col(key) * sign).alias("i"))
    order = extrema.select("nid", rank("value", "nid").alias("rank"))
    live = edges.select("e1", "e2", rank("svalue", "sid").alias("key"))
    for end, name in (("e1", "a"), ("e2", "b")):
        live = live.join(order.select(F.col("nid").alias(end), F.col("rank").alias(name)), end)
    # best: the saddle's rank and the given ends on the side of a and of b
    live, out = cut_in_loop(live.select("a", "b", F.struct("key", F.col("e1").alias("p"), F.col("e2").alias("q")).alias("best"))), None
    turned = F.struct("best.key", F.col("best.q").alias("p"), F.col("best.p").alias("q"))
    while not live.isEmpty():
        both = live.union(live.select("b", "a", turned))
        best = both.groupBy("a").agg(F.max(F.struct("best", "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.best").alias("best"))
        gone = cut_in_loop(best.where("a < b"))
        dead = gone.select((F.col("a.i") * sign).alias("nid"), F.col("best.q").alias("into"), (F.col("best.key.i") * sign).alias("sid"), F.abs(F.col("a.v") - F.col("best.key.v")).alias("persistence"))
        out = dead if out is None else cut_in_loop(out.union(dead))
        to = terminal(gone, "a", "b")
        for end in ("a", "b"):
            live = live.join(to.select(F.col("id").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        low_first = live.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("best")).otherwise(turned).alias("best"))
        live = cut_in_loop(low_first.groupBy("a", "b").agg(F.max("best").alias("best")))
    if out is None:
        return extrema.sparkSession.createDataFrame([], "nid long, into long, sid long, persistence double")
    return out


def survivors(labels: DataFrame, pairs: DataFrame, limit: float) -> DataFrame:
    """Labels after every merge of persistence up to ``limit``; only this join is redone when the threshold changes."""
    chosen = pairs.where(F.col("persistence") <= limit)
    to = terminal(chosen, "nid", "into")
    return labels.join(to.select(F.col("id").alias("label"), "root"), "label", "left").select("cid", F.coalesce("root", "label").alias("label"))


def living(node_df: DataFrame, pairs: DataFrame, limit: float) -> DataFrame:
    """Nodes that no merge of persistence up to ``limit`` has cancelled, neither as an extremum nor as a saddle."""
    gone = pairs.where(F.col("persistence") <= limit)
    gone = gone.select("nid").union(gone.select("sid"))
    return node_df.join(gone, "nid", "left_anti")


def default_limits(field: DataFrame) -> DataFrame:
    """One row: cancel at 10 % and base at 1 % of the value range."""
    return field.agg((F.max("value") - F.min("value")).alias("range")).select((F.col("range") * 0.1).alias("cancel"), (F.col("range") * 0.01).alias("base"))


def limit_for_extrema(pairs: DataFrame, keep: int, total: int) -> DataFrame:
    """One row: the least persistence at which at most ``keep`` of ``total`` extrema are left (top-k of the merges)."""
    return pairs.orderBy("persistence").limit(max(0, total - keep)).agg(F.coalesce(F.max("persistence"), F.lit(0.0)).alias("limit"))


def arc_values(arc_df: DataFrame, node_df: DataFrame) -> DataFrame:
    """Arcs with value, boundary class and position of both ends."""
    for end in ("lower", "upper"):
        arc_df = arc_df.join(node_df.select(F.col("nid").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("value", "bnd", "x", "y", "z")]), end)
    return arc_df


def summary(node_df: DataFrame) -> DataFrame:
    return node_df.groupBy("dim").agg(F.count("*").alias("n"))


def arc_weight(arc_df: DataFrame) -> DataFrame:
    """``arc_df`` with weight (up(lower) - 1) * (down(upper) - 1)."""
    up = arc_df.groupBy("lower").agg(F.sum("mult").alias("up"))
    down = arc_df.groupBy("upper").agg(F.sum("mult").alias("down"))
    return arc_df.join(up, "lower").join(down, "upper").withColumn("weight", (F.col("up") - 1) * (F.col("down") - 1)).drop("up", "down")


def incident(arc_df: DataFrame, node_df: DataFrame) -> DataFrame:
    """(nid, lower, upper, dim, mult, persistence): arcs at each node of a set."""
    own = node_df.select("nid")
    return arc_df.join(own, arc_df["lower"] == own["nid"]).select("nid", *arc_df.columns).union(arc_df.join(own, arc_df["upper"] == own["nid"]).select("nid", *arc_df.columns))


def saddle_ends(arc_df: DataFrame, dim: int) -> DataFrame:
    """(sid, ends): extrema at the ends of each saddle of one arc dimension."""
    saddle, end = ("upper", "lower") if dim == 0 else ("lower", "upper")
    return arc_df.where(F.col("dim") == dim).groupBy(F.col(saddle).alias("sid")).agg(F.array_sort(F.collect_set(end)).alias("ends"))


def representative_saddles(edges: DataFrame) -> DataFrame:
    """(e1, e2, sid, svalue): for each unordered pair of extrema its lowest saddle, then by id."""
    best = edges.groupBy(F.least("e1", "e2").alias("e1"), F.greatest("e1", "e2").alias("e2")).agg(F.min(F.struct("svalue", "sid")).alias("b"))
    return best.where("e1 != e2").select("e1", "e2", "b.sid", "b.svalue")


def minimal_network(edges: DataFrame, limits: list[float]) -> DataFrame:
    """(limit, e1, e2, sid, svalue): representative saddles at or above each of a few thresholds."""
    one = representative_saddles(edges)
    return one.withColumn("limit", F.explode(F.array(*[F.lit(float(x)) for x in limits]))).where("svalue >= limit")


def constituents(pairs: DataFrame, limit: float) -> DataFrame:
    """(nid, root): merged extrema and the living one that each ended in."""
    chosen = pairs.where(F.col("persistence") <= limit).select(F.col("nid").alias("src"), F.col("into").alias("dst"))
    return terminal(chosen.select(F.col("src").alias("id"), F.col("dst").alias("next"))).select(F.col("id").alias("nid"), "root")


def pieces(edges: DataFrame) -> DataFrame:
    """Connected pieces of an extremum graph."""
    return connected_components(edges.select(F.col("e1").alias("src"), F.col("e2").alias("dst")))


def ridge_arcs(arc_df: DataFrame, meta: GridMeta) -> DataFrame:
    """Arcs of top saddles with maxima."""
    return arc_df.where(F.col("dim") == len(meta.axes) - 1)


def valley_arcs(arc_df: DataFrame) -> DataFrame:
    """Arcs of minima with 1-saddles."""
    return arc_df.where("dim = 0")


def ligaments(arc_df: DataFrame, node_df: DataFrame, meta: GridMeta, least: float = 0.0) -> DataFrame:
    """(e1, e2, sid, svalue): saddles of at least this value that join two different maxima."""
    return extremum_graph(arc_df, node_df, meta).where(F.col("svalue") >= least)


def filtered_arcs(arc_df: DataFrame, node_df: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Arcs whose lower end is at least ``low`` and whose upper end is at most ``high``."""
    value = node_df.select("nid", "value")
    out = arc_df.join(value.select(F.col("nid").alias("lower"), F.col("value").alias("lower_value")), "lower").join(value.select(F.col("nid").alias("upper"), F.col("value").alias("upper_value")), "upper")
    out = out if low is None else out.where(F.col("lower_value") >= low)
    return out if high is None else out.where(F.col("upper_value") <= high)
