"""Cancellation of arcs by persistence, as rounds of independent cancellations over the tables of living arcs."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from isoweave.functions import grid as G
from isoweave.functions.grid import GridMeta
from isoweave.runtime import cut_in_loop

ENDS = ("lower_value", "upper_value", "lower_bnd", "upper_bnd")
#: living arcs that are finished in one task by the same rule, a fixed bound
TAIL = 1 << 16


class Hierarchy(NamedTuple):
    """``gone`` (round, lower, upper, dim, persistence, time), ``live`` (lower, upper, dim, ends, mult, born, persistence),
    ``parts`` (round, nid, part, descending, time) and ``made`` (round, lower, upper, dim, mult, time, via_lower, via_upper).

    ``time`` is the largest persistence up to and with the cancellation, in the order one by one.
    """

    gone: DataFrame
    live: DataFrame
    parts: DataFrame
    made: DataFrame


def _placed(arcs: DataFrame, nodes: DataFrame, frozen: DataFrame | None) -> DataFrame:
    """Arcs with the value and the boundary class of both ends, one row for each two nodes; frozen nodes have no class."""
    own = nodes.select("nid", "value", "bnd")
    if frozen is not None:
        own = own.join(frozen.select("nid").distinct().withColumn("_still", F.lit(True)), "nid", "left").withColumn("bnd", F.when(F.col("_still").isNull(), F.col("bnd"))).drop("_still")
    for end in ("lower", "upper"):
        arcs = arcs.join(own.select(F.col("nid").alias(end), F.col("value").alias(f"{end}_value"), F.col("bnd").alias(f"{end}_bnd")), end)
    return arcs.groupBy("lower", "upper", "dim", *ENDS).agg(F.sum("mult").alias("mult")).withColumn("born", F.lit(float("-inf")))


def _ranked(live: DataFrame, limit: float, weighted: bool, guarded: bool) -> DataFrame:
    """``live`` with ``key``, (persistence, weight, lower, upper) of an arc that may be cancelled, else null, and ``base``, the least key of what may come of it."""
    up, down = live.groupBy("lower").agg(F.sum("mult").alias("_up")), live.groupBy("upper").agg(F.sum("mult").alias("_down"))
    out = live.join(up, "lower").join(down, "upper") if weighted else live.withColumns({"_up": F.lit(1).cast("long"), "_down": F.lit(1).cast("long")})
    height = (F.col("upper_value") - F.col("lower_value")).cast("double").alias("persistence")
    may = (F.col("mult") == 1) & F.coalesce(F.col("lower_bnd") == F.col("upper_bnd"), F.lit(False)) & (height <= limit)
    wide = F.lit(False)
    if guarded:
        # a saddle that alone joins two minima stays when it would go with another saddle
        pair = live.where("dim = 0").groupBy(F.col("upper").alias("sid")).agg(F.min("lower").alias("a"), F.max("lower").alias("b")).where("a < b")
        only = pair.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("sid").alias("lower")).where("n = 1")
        out = out.join(only.select("lower", F.lit(True).alias("_only")), "lower", "left")
        wide = may & (F.col("dim") == 1) & F.col("_only").isNotNull()
        may = may & ~wide
    key = F.struct(height, ((F.col("_up") - 1) * (F.col("_down") - 1)).alias("weight"), "lower", "upper")
    base = F.struct(height, F.lit(-1).cast("long").alias("weight"), "lower", "upper")
    return out.select(*live.columns, F.when(may, key).alias("key"), base.alias("base"), (may | wide).alias("wide"))


def _nearest(bounds: DataFrame, wide: bool) -> DataFrame:
    """(n, own, near): the least bound of the arcs at a node, and of those at it or a neighbour (where ``wide``)."""
    at = bounds.select(F.col("lower").alias("n"), F.col("upper").alias("m"), "bound").union(bounds.select(F.col("upper").alias("n"), F.col("lower").alias("m"), "bound"))
    own = at.groupBy("n").agg(F.min("bound").alias("own"))
    if not wide:
        return own.withColumn("near", F.col("own"))
    return at.join(own.select(F.col("n").alias("m"), "own"), "m").groupBy("n").agg(F.min("bound").alias("_b"), F.min("own").alias("_o")).select("n", F.col("_b").alias("own"), F.least("_b", "_o").alias("near"))


def _independent(ranked: DataFrame) -> DataFrame:
    """The arcs that nothing before them can touch.

    Each arc has a bound, the least key with which it, or an arc that comes of it, may be cancelled.  An arc that may be cancelled has its key.  One
    that may not can still carry a cancellation at one of its ends on to the other: its bound is the larger of its own persistence and the
    least bound of an arc at its ends.  Where persistences are equal the weights decide, and these change with the arcs around: there a bound is not
    above what lies within a step of the ends.  Bounds fall to a fixed point, never under the least key of all, so that arc is always chosen.
    An arc goes if no arc within one step of its ends has a bound under its key.
    """
    ties = not ranked.where("key is not null").groupBy("key.persistence").count().where("count > 1").isEmpty()
    bounds = ranked.select("lower", "upper", "key", "base", "wide", F.col("key").alias("bound"))
    while True:
        near = _nearest(bounds, ties)
        met = bounds.join(near.select(F.col("n").alias("lower"), F.col("own").alias("_l"), F.col("near").alias("_ln")), "lower").join(near.select(F.col("n").alias("upper"), F.col("own").alias("_u"), F.col("near").alias("_un")), "upper")
        least = F.when(F.col("wide"), F.least("_ln", "_un")).otherwise(F.least("_l", "_u"))
        fallen = F.when(least.isNotNull(), F.greatest("base", least))
        # without ties the bound of an arc with a key is the key
        new = F.least("key", fallen) if ties else F.coalesce("key", fallen)
        met = cut_in_loop(met.select("lower", "upper", "key", "base", "wide", new.alias("bound"), (~new.eqNullSafe(F.col("bound"))).alias("_fell")))
        bounds = met.drop("_fell")
        if met.where("_fell").isEmpty():
            break
    near, out = _nearest(bounds, True), ranked.where("key is not null")
    for end in ("lower", "upper"):
        out = out.join(near.select(F.col("n").alias(end), F.col("near").alias(f"_{end}")), end).where(F.col("key") <= F.col(f"_{end}"))
    return out.select("lower", "upper", "dim", "key.persistence", F.greatest("key.persistence", "born").alias("time"))


class _Serial:
    """The same rule one by one: arcs by node, and a queue of keys."""

    def __init__(self, rows: list[dict], limit: float, weighted: bool, guarded: bool):
        self.limit, self.weighted, self.guarded = limit, weighted, guarded
        self.above: dict = defaultdict(dict)  # node -> upper node -> [mult, dim, born]
        self.below: dict = defaultdict(dict)
        self.value, self.bnd, self.queue, self.waiting = {}, {}, [], defaultdict(set)
        for r in rows:
            for end in ("lower", "upper"):
                self.value[r[end]], self.bnd[r[end]] = r[f"{end}_value"], r[f"{end}_bnd"]
            self.above[r["lower"]][r["upper"]] = self.below[r["upper"]][r["lower"]] = [r["mult"], r["dim"], r["born"]]
        for low, ups in self.above.items():
            for high in ups:
                self.offer(low, high)

    def key(self, low: int, high: int) -> tuple:
        weight = (sum(x[0] for x in self.above[low].values()) - 1) * (sum(x[0] for x in self.below[high].values()) - 1) if self.weighted else 0
        return float(self.value[high] - self.value[low]), weight, low, high

    def offer(self, low: int, high: int) -> None:
        same = self.bnd[low] is not None and self.bnd[low] == self.bnd[high]
        if same and self.above[low][high][0] == 1 and self.value[high] - self.value[low] <= self.limit:
            heapq.heappush(self.queue, self.key(low, high))

    def pair(self, saddle: int) -> tuple | None:
        ends = [n for n, x in self.below.get(saddle, {}).items() if x[1] == 0]
        return (min(ends), max(ends)) if ends and min(ends) < max(ends) else None

    def alone(self, saddle: int) -> tuple | None:
        """The two minima that only this saddle joins."""
        pair = self.pair(saddle)
        return pair if pair and not any(s != saddle and self.pair(s) == pair for s in self.above[pair[0]]) else None

    def run(self) -> Iterator[tuple[tuple, list, list, list]]:
        """(cancelled arc, made arcs, nodes above, nodes below) in order."""
        while self.queue:
            key = heapq.heappop(self.queue)
            low, high = key[2:]
            arc = self.above.get(low, {}).get(high)
            if arc is None or arc[0] != 1 or key != self.key(low, high):
                continue
            if self.guarded and arc[1] == 1 and (pair := self.alone(low)):
                self.waiting[pair].add((low, high))
                continue
            yield self.cancel(low, high, max(key[0], arc[2]))

    def cancel(self, low: int, high: int, time: float) -> tuple:
        dim = self.above[low][high][1]
        above = [(x, m[0]) for x, m in self.above[low].items() if x != high]
        below = [(w, m[0]) for w, m in self.below[high].items() if w != low]
        touched = set()
        for n in (low, high):
            for x in self.above.pop(n, {}):
                self.below[x].pop(n, None)
                touched.add(x)
            for w in self.below.pop(n, {}):
                self.above[w].pop(n, None)
                touched.add(w)
        for w, m in below:
            for x, k in above:
                old = self.above[w].get(x, [0, dim, float("-inf")])
                self.above[w][x] = self.below[x][w] = [old[0] + m * k, dim, max(old[2], time)]
        for n in touched - {low, high}:
            for x in self.above.get(n, {}):
                self.offer(n, x)
            for w in self.below.get(n, {}):
                self.offer(w, n)
        if self.guarded and dim == 0:
            for x, _ in above:
                for w in self.waiting.pop(self.pair(x), ()):
                    if w[1] in self.above.get(w[0], {}):
                        self.offer(*w)
        return (low, high, dim, float(self.value[high] - self.value[low]), time), [(w, x, dim, m * k) for w, m in below for x, k in above], [x for x, _ in above], [w for w, _ in below]


def _finished(live: DataFrame, number: int, limit: float, weighted: bool, guarded: bool) -> DataFrame:
    """(kind, round, a, b, dim, mult, x, time, c, d): the rest of the hierarchy of at most ``TAIL`` arcs, one by one in one task.

    Kinds: 0 a cancellation, 1 a made arc, 2 a part, 3 a living arc.
    """
    out = StructType.fromDDL("kind int, round int, a long, b long, dim int, mult long, x double, time double, c long, d long")
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Serial([r for b in batches for r in b.to_pylist()], limit, weighted, guarded)
        rows: list[tuple] = []
        told = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], out.names)
        for i, ((low, high, dim, height, time), made, above, below) in enumerate(state.run(), number + 1):
            rows.append((0, i, low, high, dim, 1, height, time, None, None))
            rows += [(1, i, w, x, d, m, None, time, low, high) for w, x, d, m in made]
            rows += [(2, i, x, high, 1, None, None, time, None, None) for x in above] + [(2, i, w, low, 0, None, None, time, None, None) for w in below]
            if len(rows) > 1 << 14:
                yield told()
                rows = []
        for low, ups in state.above.items():
            rows += [(3, number, low, high, dim, m, None, born, None, None) for high, (m, dim, born) in ups.items()]
        if rows:
            yield told()

    return live.coalesce(1).mapInArrow(run, out)


def hierarchy(arcs: DataFrame, nodes: DataFrame, limit: float, frozen: DataFrame | None = None, weighted: bool = True, guarded: bool = False, tail: int | None = None) -> Hierarchy:
    """All cancellations of persistence up to ``limit``, in the order of doing always the first arc of all.

    ``arcs`` (lower, upper, dim, mult) and ``nodes`` (nid, value, bnd) may come from anywhere.  An arc may go if it is the only one between its
    ends, these are of one boundary class and neither is in ``frozen`` (nid).  The order is (persistence, weight, lower, upper);
    ``weighted=False`` leaves the weight out.  ``guarded`` keeps a 1-saddle that alone joins two minima from going with a 2-saddle.

    With the arc L-U go all arcs at L and U, and each W below U is joined to each X above L (``made``).  ``parts``: the node whose manifold each
    neighbour takes over, X that of U (descending), W that of L.  A round cancels every arc that no earlier cancellation can
    touch; no two of them touch the same or joined nodes.  At most ``tail`` arcs (``TAIL``) are finished by the same rule in one task.
    """
    spark, tail = arcs.sparkSession, TAIL if tail is None else tail
    live, number = cut_in_loop(_placed(arcs.select("lower", "upper", F.col("dim").cast("int").alias("dim"), F.col("mult").cast("long").alias("mult")), nodes, frozen)), 0
    gone = spark.createDataFrame([], "round int, lower long, upper long, dim int, persistence double, time double")
    parts = spark.createDataFrame([], "round int, nid long, part long, descending boolean, time double")
    grown = spark.createDataFrame([], "round int, lower long, upper long, dim int, mult long, time double, via_lower long, via_upper long")
    height = F.col("upper_value") - F.col("lower_value")
    while (rows := live.count()) > tail:
        ranked = cut_in_loop(_ranked(live, limit, weighted, guarded))
        if ranked.where("key is not null").isEmpty():
            break
        chosen = cut_in_loop(_independent(ranked))
        number += 1
        pair = chosen.select(F.col("lower").alias("l"), F.col("upper").alias("u"), "time")
        above = live.join(pair, live["lower"] == pair["l"]).where("upper != u").select("l", "u", "time", F.col("upper").alias("x"), F.col("upper_value").alias("xv"), F.col("upper_bnd").alias("xb"), F.col("mult").alias("xm"))
        below = live.join(pair, live["upper"] == pair["u"]).where("lower != l").select("u", "l", "time", F.col("lower").alias("w"), "dim", F.col("lower_value").alias("wv"), F.col("lower_bnd").alias("wb"), F.col("mult").alias("wm"))
        made = cut_in_loop(above.join(below.drop("l", "time"), "u").select(
            F.col("w").alias("lower"), F.col("x").alias("upper"), "dim", F.col("wv").alias("lower_value"), F.col("xv").alias("upper_value"), F.col("wb").alias("lower_bnd"), F.col("xb").alias("upper_bnd"),
            (F.col("wm") * F.col("xm")).alias("mult"), F.col("time").alias("born"), "l", "u"))
        taken = above.select(F.lit(number).alias("round"), F.col("x").alias("nid"), F.col("u").alias("part"), F.lit(True).alias("descending"), "time").union(
            below.select(F.lit(number), "w", "l", F.lit(False), "time"))
        dead = pair.select(F.col("l").alias("n")).union(pair.select("u"))
        rest = live.join(dead.withColumnRenamed("n", "lower"), "lower", "left_anti").join(dead.withColumnRenamed("n", "upper"), "upper", "left_anti")
        # what a round gives is written once; the tables of all rounds are unions of these
        gone = gone.union(chosen.select(F.lit(number), "lower", "upper", "dim", "persistence", "time"))
        parts = parts.union(cut_in_loop(taken))
        grown = grown.union(made.select(F.lit(number), "lower", "upper", "dim", "mult", "born", "l", "u"))
        fresh = made.drop("l", "u")
        live = cut_in_loop(rest.select(*fresh.columns).union(fresh).groupBy("lower", "upper", "dim", *ENDS).agg(F.sum("mult").alias("mult"), F.max("born").alias("born")))
    if rows > tail or not rows:
        return Hierarchy(gone, live.withColumn("persistence", height), parts, grown)
    done = cut_in_loop(_finished(live, number, limit, weighted, guarded))
    gone = gone.union(done.where("kind = 0").select("round", "a", "b", "dim", "x", "time"))
    parts = parts.union(done.where("kind = 2").select("round", "a", "b", F.col("dim") == 1, "time"))
    grown = grown.union(done.where("kind = 1").select("round", "a", "b", "dim", "mult", "time", "c", "d"))
    at = live.select(F.col("lower").alias("nid"), F.col("lower_value").alias("value"), F.col("lower_bnd").alias("bnd")).union(live.select("upper", "upper_value", "upper_bnd")).distinct()
    left = done.where("kind = 3").select(F.col("a").alias("lower"), F.col("b").alias("upper"), "dim", "mult", F.col("time").alias("born"))
    for end in ("lower", "upper"):
        left = left.join(at.select(F.col("nid").alias(end), F.col("value").alias(f"{end}_value"), F.col("bnd").alias(f"{end}_bnd")), end)
    return Hierarchy(gone, left.select("lower", "upper", "dim", *ENDS, "mult", "born", height.alias("persistence")), parts, grown)


def living_nodes(nodes: DataFrame, cancellations: DataFrame) -> DataFrame:
    gone = cancellations.select(F.col("lower").alias("nid")).union(cancellations.select("upper"))
    return nodes.join(gone, "nid", "left_anti")


def until(gone: DataFrame, limit: float) -> DataFrame:
    """The cancellations that a threshold up to the hierarchy's own includes; nothing is computed again."""
    return gone.where(F.col("time") <= limit)


def living_arcs(arcs: DataFrame, nodes: DataFrame, found: Hierarchy, limit: float) -> DataFrame:
    """(lower, upper, dim, mult, persistence) at a threshold: arcs given or made until then whose ends both live longer."""
    gone = until(found.gone, limit)
    dead = gone.select(F.col("lower").alias("n")).union(gone.select("upper"))
    every = arcs.select("lower", "upper", F.col("dim").cast("int").alias("dim"), F.col("mult").cast("long").alias("mult")).union(found.made.where(F.col("time") <= limit).select("lower", "upper", "dim", "mult"))
    for end in ("lower", "upper"):
        every = every.join(dead.withColumnRenamed("n", end), end, "left_anti")
    out = every.groupBy("lower", "upper", "dim").agg(F.sum("mult").alias("mult"))
    for end in ("lower", "upper"):
        out = out.join(nodes.select(F.col("nid").alias(end), F.col("value").alias(f"_{end}")), end)
    return out.select("lower", "upper", "dim", "mult", (F.col("_upper") - F.col("_lower")).alias("persistence"))


def history(gone: DataFrame, nodes: DataFrame, dims: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """(rank, lower, upper, dim, persistence, time, left0, left1, ...): cancellations in order and the nodes of each dimension left after each.

    A cancellation of dimension d takes a node of d and one of d + 1.  Running counts are counts inside range partitions plus the totals of
    those before, so no window spans the table.
    """
    total = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one number a dimension
    order = ["time", "round", "persistence", "lower", "upper"]
    parts = int(gone.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_in_loop(gone.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("dim") == k, 1)).alias(f"n{k}") for k in dims])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("n", *[f"n{k}" for k in dims])])
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "part").withColumns({f"_r{k}": F.count(F.when(F.col("dim") == k, 1)).over(inside) + F.col(f"_n{k}") for k in dims} | {"rank": F.count("*").over(inside) + F.col("_n") - 1})
    left = [(F.lit(total.get(k, 0)) - F.col(f"_r{k}") - (F.col(f"_r{k - 1}") if k - 1 in dims else F.lit(0))).alias(f"left{k}") for k in dims]
    return out.select("rank", "lower", "upper", "dim", "persistence", "time", *left)


def limit_for(gone: DataFrame, nodes: DataFrame, dim: int, keep: int) -> DataFrame:
    """One row: the least persistence at which at most ``keep`` nodes of a dimension are left; 0 where that never comes."""
    told = history(gone, nodes, tuple(range(dim + 1)))
    return told.where(F.col(f"left{dim}") <= keep).agg(F.coalesce(F.min("time"), F.lit(0.0)).alias("limit"))


def grouped_hierarchy(arcs: DataFrame, nodes: DataFrame, groups: DataFrame, limit: float, tail: int | None = None) -> Hierarchy:
    """``hierarchy`` inside each group of ``groups`` (nid, group): ends of arcs between groups are frozen.  All groups share the rounds."""
    met = arcs.select("lower", "upper")
    for end in ("lower", "upper"):
        met = met.join(groups.select(F.col("nid").alias(end), F.col("group").alias(f"_{end}")), end)
    across = met.where("_lower != _upper")
    frozen = across.select(F.col("lower").alias("nid")).union(across.select("upper")).distinct()
    return hierarchy(arcs, nodes, limit, frozen=cut_in_loop(frozen), tail=tail)


def saddle_arcs(grad: DataFrame, meta: GridMeta, marks: DataFrame | None = None) -> DataFrame:
    """(lower, upper, dim, mult): arcs of 1-saddles with 2-saddles of a volume, with the number of paths.

    All paths go down together from the 2-saddles, from a quad through an edge to the quad paired with it; paths that meet are
    added up, so a round has at most one row for each 2-saddle and quad.  ``marks`` (cid, asc_dim) leaves out the quads from which no 1-saddle
    can be reached, those outside every ascending manifold.
    """
    edges = cut_in_loop(grad.where("dim = 1").select("cid", "pair_cid", "is_critical"))
    quads = grad.where("dim = 2").select("cid")
    if marks is not None:
        quads = quads.join(marks.where(F.col("asc_dim") < len(meta.axes)), "cid", "left_semi")
    facets = G.facets(quads, meta).join(edges.withColumnRenamed("cid", "fcid"), "fcid")
    own = grad.where("dim = 2").select("cid", F.col("pair_cid").alias("_own"))
    # ways from a quad: to a critical edge, or through an edge to another quad
    ways = facets.join(own, "cid").where((F.col("fcid") != F.col("_own")) & (F.col("pair_cid") != F.col("cid"))).select("cid", "fcid", "is_critical", "pair_cid")
    ways = ways.where("is_critical").select("cid", F.lit(True).alias("ends"), F.col("fcid").alias("next")).union(
        ways.where("not is_critical").join(quads.withColumnRenamed("cid", "pair_cid"), "pair_cid", "left_semi").select("cid", F.lit(False), "pair_cid"))
    ways = cut_in_loop(ways)
    front = cut_in_loop(grad.where("is_critical and dim = 2").select(F.col("cid").alias("upper"), "cid", F.lit(1).cast("long").alias("mult")))
    out = None
    while not front.isEmpty():
        moved = cut_in_loop(front.join(ways, "cid").groupBy("upper", "ends", F.col("next").alias("cid")).agg(F.sum("mult").alias("mult")))
        found = moved.where("ends").select(F.col("cid").alias("lower"), "upper", F.lit(1).alias("dim"), "mult")
        out = found if out is None else out.union(found)
        front = moved.where("not ends").select("upper", "cid", "mult")
    if out is None:
        return grad.sparkSession.createDataFrame([], "lower long, upper long, dim int, mult long")
    return out.groupBy("lower", "upper", "dim").agg(F.sum("mult").alias("mult"))
