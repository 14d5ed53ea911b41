"""Hard-negative mining with an STR-packed R-tree.

1. Components become whole numbers (floor of 256 times the value), so scores are exact inner products.
2. Packing: the two widest coordinates cut the rows into at most ``TILES`` tiles of about equal size, by quantiles of the first and then
   inside each slab of the second; a tile that is still large (copies of one vector cannot be cut apart) is dealt into chunks of about
   ``CHUNK`` rows.  Inside a chunk sort-tile-recursion goes on over the other coordinates down to leaves of ``LEAF`` rows,
   and runs of ``FAN`` boxes make the boxes above.
3. A box [low, high] bounds the inner product with an anchor: each coordinate adds an interval between its products with both ends.
4. Search: a queue hands out boxes by their upper bound; boxes strictly below the k-th best row so far go, and so do those outside
   every score window.  Anchors are searched in their own chunk first.  What they find there prunes tiles by the tiles' boxes, and
   only what is left is sent on, so each chunk meets a stream of anchors, never a table of all of them.
5. Positives come first; their scores give the windows of the negatives, which are searched in the same way.

Chunks, their boxes and k rows an anchor are all that a task holds.  The driver and every task get the tiles' boxes, at most ``TILES`` of them.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; a shorter vector counts as
filled up with zeros; repeated rows each count, and an anchor's own row alone is not another row; equal scores go by id, then label;
components beyond 2^40 count as 2^40, scores beyond a long as its end; a negative positive score leaves no window; an empty table gives no
row; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from isoweave.runtime import column, cut, map_arrow, table

TILES, CHUNK, LEAF, FAN = 1024, 4096, 256, 8
SCALE, EDGE = 256, 1 << 40
LONG = (1 << 63) - 1


@dataclass
class Tree:
    """Rows in packed order with the boxes of every level, leaves first."""

    vectors: np.ndarray
    rid: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)


def packed(vectors: np.ndarray, rid: np.ndarray, vec_id: np.ndarray, label: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> Tree:
    order = _str_order(vectors, np.arange(len(vectors)), 0, leaf)
    tree = Tree(vectors[order], rid[order], vec_id[order], label[order])
    starts = np.arange(0, len(vectors), leaf)
    low, high = np.minimum.reduceat(tree.vectors, starts), np.maximum.reduceat(tree.vectors, starts)
    tree.levels.append((low, high))
    while len(low) > 1:
        starts = np.arange(0, len(low), fan)
        low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
        tree.levels.append((low, high))
    return tree


def _str_order(x: np.ndarray, rows: np.ndarray, dim: int, leaf: int) -> np.ndarray:
    """Rows sorted by one coordinate and cut into slabs, each sorted by the next one, down to leaves."""
    leaves, left = -(-len(rows) // leaf), x.shape[1] - dim
    if leaves <= 1 or left <= 0:
        return rows
    slabs = max(2, math.ceil(leaves ** (1 / left)))
    rows, step = rows[np.argsort(x[rows, dim], kind="stable")], leaf * -(-leaves // slabs)
    return np.concatenate([_str_order(x, rows[i:i + step], dim + 1, leaf) for i in range(0, len(rows), step)])


def bounds(anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of the anchor with points of each box."""
    plus, minus = np.maximum(anchor, 0), np.minimum(anchor, 0)
    return low @ plus + high @ minus, high @ plus + low @ minus


def search(tree: Tree, anchor: np.ndarray, label: int, rid: int, windows: list[tuple], k: int, same: bool, fan: int = FAN, leaf: int = LEAF) -> list[list[tuple]]:
    """For each window (low, high, kth) its k best rows (-score, vec_id, label, rid) of the anchor's label or of the others.

    ``kth``: a score that the k-th best row is known to reach.  Bounds of None are open.
    """
    best: list[list[tuple]] = [[] for _ in windows]
    floor = [max([x for x in (low, kth) if x is not None], default=-math.inf) for low, _, kth in windows]
    roof = [math.inf if high is None else high for _, high, _ in windows]
    queue, top = [], len(tree.levels) - 1

    def offer(level: int, first: int, last: int) -> None:
        low, high = tree.levels[level]
        least, most = bounds(anchor, low[first:last], high[first:last])
        for i, (a, b) in enumerate(zip(least.tolist(), most.tolist())):
            if any(b >= f and a <= r for f, r in zip(floor, roof)):
                heapq.heappush(queue, (-b, level, first + i, a))

    offer(top, 0, len(tree.levels[top][0]))
    while queue:
        most, level, i, least = heapq.heappop(queue)
        if -most < min(floor):
            break
        if not any(-most >= f and least <= r for f, r in zip(floor, roof)):
            continue
        if level:
            offer(level - 1, i * fan, min((i + 1) * fan, len(tree.levels[level - 1][0])))
            continue
        rows = slice(i * leaf, (i + 1) * leaf)
        scores = tree.vectors[rows] @ anchor
        fits = (tree.label[rows] == label if same else tree.label[rows] != label) & (tree.rid[rows] != rid)
        for w, found in enumerate(best):
            at = (fits & (scores >= floor[w]) & (scores <= roof[w])).nonzero()[0]
            if not len(at):
                continue
            if len(at) > 4 * k:
                at = at[scores[at] >= np.sort(scores[at])[-k]]
            found += [(-int(scores[j]), int(tree.vec_id[i * leaf + j]), int(tree.label[i * leaf + j]), int(tree.rid[i * leaf + j])) for j in at.tolist()]
            found.sort()
            del found[k:]
            if len(found) == k:
                floor[w] = max(floor[w], -found[-1][0])
    return best


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | None = None) -> DataFrame:
    """(vec_id, label, v): rows that take part, with whole components."""
    x = column(vector)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    clip = lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE), F.lit(EDGE)), F.lit(-EDGE))
    bounded = lambda c: F.greatest(F.least(c.cast("double"), F.lit(float(EDGE))), F.lit(-float(EDGE)))
    rows = df.select(column(key).cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), x.alias("x"), F.coalesce(whole, F.lit(False)).alias("whole"))
    return rows.where("vec_id is not null and label is not null and x is not null and whole").select("vec_id", "label", F.transform("x", lambda c: clip(bounded(c))).alias("v"))


@dataclass(frozen=True)
class Packing:
    """Rows dealt to (tile, chunk), with the boxes of the tiles."""

    rows: DataFrame
    tiles: dict[int, tuple[int, list[int], list[int]]]  # tile -> chunks, low, high
    dims: int
    exact: bool  # products and sums of doubles are exact


def pack(rows: DataFrame, tiles: int = TILES, chunk: int = CHUNK) -> Packing:
    """Sort-tile-recursion over the cluster: rows (vec_id, label, v) with rid, tile and chunk, coordinates by spread."""
    given = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dims"), F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0)).alias("most")).first()  # three numbers
    n, dims = given["n"], max(1, given["dims"])
    full = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("v"))))
    spread = {r["pos"]: r["spread"] for r in full.select(F.posexplode("v")).groupBy("pos").agg(F.stddev_pop("col").alias("spread")).collect()}  # one number a coordinate
    order = sorted(range(dims), key=lambda i: -spread.get(i, 0.0))
    base = cut(full.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", F.array(*[F.col("v")[i] for i in order]).alias("v")))
    side = max(1, math.isqrt(min(tiles, max(1, 2 * n // chunk))))
    shares = F.array(*[F.lit((i + 1) / side) for i in range(side - 1)])
    beyond = lambda i, cuts: sum(((F.col("v")[i] > c).cast("int") for c in cuts), F.lit(0))
    base = base.withColumn("slab", beyond(0, base.agg(F.percentile_approx(F.col("v")[0], shares)).first()[0] or [] if side > 1 else []))
    cell = F.lit(0)
    if side > 1 and dims > 1:
        for s, cuts in base.groupBy("slab").agg(F.percentile_approx(F.col("v")[1], shares)).collect():  # side x side numbers
            cell = F.when(F.col("slab") == s, beyond(1, cuts)).otherwise(cell)
    dealt = base.withColumn("tile", F.col("slab") * side + cell).drop("slab")
    sizes = {r["tile"]: r["n"] for r in dealt.groupBy("tile").agg(F.count("*").alias("n")).collect()}  # at most ``tiles`` numbers
    edges = dealt.select("tile", F.posexplode("v")).groupBy("tile", "pos").agg(F.min("col").alias("low"), F.max("col").alias("high"))
    edges = edges.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("pos", "low", "high"))).alias("box")).collect()  # at most ``tiles`` boxes
    sizes = {r["tile"]: (-(-sizes[r["tile"]] // chunk), [x["low"] for x in r["box"]], [x["high"] for x in r["box"]]) for r in edges}
    chunks = F.lit(1)
    for t, (c, _, _) in sizes.items():
        chunks = F.when(F.col("tile") == t, c).otherwise(chunks) if c > 1 else chunks
    return Packing(dealt.withColumn("chunk", F.pmod(F.xxhash64("rid"), chunks).cast("int")), sizes, dims, dims * given["most"] ** 2 < 1 << 53)


def _floats(column_: pa.Array, exact: bool, dims: int) -> np.ndarray:
    flat = column_.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return flat.astype(float) if exact else flat.astype(object)


FOUND = StructType([StructField("aid", LongType()), StructField("window", IntegerType())] + [StructField(c, LongType()) for c in ("score", "vec_id", "label", "rid")])
WINDOWS = "array<struct<low:bigint,high:bigint,kth:bigint>>"


def _searched(packing: Packing, asks: DataFrame, k: int, same: bool) -> DataFrame:
    """(aid, window, score, vec_id, label, rid): the best rows of each chunk for the anchors that are sent there.

    ``asks`` (tile, chunk, aid, label, v, windows).  A chunk's rows come before its anchors.
    """
    nothing = F.lit(None).cast(WINDOWS)
    own = packing.rows.select("tile", "chunk", F.lit(0).alias("kind"), "rid", "vec_id", "label", "v", nothing.alias("windows"))
    sent = asks.select("tile", "chunk", F.lit(1).alias("kind"), F.col("aid").alias("rid"), F.lit(0).cast("long").alias("vec_id"), "label", "v", "windows")
    rows = own.union(sent).repartition("tile", "chunk").sortWithinPartitions("tile", "chunk", "kind")
    exact, dims = packing.exact, packing.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, tree = None, [], None
        for batch in batches:
            tile, chunk, kind = (batch.column(i).to_numpy() for i in range(3))
            edges = ((tile[1:] != tile[:-1]) | (chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])).nonzero()[0] + 1
            out: list[tuple] = []
            for a, b in zip([0, *edges], [*edges, len(tile)]):
                if (tile[a], chunk[a]) != place:
                    place, held, tree = (tile[a], chunk[a]), [], None
                part = batch.slice(a, b - a)
                vectors, numbers = _floats(part.column(6), exact, dims), [part.column(i).to_numpy() for i in (3, 4, 5)]
                if not kind[a]:
                    held.append((vectors, *numbers))
                    continue
                if tree is None:
                    if not held:
                        continue
                    tree, held = packed(*[np.concatenate(c) for c in zip(*held)]), []
                for aid, label, v, windows in zip(numbers[0].tolist(), numbers[2].tolist(), vectors, part.column(7).to_pylist()):
                    for w, found in enumerate(search(tree, v, label, aid, [(x["low"], x["high"], x["kth"]) for x in windows], k, same)):
                        out += [(aid, w, max(-LONG - 1, min(LONG, -score)), i, of, rid) for score, i, of, rid in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == 1 else pa.int64()) for n, c in enumerate(zip(*out))], FOUND.names)

    return map_arrow(rows, run, FOUND)


def _sent(packing: Packing, asks: DataFrame, but_own: bool) -> DataFrame:
    """``asks`` once for each chunk of the tiles whose box may hold a row of one of the windows."""
    known = [(t, *x) for t, x in sorted(packing.tiles.items())]
    exact, dims = packing.exact, packing.dims
    kind = float if exact else object
    low, high = (np.array([x[i] for x in known], dtype=kind).reshape(len(known), dims) for i in (2, 3))
    given = asks.select("aid", "label", "v", "windows", "home", "room")
    made = StructType([StructField("tile", IntegerType()), StructField("chunk", IntegerType())] + given.schema.fields[:4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, room = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            taken: list[tuple[int, int, int]] = []
            for i, (v, windows) in enumerate(zip(_floats(batch.column(2), exact, dims), batch.column(3).to_pylist())):
                least, most = bounds(v, low, high)
                may = np.zeros(len(known), bool)
                for w in windows:
                    floor = max([x for x in (w["low"], w["kth"]) if x is not None], default=-math.inf)
                    may |= ((most >= floor) & (least <= (math.inf if w["high"] is None else w["high"]))).astype(bool)
                taken += [(i, known[t][0], c) for t in may.nonzero()[0] for c in range(known[t][1]) if not but_own or (known[t][0], c) != (home[i], room[i])]
            for at in range(0, len(taken), 4096):
                rows, tile, chunk = zip(*taken[at:at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(tile, pa.int32()), pa.array(chunk, pa.int32())] + [batch.column(i).take(pa.array(rows)) for i in range(4)], made.names)

    return map_arrow(given, run, made)


def _best(found: DataFrame, k: int) -> DataFrame:
    """``found`` with rank: the k best rows of each anchor and window, and no others."""
    order = Window.partitionBy("aid", "window").orderBy(F.desc("score"), "vec_id", "label", "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (80, 100), high: tuple[int, int] = (100, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (vec_id, label, v).

    A negative's score s lies in the window low <= s / p <= high of the positive's score p; both ratios are (numerator, denominator).
    """
    packing = pack(rows)
    fresh = F.array(F.struct(F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"), F.lit(None).cast("long").alias("kth")))
    anchors = packing.rows.where(is_anchor).select(F.col("rid").alias("aid"), "vec_id", "label", "v", F.col("tile").alias("home"), F.col("chunk").alias("room"))
    first = cut(_best(_searched(packing, anchors.select(F.col("home").alias("tile"), F.col("room").alias("chunk"), "aid", "label", "v", fresh.alias("windows")), positives, True), positives))
    seeds = first.groupBy("aid").agg(F.max(F.when(F.col("rank") == positives, F.col("score"))).alias("kth"))
    seeded = anchors.join(seeds, "aid", "left").withColumn("windows", F.array(F.struct(F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"), F.col("kth").alias("kth"))))
    others = _searched(packing, _sent(packing, seeded, but_own=True), positives, True)
    chosen = cut(_best(first.drop("rank").union(others), positives))
    # whole scores s with s * denominator >= p * numerator, and the like above
    p = F.col("score").cast("decimal(38,0)")
    up, down = -_floored(-p * low[0], low[1]), _floored(p * high[0], high[1])
    window = F.struct(F.col("rank").alias("rank"), F.struct(up.alias("low"), down.alias("high"), F.lit(None).cast("long").alias("kth")).alias("w"))
    asked = chosen.groupBy("aid").agg(F.transform(F.array_sort(F.collect_list(window)), lambda x: x["w"]).alias("windows"))  # at most ``positives`` of them
    found = _best(_searched(packing, _sent(packing, anchors.join(asked, "aid"), but_own=False), negatives, False), negatives)
    pairs = chosen.select("aid", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(pairs, ["aid", "window"]).join(anchors.select("aid", F.col("vec_id").alias("anchor_id")), "aid")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _floored(x: Column, by: int) -> Column:
    """The whole quotient rounded down."""
    return F.call_function("div", x - F.pmod(x, F.lit(by).cast("decimal(38,0)")), F.lit(by).cast("decimal(38,0)"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(quantised(rows, label=label), F.col("vec_id") % 100 == 0)


SQL = """
with given as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) as bigint) as score
    from given a join given b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positive as (select anchor_id, vec_id as positive_id, score as positive_score from scored where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over w as int) as rank, vec_id as negative_id, positive_score, score as negative_score from positive join scored using (anchor_id)
where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
window w as (partition by anchor_id, positive_id order by score desc, vec_id) qualify row_number() over w <= 5
"""

QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES = {"op12_hard_negatives": SQL}
