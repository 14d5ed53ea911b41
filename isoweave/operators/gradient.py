"""Discrete gradient: each vertex's lower star is paired on its own, many vertices at once.

A tile is a group of vertices with a halo of one sample, sent by an explode; one shuffle.  Inside a tile the lower stars of all
vertices are worked on together as arrays of 3^d - 1 cells; a cell belongs to the star of its highest vertex, so
no two tiles write the same cell.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoweave.functions import grid as G
from isoweave.functions.grid import GridMeta
from isoweave.runtime import cut_in_loop

TILE = 256
SCHEMA = "cid long, dim int, pair_cid long, is_critical boolean, owner long"
OUT = pa.schema([("cid", pa.int64()), ("dim", pa.int32()), ("pair_cid", pa.int64()), ("is_critical", pa.bool_()), ("owner", pa.int64())])


@lru_cache(maxsize=8)
def _stencil(flat: tuple[bool, ...]) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """Offsets of the star's cells on the doubled lattice, their dimensions, and which is a facet of which."""
    cells = [o for o in product(*[(0,) if f else (-1, 0, 1) for f in flat]) if any(o)]
    dims = np.array([sum(map(abs, o)) for o in cells])
    facet = np.array([[dims[i] == dims[j] + 1 and all(b in (0, a) for a, b in zip(o, p)) for j, p in enumerate(cells)] for i, o in enumerate(cells)])
    return cells, dims, facet


def pair_stars(rank: np.ndarray, own: np.ndarray, classes: np.ndarray | None = None, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(in_star, partner, critical) for each vertex of ``own`` (index triples) and each star cell.

    ``classes`` has a number for each star cell and, last, the vertex: a cell then only pairs with a cell of its own class.
    ``chosen`` has the edge that each vertex takes, -1 for none, instead of the steepest one.

    ``rank`` is the order of the padded block's samples; missing samples have the largest rank, so cells with one are in no star.
    ``partner`` is a cell number, -1 for the vertex itself, -2 where there is none.
    """
    flat = tuple(n == 1 for n in rank.shape)
    cells, dims, facet = _stencil(flat)
    n, m = len(own), len(cells)
    at = rank[tuple(own.T)]
    low, inside = np.empty((n, m), np.int64), np.empty((n, m), bool)
    near = {}
    for o in product(*[(0,) if f else (-1, 0, 1) for f in flat]):
        near[o] = rank[tuple(own[:, a] + o[a] for a in range(3))]
    for c, o in enumerate(cells):
        corners = [near[p] for p in product(*[(0, d) if d else (0,) for d in o]) if any(p)]
        low[:, c] = np.minimum.reduce(corners)
        inside[:, c] = np.maximum.reduce(corners) < at
    far = np.iinfo(np.int64).max
    order = np.where(inside, low, far)
    partner = np.full((n, m), -2)
    critical = np.zeros((n, m), bool)
    done = ~inside
    edges = np.broadcast_to(dims == 1, (n, m))
    if classes is not None:
        edges = edges & (classes[:, :m] == classes[:, m:])
    first = np.argmin(np.where(edges, order, far), axis=1)
    has = inside[np.arange(n), first] & edges[np.arange(n), first]
    if chosen is not None:
        first, has = np.maximum(chosen, 0), chosen >= 0
    partner[has.nonzero()[0], first[has]] = -1
    done[has.nonzero()[0], first[has]] = True
    minimum = ~has
    live = np.arange(n)
    while len(live):
        open_ = ~done[live]
        left = open_.any(1)
        live = live[left]
        if not len(live):
            break
        open_ = open_[left]
        if classes is None:
            unpaired = open_.astype(np.int16) @ facet.T.astype(np.int16)
        else:
            alike = classes[live][:, :m, None] == classes[live][:, None, :m]
            unpaired = (alike & facet[None] & open_[:, None, :]).sum(2)
        ready = open_ & (unpaired == 1) & (dims > 1)[None, :]
        key = np.where(ready, order[live], far)
        pick = np.argmin(key, axis=1)
        some = ready[np.arange(len(live)), pick]
        rows, cell = live[some], pick[some]
        mates = facet[cell] & ~done[rows]
        if classes is not None:
            mates &= classes[rows, :m] == classes[rows, cell][:, None]
        mate = np.argmax(mates, axis=1)
        partner[rows, cell], partner[rows, mate] = mate, cell
        done[rows, cell] = done[rows, mate] = True
        # nothing to pair: the lowest cell of the lowest dimension left is critical
        rest = ~some
        rows = live[rest]
        if len(rows):
            level = np.where(open_[rest], dims[None, :], 99)
            lowest = level == level.min(1)[:, None]
            cell = np.argmin(np.where(lowest, order[rows], far), axis=1)
            critical[rows, cell] = True
            done[rows, cell] = True
    return inside, partner, np.concatenate([critical, minimum[:, None]], axis=1)


#: the ring around a vertex of a plane: an edge, then the quad after it, and that quad's place among ties
RING = (((1, 0), (1, 1), 7), ((0, 1), (-1, 1), 2), ((-1, 0), (-1, -1), 0), ((0, -1), (1, -1), 5))


def pair_plane(rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(edge_in, quad_in, root, ahead, steep, spare) of the ring of every inner sample of a padded plane of ranks.

    A run of the ring's cells in the star is paired outwards from its lowest edge, its ``root``: another edge goes with the quad ``ahead`` of it
    on the ring or the one before, whichever is towards the root.  Where the whole ring is in the star, the quad with the largest lowest
    vertex is left over (``spare``).  The vertex goes with the edge ``steep``, -1 where there is none.  The result is that of ``pair_stars``.
    """
    w, h = rank.shape[0] - 2, rank.shape[1] - 2
    if rank.size < 1 << 27:  # ranks times 8 fit into 32 bits
        rank = np.minimum(rank, np.iinfo(np.int32).max).astype(np.int32)
    near = lambda o: rank[1 + o[0]:1 + o[0] + w, 1 + o[1]:1 + o[1] + h]
    at, far = near((0, 0)), np.iinfo(rank.dtype).max
    edges = np.stack([near(e) for e, _, _ in RING])
    corner = np.stack([near(q) for _, q, _ in RING])
    after = np.roll(edges, -1, 0)
    edge_in, quad_in = edges < at, np.maximum(np.maximum(edges, after), corner) < at
    lowest = np.where(quad_in, np.minimum(np.minimum(edges, after), corner) * 8 + np.array([n for _, _, n in RING], rank.dtype)[:, None, None], -1)
    spare = quad_in.all(0) & (lowest == lowest.max(0))
    link = quad_in & ~spare
    edges = np.where(edge_in, edges, far)
    least = edges
    for _ in range(3):
        least = np.minimum(least, np.minimum(np.where(link, np.roll(least, -1, 0), far), np.roll(np.where(link, least, far), 1, 0)))
    root = edge_in & (least == edges)
    ahead = np.zeros_like(root)
    for _ in range(3):
        ahead = link & np.roll(root | ahead, -1, 0)
    ahead &= ~root
    return edge_in, quad_in, root, ahead, np.where(edge_in.any(0), edges.argmin(0), -1), spare


def _plane_cells(rank: np.ndarray, ids: np.ndarray, x0: int, y0: int, meta: GridMeta) -> pa.Table:
    """The cells of the inner samples of a padded block (x, y) whose first inner sample is at (x0, y0)."""
    edge_in, quad_in, root, ahead, steep, spare = pair_plane(rank)
    owner = ids[1:-1, 1:-1]
    mx, my = meta.mesh[:2]
    x, y = 2 * (np.arange(owner.shape[0]) + x0)[:, None], 2 * (np.arange(owner.shape[1]) + y0)[None, :]
    name = lambda o: np.mod(x + o[0], mx) + mx * np.mod(y + o[1], my)
    vertex, edge, quad = name((0, 0)), [name(e) for e, _, _ in RING], [name(q) for _, q, _ in RING]
    parts: list[tuple[np.ndarray, ...]] = []

    def emit(where: np.ndarray, dim: int, cid: np.ndarray, pair: np.ndarray, critical: np.ndarray) -> None:
        parts.append((cid[where], np.full(int(where.sum()), dim, np.int32), pair[where], critical[where], owner[where]))

    here = owner >= 0
    emit(here, 0, vertex, np.choose(steep + 1, [vertex, *edge]), steep < 0)
    for k in range(4):
        own = root[k] & (steep != k)
        emit(here & edge_in[k], 1, edge[k], np.where(steep == k, vertex, np.where(own, edge[k], np.where(ahead[k], quad[k], quad[k - 1]))), own)
        emit(here & quad_in[k], 2, quad[k], np.where(spare[k], quad[k], np.where(ahead[k], edge[k], edge[(k + 1) % 4])), spare[k])
    return pa.table({f: np.concatenate(c) for f, c in zip(("cid", "dim", "pair_cid", "is_critical", "owner"), zip(*parts))})


def _tiles(meta: GridMeta, tile: int) -> tuple[int, list[int]]:
    """The side of a tile and the number of tiles along each axis."""
    tile = max(2, min(tile, 64) if meta.nz > 1 else tile)
    return tile, [max(1, -(-n // tile)) for n in meta.shape]


def _dealt(field: DataFrame, meta: GridMeta, tile: int, spans: list[int]) -> DataFrame:
    """(vid, value, tile): every sample in its tile and in those whose halo it is in."""
    # along an axis a sample belongs to the tile before it and the one after it, nearly always the same one
    out, own = field.select("vid", F.col("value").cast("double").alias("value")), F.lit(0)
    for a, (c, n, p, k) in enumerate(zip(G.coordinates(F.col("vid"), meta.shape), meta.shape, meta.periodic, spans)):
        if k == 1:
            continue
        low, at, high = (F.floor((F.pmod(c + d, F.lit(n)) if p else G.clamped(c + d, n)) / tile) for d in (-1, 0, 1))
        # only a closed axis can have a last tile one sample wide between two others
        homes = F.array_distinct(F.array(low, at, high)) if p and n % tile == 1 else F.when(low == high, F.array(low)).otherwise(F.array(low, high))
        out = out.select("*", F.explode(homes).alias(f"_{a}"))
        own = own + int(np.prod(spans[:a])) * F.col(f"_{a}")
    return out.select("vid", "value", own.cast("long").alias("tile"))


def _block(pdf: pa.Table, number: int, meta: GridMeta, tile: int, spans: list[int]) -> tuple[np.ndarray, np.ndarray, list[int], list[int], list[int]]:
    """(ranks, vertex ids, first sample, samples, padding) of a tile's padded block; missing samples have the largest rank and id -1."""
    corner = [number % spans[0] * tile, number // spans[0] % spans[1] * tile, number // (spans[0] * spans[1]) * tile]
    size = [min(tile, n - c) for n, c in zip(meta.shape, corner)]
    vid, value = pdf["vid"].to_numpy(), pdf["value"].to_numpy()
    c = np.stack([vid % meta.nx, vid // meta.nx % meta.ny, vid // (meta.nx * meta.ny)], 1)
    place = np.lexsort((vid, value))
    rank = np.empty(len(vid), np.int64)
    rank[place] = np.arange(len(vid))
    pad = [1 if n > 1 else 0 for n in meta.shape]
    block = np.full([s + 2 * p for s, p in zip(size, pad)], np.iinfo(np.int64).max)
    ids = np.full(block.shape, -1)
    for shift in product(*[(0, n, -n) if p else (0,) for n, p in zip(meta.shape, meta.periodic)]):
        local = c + np.array(shift) - np.array(corner) + np.array(pad)
        fits = ((local >= 0) & (local < np.array(block.shape))).all(1)
        block[tuple(local[fits].T)], ids[tuple(local[fits].T)] = rank[fits], vid[fits]
    return block, ids, corner, size, pad


def _star_cells(block: np.ndarray, ids: np.ndarray, corner: list[int], size: list[int], pad: list[int], meta: GridMeta, labels: tuple[np.ndarray, np.ndarray] | None = None, to: dict[int, int] | None = None) -> pa.Table:
    """The cells of the inner samples of a block, by their stars; ``labels`` has cell ids in order and their classes (-1 for others), ``to`` the neighbour
    whose edge a vertex takes."""
    own = np.argwhere(ids >= 0)
    own = own[((own >= np.array(pad)) & (own < np.array(pad) + np.array(size))).all(1)]
    if not len(own):
        return pa.Table.from_batches([], OUT)
    cells, dims, _ = _stencil(tuple(n == 1 for n in block.shape))
    mesh = meta.mesh
    base = 2 * (own - np.array(pad) + np.array(corner))
    names = np.stack([sum(np.mod(base[:, a] + o[a], mesh[a]) * int(np.prod(mesh[:a])) for a in range(3)) for o in [*cells, (0, 0, 0)]], 1)
    classes = None
    if labels is not None:
        at = np.searchsorted(labels[0], names).clip(0, max(0, len(labels[0]) - 1))
        classes = np.where(labels[0][at] == names, labels[1][at], -1) if len(labels[0]) else np.full(names.shape, -1)
    chosen = None
    if to is not None:
        goal = np.array([to.get(v, -1) for v in ids[tuple(own.T)].tolist()])
        chosen = np.full(len(own), -1)
        for c, o in enumerate(cells):
            if dims[c] == 1:
                chosen[(goal >= 0) & (ids[tuple((own + np.array(o)).T)] == goal)] = c
    inside, partner, critical = pair_stars(block, own, classes, chosen)
    m, owner = len(cells), ids[tuple(own.T)]
    rows, cell = inside.nonzero()
    mate = partner[rows, cell]
    star = pd.DataFrame({"cid": names[rows, cell], "dim": dims[cell], "pair_cid": np.where(mate == -2, names[rows, cell], names[rows, np.where(mate < 0, m, mate)]), "is_critical": critical[rows, cell], "owner": owner[rows]})
    steep = np.where((partner == -1).any(1), np.argmax(partner == -1, axis=1), m)
    vertex = pd.DataFrame({"cid": names[:, m], "dim": 0, "pair_cid": names[np.arange(len(own)), steep], "is_critical": critical[:, m], "owner": owner})
    return pa.Table.from_pandas(pd.concat([vertex, star], ignore_index=True), OUT, preserve_index=False)


def discrete_gradient(field: DataFrame, meta: GridMeta, tile: int = TILE) -> DataFrame:
    """(cid, dim, pair_cid, is_critical, owner) of every cell whose vertices all have a sample.

    ``owner`` is the highest vertex of the cell.  A vertex pairs with its steepest edge; then, again and again, the cell with the
    lowest lowest-vertex among those with one unpaired facet pairs with it; else the lowest cell left is critical.
    """
    tile, spans = _tiles(meta, tile)
    planar = meta.nx > 1 and meta.ny > 1 and meta.nz == 1

    def run(key: tuple, pdf: pa.Table) -> pa.Table:
        if not len(pdf):
            return pa.Table.from_batches([], OUT)
        block, ids, corner, size, pad = _block(pdf, key[0].as_py(), meta, tile, spans)
        if planar:
            return _plane_cells(block[:, :, 0], ids[:, :, 0], corner[0], corner[1], meta)
        return _star_cells(block, ids, corner, size, pad, meta)

    return _dealt(field, meta, tile, spans).groupBy("tile").applyInArrow(run, SCHEMA)


def classed_gradient(field: DataFrame, classes: DataFrame, meta: GridMeta, tile: int = TILE) -> DataFrame:
    """``discrete_gradient`` with every lower star split by the class of its cells: no pair joins two classes.

    ``classes`` (cid, label) has a number for each cell; cells without one are a class of their own.  A class without the vertex begins
    with a critical cell.  Labels go to the tiles of the vertices around their cell.
    """
    tile, spans = _tiles(meta, tile)
    at = G.coordinates(F.col("cid"), meta.mesh)
    homes = []
    for pick in product(*[(0, 1) if n > 1 else (0,) for n in meta.shape]):
        near = [F.floor(G.wrapped(F.floor((c + d) / 2), n, p) / tile) for c, d, n, p in zip(at, pick, meta.shape, meta.periodic)]
        homes.append(near[0] + spans[0] * (near[1] + spans[1] * near[2]))
    told = classes.select("cid", F.col("label").cast("long").alias("label"), F.explode(F.array_distinct(F.array(*homes))).alias("tile"))

    def run(key: tuple, pdf: pa.Table, named: pa.Table) -> pa.Table:
        if not len(pdf):
            return pa.Table.from_batches([], OUT)
        block, ids, corner, size, pad = _block(pdf, key[0].as_py(), meta, tile, spans)
        cid, label = named["cid"].to_numpy(), named["label"].to_numpy()
        order = np.argsort(cid)
        return _star_cells(block, ids, corner, size, pad, meta, (cid[order], label[order]))

    return _dealt(field, meta, tile, spans).groupBy("tile").cogroup(told.groupBy("tile")).applyInArrow(run, SCHEMA)


def destinations(field: DataFrame, meta: GridMeta) -> tuple[DataFrame, DataFrame]:
    """(shares, steps): the shares (vid, dest, share) with which each sample flows to the minima, and the neighbour (vid, next) that fits them best.

    A minimum flows to itself.  Any other sample mixes the shares of its lower neighbours by their drops (evenly where all drops are 0), and
    steps to the neighbour whose shares have the largest dot product with the mix, equal ones (to nine digits) by the order of the field.
    Samples go in waves, each as soon as all its lower neighbours are done, so there are as many waves as the longest way down has steps.
    """
    near = G.neighbours(field, meta).where(G.order_of("nvalue", "nvid") < G.order_of())
    down = cut_in_loop(near.select("vid", "nvid", "nvalue", (F.col("value") - F.col("nvalue")).cast("double").alias("drop")))
    total = down.groupBy("vid").agg(F.sum("drop").alias("_sum"), F.count("*").alias("left"))
    down = cut_in_loop(down.join(total, "vid").select("vid", "nvid", "nvalue", F.when(F.col("_sum") > 0, F.col("drop") / F.col("_sum")).otherwise(1 / F.col("left")).alias("weight")))
    waiting = cut_in_loop(total.select("vid", "left"))
    shares = front = cut_in_loop(field.select("vid").join(total, "vid", "left_anti").select("vid", F.col("vid").alias("dest"), F.lit(1.0).alias("share")))
    steps = field.sparkSession.createDataFrame([], "vid long, next long")
    while not front.isEmpty():
        done = down.join(front.select(F.col("vid").alias("nvid")).distinct(), "nvid").groupBy("vid").agg(F.count("*").alias("_n"))
        waiting = cut_in_loop(waiting.join(done, "vid", "left").select("vid", (F.col("left") - F.coalesce("_n", F.lit(0))).alias("left")))
        ready = waiting.where("left = 0").select("vid")
        given = cut_in_loop(down.join(ready, "vid").join(shares.select(F.col("vid").alias("nvid"), "dest", "share"), "nvid"))
        front = cut_in_loop(given.groupBy("vid", "dest").agg(F.sum(F.col("weight") * F.col("share")).alias("share")))
        fits = given.join(front.withColumnRenamed("share", "_mix"), ["vid", "dest"]).groupBy("vid", "nvid", "nvalue").agg(F.round(F.sum(F.col("share") * F.col("_mix")), 9).alias("fit"))
        best = fits.groupBy("vid").agg(F.min(F.struct((-F.col("fit")).alias("f"), "nvalue", "nvid"))["nvid"].alias("next"))
        steps, shares = steps.union(cut_in_loop(best)), shares.union(front)
        waiting = waiting.where("left > 0")
    return shares, steps


def convergent_gradient(field: DataFrame, meta: GridMeta, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(gradient, shares): each vertex goes with the edge to the neighbour that ``destinations`` chooses; the rest of its star is paired as ever."""
    field = cut_in_loop(field.select("vid", "value"))
    shares, steps = destinations(field, meta)
    tile, spans = _tiles(meta, tile)
    sent = _dealt(field, meta, tile, spans).join(cut_in_loop(steps), "vid", "left")

    def run(key: tuple, pdf: pa.Table) -> pa.Table:
        if not len(pdf):
            return pa.Table.from_batches([], OUT)
        to = {v: n for v, n in zip(pdf["vid"].to_pylist(), pdf["next"].to_pylist()) if n is not None}
        return _star_cells(*_block(pdf, key[0].as_py(), meta, tile, spans), meta, to=to)

    return sent.groupBy("tile").applyInArrow(run, SCHEMA), shares


def by_labels(field: DataFrame, labels: DataFrame, meta: GridMeta, tile: int = TILE) -> DataFrame:
    """The gradient that respects a labelling of the cells (cid, label): classes are labels and boundary classes together."""
    bnd = G.boundary_of(G.coordinates(F.col("cid"), meta.mesh), meta, meta.mesh)
    return classed_gradient(field, labels.select("cid", (F.col("label") * 4 + bnd).alias("label")), meta, tile)


def by_second_field(field: DataFrame, other: DataFrame, meta: GridMeta, tile: int = TILE) -> DataFrame:
    """The gradient of a pair of fields: only cells with the same highest vertex in both fields pair."""
    cells = G.cells(field.sparkSession, meta).select("cid")
    return classed_gradient(field, G.cell_extremes(cells, other, meta).select("cid", F.col("vmax").alias("label")), meta, tile)


def ascending_dimensions(grad: DataFrame, meta: GridMeta) -> DataFrame:
    """(cid, asc_dim): the smallest dimension of an ascending manifold that each cell lies in.

    Marks go up from the critical cells of each dimension k, from a cell to its cofacets and on to the cells that these are paired with, and
    say top - k.  Maxima have 0, cells without a mark the full dimension.  All critical cells of a dimension go up together, a step a round.
    """
    top, out = len(meta.axes), None
    for k in range(1, top):
        gates = grad.where((F.col("dim") == k + 1) & ~F.col("is_critical")).select(F.col("cid").alias("gate"), F.col("pair_cid").alias("next"))
        seen = front = cut_in_loop(grad.where(F.col("is_critical") & (F.col("dim") == k)).select("cid", F.lit(True).alias("tip")))
        while not front.isEmpty():
            met = G.cofacets(front.where("tip").select("cid"), meta, "cid", "gate").join(gates, "gate").where("next != cid")
            reached = met.select(F.explode(F.array(F.struct(F.col("gate").alias("cid"), F.lit(False).alias("tip")), F.struct(F.col("next").alias("cid"), F.lit(True).alias("tip")))).alias("r")).select("r.*")
            front = cut_in_loop(reached.groupBy("cid").agg(F.max("tip").alias("tip")).join(seen, ["cid", "tip"], "left_anti"))
            seen = cut_in_loop(seen.union(front))
        part = seen.select("cid", F.lit(top - k).alias("asc_dim"))
        out = part if out is None else out.union(part)
    peaks = grad.where(F.col("is_critical") & (F.col("dim") == top)).select("cid", F.lit(0).alias("asc_dim"))
    marks = (peaks if out is None else out.union(peaks)).groupBy("cid").agg(F.min("asc_dim").alias("asc_dim"))
    return grad.select("cid").join(marks, "cid", "left").fillna(top, ["asc_dim"])


def violations(grad: DataFrame) -> DataFrame:
    """Cells whose partner does not point back, or whose dimensions do not differ by one; critical cells point to themselves."""
    other = grad.select(F.col("cid").alias("pair_cid"), F.col("pair_cid").alias("back"), F.col("dim").alias("other_dim"))
    met = grad.join(other, "pair_cid", "left")
    good = F.when(F.col("is_critical"), F.col("pair_cid") == F.col("cid")).otherwise((F.col("back") == F.col("cid")) & (F.abs(F.col("dim") - F.col("other_dim")) == 1))
    return met.where(~F.coalesce(good, F.lit(False)))


def critical_counts(grad: DataFrame, meta: GridMeta) -> DataFrame:
    """(dim, bnd, n) of critical cells."""
    bnd = G.boundary_of(G.coordinates(F.col("cid"), meta.mesh), meta, meta.mesh)
    return grad.where("is_critical").groupBy("dim", bnd.alias("bnd")).agg(F.count("*").alias("n"))


def restricted(field: DataFrame, mask: DataFrame, meta: GridMeta, tile: int = TILE) -> DataFrame:
    """Gradient over the cells whose vertices are all in ``mask`` (vid)."""
    return discrete_gradient(field.join(mask.select("vid"), "vid", "left_semi"), meta, tile)

