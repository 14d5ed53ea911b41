"""Queries of single grid, field, line, mesh and file operators, and of the simplified complex written out, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoweave.functions import calculus as C
from isoweave.functions import grid as G
from isoweave.operators import complex as M
from isoweave.operators import gradient as D
from isoweave.operators import hierarchy as H
from isoweave.operators import iterate, lines, merged, meshes, regions
from isoweave.plans import complex_sql as S
from isoweave.plans.registry import HIER, LQ, NEAR, PEAKS, PL, _cancel, _gradient, _hierarchy, _kernel_sql, _lines, query
from isoweave.runtime import checkpoint_root, cut
from isoweave.sources import raster


def _folder(spark: SparkSession) -> str:
    """A new name in the shared folder."""
    return f"{checkpoint_root(spark)}/table-{uuid.uuid4().hex}"


#: the field of events, by period and user group, whose user axis is closed: (vid, x, y, v)
EV = """rawe as (select date_diff('second', timestamp '2024-01-01', ts) // 21600 as x, user_id % 30 as y, cast(sum(cast(round(value * 100) as bigint)) as bigint) as v from events group by 1, 2),
ev as (select g as vid, g % 120 as x, g // 120 as y, coalesce(v, 0) as v from range(3600) t(g) left join rawe on rawe.x = g % 120 and rawe.y = g // 120)"""
RING = G.GridMeta(120, 30, periodic=(False, True, False))


@query("g1_coordinates", "select g as vid, g % 24 as x, g // 24 % 10 as y, g // 240 as z, (23 - g % 24) + 24 * (9 - g // 24 % 10) + 240 * (10 - g // 240) as opposite from range(2640) t(g)")
def g1_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates of the volume's samples, and the index of the sample on the other side of its centre."""
    at = raster.lineitem_volume(spark, d).select("vid", *[c.alias(n) for c, n in zip(G.coordinates(F.col("vid"), raster.LQD.shape), G.NAMES)])
    return at.withColumn("opposite", G.index(raster.LQD.shape, *[n - 1 - F.col(c) for c, n in zip(G.NAMES, raster.LQD.shape)]))


@query("t3_raster_events", f"with {EV} select vid, x, y, v as value from ev")
def t3_raster_events(spark: SparkSession, d: str) -> DataFrame:
    return raster.event_field(spark, d).select("vid", "x", "y", "value")


@query("g2_periodic_neighbours", f"""with {EV} select a.vid, count(*) as n, cast(sum(b.v) as bigint) as total, min(b.vid) as first from ev a
    join ev b on (abs(a.x - b.x) = 1 and a.y = b.y) or (a.x = b.x and abs(a.y - b.y) in (1, 29)) group by a.vid""")
def g2_periodic(spark: SparkSession, d: str) -> DataFrame:
    near = G.neighbours(raster.event_field(spark, d), RING)
    return near.groupBy("vid").agg(F.count("*").alias("n"), F.sum("nvalue").alias("total"), F.min("nvid").alias("first"))


#: points off the samples: (pid, px, py), and the samples around each with their weights: (pid, vid, w)
CORNERS = """pt as (select vid as pid, x, y from lq where x < 45 and y < 49),
corner as (select pid, lq.vid, (case when lq.x = pt.x then 0.75::double else 0.25::double end) * 0.5::double as w from pt join lq on lq.x in (pt.x, pt.x + 1) and lq.y in (pt.y, pt.y + 1))"""


def _points(field: DataFrame) -> DataFrame:
    inner = field.where("x < 45 and y < 49")
    return inner.select(F.col("vid").alias("pid"), (F.col("x") + 0.25).alias("px"), (F.col("y") + 0.5).alias("py"), F.lit(0.0).alias("pz"))


@query("g7_corners", f"with {LQ}, {CORNERS} select pid, vid, w as weight from corner")
def g7_corners(spark: SparkSession, d: str) -> DataFrame:
    return G.corners(_points(raster.lineitem_field(spark, d)), raster.LQ).select("pid", "vid", "weight")


@query("g17_earlier", f"with {LQ}, {NEAR} select vid, count(*) filter (nv < v or (nv = v and nvid < vid)) as below, count(*) filter (nv > v or (nv = v and nvid > vid)) as above from near group by vid")
def g17_earlier(spark: SparkSession, d: str) -> DataFrame:
    """How many neighbours of each sample come before and after it in the total order."""
    near = G.neighbours(raster.lineitem_field(spark, d), raster.LQ)
    own, other = G.order_of(), G.order_of("nvalue", "nvid")
    return near.groupBy("vid").agg(F.count_if(other < own).alias("below"), F.count_if(other > own).alias("above"))


@query("g18_negated", f"with {LQ}, {NEAR} select vid, any_value(-v) as value from near group by vid having count(*) filter (-nv < -v or (nv = v and nvid < vid)) = 0")
def g18_negated(spark: SparkSession, d: str) -> DataFrame:
    """Minima of the negated field."""
    return regions.extrema(C.negate(raster.lineitem_field(spark, d)), raster.LQ).where("is_min").select("vid", "value")


@query("g20_band", f"with {LQ} select vid, v as value from lq where v > (select max(v) // 4 from lq) and v <= (select max(v) // 2 from lq)")
def g20_band(spark: SparkSession, d: str) -> DataFrame:
    field = cut(raster.lineitem_field(spark, d))
    most = field.agg(F.max("value")).first()[0]  # one number
    return C.threshold(field, most // 4, most // 2).select("vid", "value")


SLOPES = """w as (select *, lag(v) over (partition by y order by x) as l, lead(v) over (partition by y order by x) as r, lag(v) over (partition by x order by y) as b, lead(v) over (partition by x order by y) as t from lq),
slope as (select vid, case when l is null then cast(r - v as double) when r is null then cast(v - l as double) else (r - l) / 2.0 end as dx, case when b is null then cast(t - v as double) when t is null then cast(v - b as double) else (t - b) / 2.0 end as dy from w)"""


@query("f3_point_gradient", f"with {LQ}, {CORNERS}, {SLOPES} select pid, round(sum(w * dx), 2) as dx, round(sum(w * dy), 2) as dy from corner join slope using (vid) group by pid")
def f3_point_gradient(spark: SparkSession, d: str) -> DataFrame:
    field = cut(raster.lineitem_field(spark, d))
    found = C.interpolate(_points(field), C.gradient(field, raster.LQ), raster.LQ, names=("dx", "dy"))
    return found.select("pid", F.round("dx", 2).alias("dx"), F.round("dy", 2).alias("dy"))


@query("f7_fields_at_peaks", f"""with recursive {PEAKS}, lap as ({_kernel_sql([(0, 0, -4), (1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1)]).replace(f'with {LQ}, k(', 'with k(')})
    select vid, lq.v as revenue, lap.value as bend from ptr join lq using (vid) join lap using (vid) where next = vid""")
def f7_fields_at_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Two fields at every peak."""
    field = cut(raster.lineitem_field(spark, d))
    peaks = regions.extrema(field, raster.LQ).where("is_max").select("vid")
    return C.sample(peaks, {"revenue": field, "bend": C.convolve(field, raster.LQ, C.kernel("laplacian"))})


@query("t2_from_rows", f"with {LQ} select vid, x, y, v as value from lq")
def t2_from_rows(spark: SparkSession, d: str) -> DataFrame:
    """The field from arrays, one for each grid row."""
    field = raster.lineitem_field(spark, d)
    rows = field.groupBy(F.col("y").alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "value"))), lambda s: s["value"]).alias("values"))
    return raster.from_rows(rows, raster.LQ).select("vid", "x", "y", "value")


@query("t4_masked", f"with {LQ}, {NEAR} select vid, v as value from lq where vid in (select vid from near group by vid having max(nv) < 2 * any_value(v))")
def t4_masked(spark: SparkSession, d: str) -> DataFrame:
    """Samples of a sparse field: those over half of each of their neighbours."""
    field = cut(raster.lineitem_field(spark, d))
    mask = G.neighbours(field, raster.LQ).groupBy("vid", "value").agg(F.max("nvalue").alias("most")).where("most < 2 * value")
    return raster.masked(field, mask).select("vid", "value")


@query("t5_tiles", f"with {LQ} select x // 16 + 3 * (y // 16) as tile, count(*) as n, cast(sum(v) as bigint) as total from lq where x >= 16 group by 1")
def t5_tiles(spark: SparkSession, d: str) -> DataFrame:
    """A field written in folders by tile and read back, without the first column of tiles."""
    path = _folder(spark)
    raster.write_table(raster.lineitem_field(spark, d), path, (F.floor(F.col("x") / 16) + 3 * F.floor(F.col("y") / 16)).cast("int"))
    held = raster.read_table(spark, path).where("tile % 3 > 0")
    return held.groupBy(F.col("tile").cast("long").alias("tile")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("t6_gradient_table", f"with recursive {LQ}, {S.GRAD} select cid, dim, pair_cid, is_critical, owner from grad where dim = 1")
def t6_gradient_table(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a gradient that was written as a table and read back."""
    path = _folder(spark)
    raster.write_table(D.discrete_gradient(raster.lineitem_field(spark, d), raster.LQ), path)
    return raster.read_table(spark, path).where("dim = 1").select("cid", "dim", "pair_cid", "is_critical", "owner")


@query("t14_metrics_csv", f"""with {PL}, s as (select *, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) as step from pl window w as (partition by line_id order by pos))
    select line_id, round(coalesce(sum(step), 0), 4) as length, round(avg(x), 4) as mean_x, round(avg(y), 4) as mean_y from s group by line_id""")
def t14_metrics_csv(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of polylines, written as CSV and read back."""
    path, names = _folder(spark), ("length", "mean_x", "mean_y")
    raster.write_csv(lines.metrics(_lines(spark, d)).select("line_id", *[F.round(n, 4).alias(n) for n in names]), path)
    return raster.read_csv(spark, path, "line_id long, length double, mean_x double, mean_y double")


@query("t9_skeleton", f"""{HIER}, {S.LINES}, {S.MERGED_LINES}, node as (select nid, row_number() over (order by nid) - 1 as node from nodes where nid not in (select lower from gone union all select upper from gone)),
    arc as (select lower, upper, number, row_number() over (order by lower, upper, number) - 1 as arc from (select distinct lower, upper, number from merged))
    select arc, p.node as lower, q.node as upper, cast(number as bigint) as number, pos, cid from merged join arc using (lower, upper, number) join node p on p.nid = lower join node q on q.nid = upper""")
def t9_skeleton(spark: SparkSession, d: str) -> DataFrame:
    """Living nodes, arcs and geometry, written as three tables and read back."""
    grad, nodes, found = _hierarchy(spark, d)
    walks = cut(merged.merged_lines(cut(merged.base_lines(grad, raster.LQ)), found, found.live))
    path = _folder(spark)
    raster.write_skeleton(*merged.skeleton(H.living_nodes(nodes, found.gone), walks), path)
    _, arcs, geometry = raster.read_skeleton(spark, path)
    return arcs.join(geometry, "arc").select("arc", "lower", "upper", F.col("number").cast("long").alias("number"), "pos", "cid")


@query("m25_selected", f"{HIER} select nid, dim, value from nodes where dim in (0, 2) and nid not in (select lower from gone union all select upper from gone)")
def m25_selected(spark: SparkSession, d: str) -> DataFrame:
    """Living extrema."""
    _, nodes, found = _hierarchy(spark, d)
    return H.living_nodes(nodes, found.gone).where("dim in (0, 2)").select("nid", "dim", "value")


@query("m16_living_incident", f"{HIER} select n.nid, a.lower, a.upper, a.dim, a.mult from alive a join nodes n on n.nid in (a.lower, a.upper) where n.dim = 1")
def m16_living_incident(spark: SparkSession, d: str) -> DataFrame:
    """Living arcs at each saddle."""
    _, nodes, found = _hierarchy(spark, d)
    return M.incident(found.live.select("lower", "upper", "dim", "mult"), nodes.where("dim = 1"))


@query("m10_frozen", f"with recursive {LQ}, {S.COMPLEX}, {S.hierarchy(frozen='select nid from nodes where x < 12')} select * from gone")
def m10_frozen(spark: SparkSession, d: str) -> DataFrame:
    """The hierarchy with the nodes of the first quarter of the grid kept."""
    field, grad = _gradient(spark, d)
    nodes, arcs = cut(M.nodes(grad, field, raster.LQ)), cut(M.arcs(grad, field, raster.LQ))
    return H.hierarchy(arcs, nodes, _cancel(spark, d), frozen=nodes.where("x < 12").select("nid")).gone


@query("m10_unweighted", f"with recursive {LQ}, {S.COMPLEX}, {S.hierarchy(weighted=False)} select * from gone")
def m10_unweighted(spark: SparkSession, d: str) -> DataFrame:
    """The hierarchy in the order of persistence alone."""
    field, grad = _gradient(spark, d)
    nodes, arcs = cut(M.nodes(grad, field, raster.LQ)), cut(M.arcs(grad, field, raster.LQ))
    return H.hierarchy(arcs, nodes, _cancel(spark, d), weighted=False).gone


#: pieces of samples in one of eight bands of value, each with its highest sample: (piece, label, top, topv)
BANDS = f"""{LQ}, {NEAR}, band as (select vid, v, least(v * 8 // (select max(v) from lq), 7) as label from lq),
same as (select n.vid, n.nvid from near n join band a on a.vid = n.vid join band b on b.vid = n.nvid where a.label = b.label),
reach(vid, low) as (select vid, vid from band union select r.vid, s.nvid from reach r join same s on s.vid = r.low),
piece_of as (select vid, min(low) as piece from reach group by vid),
tops as (select piece, label, max(struct_pack(v := v, i := vid)) as t from piece_of join band using (vid) group by piece, label),
up as (select o.piece, arg_max(p.piece, struct_pack(v := n.nv, i := n.nvid)) as next from tops o join near n on n.vid = o.t.i join piece_of p on p.vid = n.nvid where struct_pack(v := n.nv, i := n.nvid) > o.t and p.piece <> o.piece group by o.piece),
hop(piece, root) as (select piece, piece from tops union select h.piece, u.next from hop h join up u on u.piece = h.root)"""


@query("r14_islands", f"with recursive {BANDS} select vid, o.label from piece_of join hop using (piece) join tops o on o.piece = hop.root where hop.root not in (select piece from up)")
def r14_islands(spark: SparkSession, d: str) -> DataFrame:
    """Bands of value, each piece of a band given to the higher band that its highest sample touches."""
    field = cut(raster.lineitem_field(spark, d))
    most = field.agg(F.max("value")).first()[0]  # one number
    bands = field.select("vid", F.least(F.floor(F.col("value") * 8 / most), F.lit(7)).cast("long").alias("label"))
    return regions.merge_islands(cut(bands), field, raster.LQ)


@query("r15_roots", f"with recursive {PEAKS} select w.vid as id, w.top as root from walk w join ptr p on p.vid = w.top and p.next = p.vid")
def r15_roots(spark: SparkSession, d: str) -> DataFrame:
    """Ends of a table of pointers."""
    to = regions.steepest(raster.lineitem_field(spark, d), raster.LQ)
    return iterate.terminal(to, "vid", "next").select("id", "root")


@query("l11_graph_difference", f"{HIER}, given as (select lower, upper from arcs), kept as (select lower, upper from alive) select *, 'left' as side from (from given except from kept) union all select *, 'right' from (from kept except from given)")
def l11_graph_difference(spark: SparkSession, d: str) -> DataFrame:
    """Arcs of the complex that simplification took away, and those that it made."""
    field, grad = _gradient(spark, d)
    nodes, arcs = cut(M.nodes(grad, field, raster.LQ)), cut(M.arcs(grad, field, raster.LQ))
    return lines.graph_difference(arcs.select("lower", "upper"), H.hierarchy(arcs, nodes, _cancel(spark, d)).live.select("lower", "upper"))


@query("l1_valleys", f"with recursive {LQ}, {S.COMPLEX} select * from arcs where dim = 0")
def l1_valleys(spark: SparkSession, d: str) -> DataFrame:
    field, grad = _gradient(spark, d)
    return M.valley_arcs(M.arcs(grad, field, raster.LQ))


@query("p8_plane_patches", f"""with {PL}, e as (select line_id, arg_min(x, pos) as x, arg_min(y, pos) as y, arg_max(x, pos) - arg_min(x, pos) as dx, arg_max(y, pos) - arg_min(y, pos) as dy from pl group by line_id),
    n as (select *, dx / sqrt(dx * dx + dy * dy) as nx, dy / sqrt(dx * dx + dy * dy) as ny from e where dx * dx + dy * dy > 0)
    select line_id as pid, i, j, round(x + (1 - i) * 2 * ny, 4) as px, round(y - (1 - i) * 2 * nx, 4) as py, round((1 - 2 * j) * 2.0::double, 4) as pz from n cross join (select cast(g as int) as i from range(3) t(g)) cross join (select cast(g as int) as j from range(2) t(g))""")
def p8_plane_patches(spark: SparkSession, d: str) -> DataFrame:
    """Grids of three by two points in the plane through each line's first point, upright on the way to its last."""
    ends = lines.ends(_lines(spark, d))
    normals = ends.select(F.col("line_id").alias("pid"), "a.x", "a.y", "a.z", (F.col("b.x") - F.col("a.x")).alias("nx"), (F.col("b.y") - F.col("a.y")).alias("ny"), F.lit(0.0).alias("nz"), F.lit(0.0).alias("ux"), F.lit(0.0).alias("uy"), F.lit(1.0).alias("uz"))
    return lines.plane_patch(normals, 3, 2, 2.0).select("pid", "i", "j", *[F.round(c, 4).alias(c) for c in ("px", "py", "pz")])


@query("p10_slice_records", f"""with {PL}, s as (select *, coalesce(sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2), 0) as step from pl window w as (partition by line_id order by pos)),
    a as (select *, sum(step) over (partition by line_id order by pos) as arc from s), l as (select line_id, arg_min(arc, struct_pack(y := y, pos := pos)) as anchor from a group by line_id),
    n as (select *, floor((arc - anchor) / 100.0) as slice from a join l using (line_id)), b as (select *, lag(slice) over (partition by line_id order by pos) as before from n),
    c as (select line_id, pos, x, y, abs(y) as area from b where before is null or before <> slice),
    v as (select *, lead(x) over w - x as ax, lead(y) over w - y as ay, x - lag(x) over w as bx, y - lag(y) over w as b_y from c window w as (partition by line_id order by pos)),
    g as (select *, sqrt(ax * ax + ay * ay) as chord, sqrt(ax * ax + ay * ay) * sqrt(bx * bx + b_y * b_y) as size from v)
    select line_id, pos, round(sqrt(area / pi()), 3) as radius, round(chord, 3) as chord, case when size > 0 then round(acos(greatest(least((ax * bx + ay * b_y) / size, 1), -1)), 3) end as angle from g""")
def p10_slice_records(spark: SparkSession, d: str) -> DataFrame:
    """Radius of a disc of the slice's area, and the way and turn to the next slice; the area is the size of the value there."""
    cuts = lines.slices(_lines(spark, d), 100.0).withColumn("area", F.abs("value"))
    found = lines.slice_records(cuts.select("line_id", "pos", "area", *G.NAMES, "arc"))
    return found.select("line_id", "pos", *[F.round(c, 3).alias(c) for c in ("radius", "chord", "angle")])


@query("p10_gyration", f"with {PL} select line_id, round(sqrt(var_pop(x) + var_pop(y)), 3) as gyration from pl group by line_id")
def p10_gyration(spark: SparkSession, d: str) -> DataFrame:
    return lines.radius_of_gyration(_lines(spark, d)).select("line_id", F.round("gyration", 3).alias("gyration"))


@query("p12_along_lines", f"""with {LQ}, {PL}, spot as (select line_id, pos, least(x / 16.0, 45) as px, pos % 49 + 0.5::double as py from pl),
    box as (select *, cast(least(floor(px), 44) as bigint) as x0, cast(floor(py) as bigint) as y0 from spot)
    select line_id, pos, round(sum((case when lq.x = x0 then 1 - (px - x0) else px - x0 end) * 0.5::double * lq.v), 1) as value from box join lq on lq.x in (x0, x0 + 1) and lq.y in (y0, y0 + 1) group by line_id, pos""")
def p12_along_lines(spark: SparkSession, d: str) -> DataFrame:
    """The field sampled along polylines."""
    points = _lines(spark, d).select(F.struct("line_id", "pos").alias("pid"), F.least(F.col("x") / 16, F.lit(45.0)).alias("px"), (F.col("pos") % 49 + 0.5).alias("py"), F.lit(0.0).alias("pz"))
    return C.interpolate(points, raster.lineitem_field(spark, d), raster.LQ).select("pid.line_id", "pid.pos", F.round("value", 1).alias("value"))


@query("i5_rasterised", f"""with {PL}, e as (select line_id, cast(floor(arg_min(x, pos)) as bigint) as x0, cast(floor(arg_min(y, pos)) as bigint) as y0, cast(floor(arg_max(x, pos)) as bigint) as x1, cast(floor(arg_max(y, pos)) as bigint) as y1 from pl group by line_id),
    n as (select *, greatest(abs(x1 - x0), abs(y1 - y0)) as n from e), p as (select *, unnest(range(n + 1)) as pos from n)
    select line_id as segment_id, pos, cast(floor(x0 + case when n = 0 then 0 else pos / n end * (x1 - x0) + 0.5) as bigint) as x, cast(floor(y0 + case when n = 0 then 0 else pos / n end * (y1 - y0) + 0.5) as bigint) as y from p""")
def i5_rasterised(spark: SparkSession, d: str) -> DataFrame:
    """Grid cells from the first to the last point of each polyline."""
    ends = lines.ends(_lines(spark, d))
    corner = [F.floor(F.col(f"{end}.{n}")).alias(f"{n}{k}") for k, end in ((0, "a"), (1, "b")) for n in "xy"]
    return lines.rasterised(ends.select(F.col("line_id").alias("segment_id"), *corner))


#: two triangles for each square of samples, where the first of them is over the mean: (tid, a, b, c)
TRIANGLES = """tri as (select * from (select vid * 2 as tid, vid as a, vid + 1 as b, vid + 46 as c, x, y, v from lq union all select vid * 2 + 1, vid + 1, vid + 46, vid + 47, x, y, v from lq) where x < 45 and y < 49 and v > (select avg(v) from lq)),
side as (select tid, a, b from tri union all select tid, b, c from tri union all select tid, a, c from tri),
edge as (select a, b, count(*) as n_triangles from side group by 1, 2)"""


def _mesh(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles)."""
    field = cut(raster.lineitem_field(spark, d))
    mean = field.agg(F.avg("value").alias("mean"))
    at = field.join(F.broadcast(mean), F.col("value") > F.col("mean")).where("x < 45 and y < 49")  # one row
    v = F.col("vid")
    pair = F.array(F.struct((v * 2).alias("tid"), v.alias("a"), (v + 1).alias("b"), (v + 46).alias("c")), F.struct((v * 2 + 1).alias("tid"), (v + 1).alias("a"), (v + 46).alias("b"), (v + 47).alias("c")))
    return field.select(v.alias("id"), "x", "y", "z", "value"), at.select(F.explode(pair).alias("t")).select("t.*")


@query("x1_mesh_edges", f"with {LQ}, {TRIANGLES} select a, b, n_triangles, n_triangles = 1 as is_boundary from edge")
def x1_mesh_edges(spark: SparkSession, d: str) -> DataFrame:
    return meshes.edges_of(_mesh(spark, d)[1])


@query("x1_mesh_centroids", f"with {LQ}, {TRIANGLES} select tid, round(avg(lq.x), 4) as x, round(avg(lq.y), 4) as y from tri join lq on lq.vid in (a, b, c) group by tid")
def x1_mesh_centroids(spark: SparkSession, d: str) -> DataFrame:
    vertices, triangles = _mesh(spark, d)
    return meshes.triangle_centroids(triangles, vertices).select("tid", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("x1_mesh_euler", f"with {LQ}, {TRIANGLES} select *, v - e + f as euler from (select (select count(distinct p) from (select a as p from edge union all select b from edge)) as v, (select count(*) from edge) as e, (select count(*) from tri) as f)")
def x1_mesh_euler(spark: SparkSession, d: str) -> DataFrame:
    return meshes.euler(_mesh(spark, d)[1])


@query("x2_mesh_functions", f"with {LQ} select vid as id, y * 2.0::double as along, round(x * cos(0.5) + y * sin(0.5), 6) as turned from lq")
def x2_mesh_functions(spark: SparkSession, d: str) -> DataFrame:
    vertices = _mesh(spark, d)[0]
    return vertices.select("id", meshes.along_axis("y", 2.0).alias("along"), F.round(meshes.rotated(0.5), 6).alias("turned"))


@query("x3_mesh_steepest", f"""with {LQ}, {TRIANGLES}, two as (select a as id, b as nid from edge union all select b, a from edge), best as (select id, max(struct_pack(v := v, i := nid)) as m from two join lq on lq.vid = nid group by id)
    select id, case when m > struct_pack(v := v, i := id) then m.i else id end as next from best join lq on lq.vid = id""")
def x3_mesh_steepest(spark: SparkSession, d: str) -> DataFrame:
    """Pointers to the highest neighbour on the mesh."""
    vertices, triangles = _mesh(spark, d)
    used = triangles.select(F.explode(F.array("a", "b", "c")).alias("id")).distinct()
    return meshes.steepest(triangles, vertices.join(used, "id").select("id", "value"))
