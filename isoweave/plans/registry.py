"""The queries of the field operators and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoweave.functions import calculus as C
from isoweave.functions import grid as G
from isoweave.operators import complex as M
from isoweave.operators import geometry as L
from isoweave.operators import gradient as D
from isoweave.operators import hierarchy as H
from isoweave.operators import advect, features, iterate, lines, merged, regions, surfaces
from isoweave.plans import complex_sql as S
from isoweave.runtime import cut, table
from isoweave.sources import raster

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: the revenue field of lineitem as SQL: (vid, x, y, v)
LQ = """
raw as (select date_diff('day', date '1992-01-01', cast(l_shipdate as date)) // 56 - 19 as x, cast(l_quantity as bigint) - 1 as y,
    cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as v from lineitem group by 1, 2),
lq as (select g as vid, g % 46 as x, g // 46 as y, coalesce(v, 0) as v from range(2300) t(g) left join raw on raw.x = g % 46 and raw.y = g // 46)
"""
#: face neighbours: (vid, v, nvid, nv)
NEAR = """
near as (select a.vid, a.v, b.vid as nvid, b.v as nv from lq a join lq b on (abs(a.x - b.x) = 1 and a.y = b.y) or (abs(a.y - b.y) = 1 and a.x = b.x))
"""
PEAKS = f"""
{LQ}, {NEAR},
best as (select vid, v, nvid, nv, row_number() over (partition by vid order by nv desc, nvid desc) as r from near),
ptr as (select vid, case when nv > v or (nv = v and nvid > vid) then nvid else vid end as next from best where r = 1),
walk(vid, top) as (select vid, vid from ptr union select w.vid, p.next from walk w join ptr p on p.vid = w.top),
peak as (select w.vid, w.top as label from walk w join ptr p on p.vid = w.top and p.next = p.vid)
"""


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


@query("t3_raster_lineitem", f"with {LQ} select vid, x, y, v as value from lq")
def t3_raster(spark: SparkSession, d: str) -> DataFrame:
    return raster.lineitem_field(spark, d).select("vid", "x", "y", "value")


@query("g3_neighbours", f"with {LQ}, {NEAR} select vid, count(*) as n, cast(sum(nv) as bigint) as total, min(nvid) as first from near group by vid")
def g3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near = G.neighbours(raster.lineitem_field(spark, d), raster.LQ)
    return near.groupBy("vid").agg(F.count("*").alias("n"), F.sum("nvalue").alias("total"), F.min("nvid").alias("first"))


@query("g4_full_neighbours", f"with {LQ} select a.vid, count(*) as n, cast(sum(b.v) as bigint) as total from lq a join lq b on greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1 group by a.vid")
def g4_full(spark: SparkSession, d: str) -> DataFrame:
    near = G.neighbours(raster.lineitem_field(spark, d), raster.LQ, "full")
    return near.groupBy("vid").agg(F.count("*").alias("n"), F.sum("nvalue").alias("total"))


@query("g8_boundary", f"with {LQ} select vid, least(x, 45 - x, y, 49 - y) as dist, cast(x in (0, 45) as int) + cast(y in (0, 49) as int) as bnd from lq")
def g8_boundary(spark: SparkSession, d: str) -> DataFrame:
    field = raster.lineitem_field(spark, d)
    at = [F.col(n) for n in G.NAMES]
    return field.select("vid", G.distance_to_boundary(at, raster.LQ).alias("dist"), G.boundary_of(at, raster.LQ).alias("bnd"))


@query("g15_cell_extremes", f"""with {LQ}, cell as (select g as cid, g % 91 as cx, g // 91 as cy from range(9009) t(g)),
    vert as (select c.cid, c.cx % 2 + c.cy % 2 as dim, lq.vid, lq.v from cell c join lq on lq.x in (c.cx // 2, (c.cx + 1) // 2) and lq.y in (c.cy // 2, (c.cy + 1) // 2)),
    ranked as (select *, row_number() over (partition by cid order by v, vid) as up, row_number() over (partition by cid order by v desc, vid desc) as down from vert)
    select cid, cast(any_value(dim) as int) as dim, max(case when down = 1 then vid end) as vmax, max(case when up = 1 then vid end) as vmin, max(v) as max_value, min(v) as min_value, count(*) as n_vertices from ranked group by cid""")
def g15_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = G.cells(spark, raster.LQ)
    found = G.cell_extremes(cells, raster.lineitem_field(spark, d), raster.LQ)
    return found.join(cells.select("cid", "dim"), "cid").select("cid", "dim", "vmax", "vmin", "max_value", "min_value", "n_vertices")


@query("f1_gradient", f"""with {LQ}, w as (select *, lag(v) over (partition by y order by x) as l, lead(v) over (partition by y order by x) as r, lag(v) over (partition by x order by y) as b, lead(v) over (partition by x order by y) as t from lq)
    select vid, case when l is null then cast(r - v as double) when r is null then cast(v - l as double) else (r - l) / 2.0 end as dx, case when b is null then cast(t - v as double) when t is null then cast(v - b as double) else (t - b) / 2.0 end as dy from w""")
def f1_gradient(spark: SparkSession, d: str) -> DataFrame:
    return C.gradient(raster.lineitem_field(spark, d), raster.LQ).select("vid", "dx", "dy")


def _kernel_sql(weights: list[tuple[int, int, int]]) -> str:
    rows = ", ".join(f"({x}, {y}, {w})" for x, y, w in weights)
    return f"""with {LQ}, k(dx, dy, w) as (values {rows}) select a.vid, cast(sum(k.w * b.v) as double) as value from lq a cross join k
        join lq b on b.x = least(greatest(a.x + k.dx, 0), 45) and b.y = least(greatest(a.y + k.dy, 0), 49) group by a.vid"""


@query("f4_laplacian", _kernel_sql([(0, 0, -4), (1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1)]))
def f4_laplacian(spark: SparkSession, d: str) -> DataFrame:
    return C.convolve(raster.lineitem_field(spark, d), raster.LQ, C.kernel("laplacian"))


@query("f4_sobel_x", _kernel_sql([(x, y, x * (2 - abs(y))) for x in (-1, 1) for y in (-1, 0, 1)]))
def f4_sobel(spark: SparkSession, d: str) -> DataFrame:
    return C.convolve(raster.lineitem_field(spark, d), raster.LQ, C.kernel("sobel_x"))


GAUSS = _kernel_sql([(*o, repr(w)) for o, w in C.kernel("gauss", 5)]).replace("cast(sum(k.w * b.v) as double)", "round(sum(k.w::double * b.v), 2)")


@query("f4_gauss", GAUSS)
def f4_gauss(spark: SparkSession, d: str) -> DataFrame:
    return C.convolve(raster.lineitem_field(spark, d), raster.LQ, C.kernel("gauss", 5)).select("vid", F.round("value", 2).alias("value"))


@query("g19_range", f"with {LQ} select min(v) as low, max(v) as high, max(v) - min(v) as range from lq")
def g19_range(spark: SparkSession, d: str) -> DataFrame:
    return C.value_range(raster.lineitem_field(spark, d))


@query("d1_extrema", f"""with {LQ}, {NEAR} select vid, any_value(v) as value, max(cast(nv < v or (nv = v and nvid < vid) as int)) = 0 as is_min, max(cast(nv > v or (nv = v and nvid > vid) as int)) = 0 as is_max
    from near group by vid having max(cast(nv < v or (nv = v and nvid < vid) as int)) = 0 or max(cast(nv > v or (nv = v and nvid > vid) as int)) = 0""")
def d1_extrema(spark: SparkSession, d: str) -> DataFrame:
    return regions.extrema(raster.lineitem_field(spark, d), raster.LQ)


@query("d2_steepest", f"with recursive {PEAKS} select vid, next from ptr")
def d2_steepest(spark: SparkSession, d: str) -> DataFrame:
    return regions.steepest(raster.lineitem_field(spark, d), raster.LQ)


@query("r8_peaks", f"with recursive {PEAKS} select vid, label from peak")
def r8_peaks(spark: SparkSession, d: str) -> DataFrame:
    return regions.basins(raster.lineitem_field(spark, d), raster.LQ)


@query("revenue_by_peak", f"with recursive {PEAKS} select label, count(*) as n_cells, cast(sum(v) as bigint) as revenue from peak join lq using (vid) group by label")
def revenue_by_peak(spark: SparkSession, d: str) -> DataFrame:
    """Revenue of every region of the ship-period x quantity plane whose cells climb to the same peak."""
    field = cut(raster.lineitem_field(spark, d))
    labels = regions.basins(field, raster.LQ)
    return labels.join(field, "vid").groupBy("label").agg(F.count("*").alias("n_cells"), F.sum("value").alias("revenue"))


@query("r10_separators", f"""with recursive {PEAKS} select a.label as label1, b.label as label2, count(*) as n_edges from near n join peak a on a.vid = n.vid join peak b on b.vid = n.nvid where a.label < b.label group by 1, 2""")
def r10_separators(spark: SparkSession, d: str) -> DataFrame:
    labels = cut(regions.basins(raster.lineitem_field(spark, d), raster.LQ))
    return regions.separators(labels, raster.LQ).groupBy("label1", "label2").agg(F.count("*").alias("n_edges"))


@query("r11_region_stats", f"with recursive {PEAKS}, s as (select label, count(*) as area from peak group by 1) select count(*) as regions, cast(sum(area) as bigint) as labelled, min(area) as min_area, max(area) as max_area, avg(area) as mean_area, cast(2300 - sum(area) as bigint) as unlabelled from s")
def r11_stats(spark: SparkSession, d: str) -> DataFrame:
    return regions.region_statistics(regions.basins(raster.lineitem_field(spark, d), raster.LQ), raster.LQ.size)


MASK = f"""{LQ}, {NEAR}, m as (select vid, v from lq where v > (select avg(v) from lq)),
link as (select n.vid, n.nvid from near n where n.vid in (select vid from m) and n.nvid in (select vid from m)),
reach(vid, top) as (select vid, vid from m union select r.vid, l.nvid from reach r join link l on l.vid = r.top),
comp as (select vid, min(top) as label from reach group by vid)"""


def _mask(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    field = cut(raster.lineitem_field(spark, d))
    mean = field.agg(F.avg("value").alias("mean"))
    return field, field.join(F.broadcast(mean), F.col("value") > F.col("mean")).select("vid", "value")  # one row


@query("r1_components", f"with recursive {MASK} select vid, label from comp")
def r1_components(spark: SparkSession, d: str) -> DataFrame:
    return regions.components(_mask(spark, d)[1], raster.LQ)


@query("r2_dense_labels", f"with recursive {MASK} select vid, dense_rank() over (order by label) - 1 as label from comp")
def r2_dense(spark: SparkSession, d: str) -> DataFrame:
    return regions.relabel_dense(regions.components(_mask(spark, d)[1], raster.LQ)).select("vid", "label")


@query("r3_bbox", f"""with recursive {MASK} select label, count(*) as n, greatest(min(x) - 1, 0) as x0, least(max(x) + 1, 45) as x1, greatest(min(y) - 1, 0) as y0, least(max(y) + 1, 49) as y1 from comp join lq using (vid) group by label""")
def r3_bbox(spark: SparkSession, d: str) -> DataFrame:
    return regions.bounding_boxes(regions.components(_mask(spark, d)[1], raster.LQ), raster.LQ).select("label", "n", "x0", "x1", "y0", "y1")


@query("r4_sub_volumes", f"""with recursive {MASK}, b as (select label, greatest(min(x) - 1, 0) as x0, least(max(x) + 1, 45) as x1, greatest(min(y) - 1, 0) as y0, least(max(y) + 1, 49) as y1 from comp join lq using (vid) group by label)
    select b.label, lq.vid, case when c.label = b.label then lq.v else 0 end as value from b join lq on lq.x between x0 and x1 and lq.y between y0 and y1 left join comp c on c.vid = lq.vid""")
def r4_sub_volumes(spark: SparkSession, d: str) -> DataFrame:
    field, mask = _mask(spark, d)
    return regions.sub_volumes(cut(regions.components(mask, raster.LQ)), field, raster.LQ)


@query("r18_active_cells", f"""with {LQ}, cell as (select g as cid, g % 91 as cx, g // 91 as cy from range(9009) t(g)),
    vert as (select c.cid, lq.v from cell c join lq on lq.x in (c.cx // 2, (c.cx + 1) // 2) and lq.y in (c.cy // 2, (c.cy + 1) // 2))
    select cid from vert group by cid having min(v) < (select max(v) // 2 from lq) and max(v) >= (select max(v) // 2 from lq)""")
def r18_active(spark: SparkSession, d: str) -> DataFrame:
    field = cut(raster.lineitem_field(spark, d))
    level = field.agg(F.max("value")).first()[0] // 2  # one number
    return regions.active_cells(G.cell_extremes(G.cells(spark, raster.LQ), field, raster.LQ), level).select("cid")


#: one polyline for each user: (line_id, pos, x, y) with whole seconds and cents, so that products are exact
PL = """pl as (select user_id as line_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos,
    cast(date_diff('second', timestamp '2024-01-01', ts) // 3600 as double) as x, cast(round(value * 100) as bigint) / 100.0 as y from events)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    events = table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    hours = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600)
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    y = F.round(F.col("value") * 100).cast("long") / 100
    return events.select(F.col("user_id").alias("line_id"), rank.cast("long").alias("pos"), hours.cast("double").alias("x"), y.alias("y"), F.lit(0.0).alias("z"), y.alias("value"))


@query("p1_length", f"with {PL}, s as (select line_id, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) as step from pl window w as (partition by line_id order by pos)) select line_id, round(coalesce(sum(step), 0), 4) as length, count(*) as n_points from s group by line_id")
def p1_length(spark: SparkSession, d: str) -> DataFrame:
    return lines.lengths(_lines(spark, d)).select("line_id", F.round("length", 4).alias("length"), "n_points")


@query("p4_orientation", f"""with {PL}, e as (select line_id, arg_max(x, pos) - arg_min(x, pos) as dx, arg_max(y, pos) - arg_min(y, pos) as dy from pl group by line_id)
    select line_id, case when dx <> 0 or dy <> 0 then round(degrees(acos(dx / sqrt(dx * dx + dy * dy))), 4) end as angle_x, case when dx <> 0 or dy <> 0 then round(degrees(acos(dy / sqrt(dx * dx + dy * dy))), 4) end as angle_y from e""")
def p4_orientation(spark: SparkSession, d: str) -> DataFrame:
    return lines.orientation(_lines(spark, d)).select("line_id", F.round("angle_x", 4).alias("angle_x"), F.round("angle_y", 4).alias("angle_y"))


@query("p5_centroid", f"with {PL} select line_id, round(avg(x), 4) as x, round(avg(y), 4) as y from pl group by line_id")
def p5_centroid(spark: SparkSession, d: str) -> DataFrame:
    return lines.centroids(_lines(spark, d)).select("line_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def _smoothed_sql(times: int) -> str:
    steps = [f"s{k + 1} as (select line_id, pos, {', '.join(f'case when lag({c}) over w is null or lead({c}) over w is null then {c} else lag({c}) over w / 4 + {c} / 2 + lead({c}) over w / 4 end as {c}' for c in 'xy')} from s{k} window w as (partition by line_id order by pos))" for k in range(times)]
    return f"{PL}, s0 as (select * from pl), {', '.join(steps)}"


@query("p6_curvature", f"""with {_smoothed_sql(5)}, w as (select line_id, pos, x - lag(x, 10) over w as bx, y - lag(y, 10) over w as b_y, lead(x, 10) over w - x as ax, lead(y, 10) over w - y as ay from s5 window w as (partition by line_id order by pos)),
    a as (select line_id, case when pos % 10 = 0 and (bx * bx + b_y * b_y) * (ax * ax + ay * ay) > 0 then acos(greatest(least((bx * ax + b_y * ay) / (sqrt(bx * bx + b_y * b_y) * sqrt(ax * ax + ay * ay)), 1), -1)) end as angle from w)
    select line_id, round(coalesce(sum(angle), 0), 3) as total, round(avg(angle), 3) as mean from a group by line_id""")
def p6_curvature(spark: SparkSession, d: str) -> DataFrame:
    return lines.curvature(_lines(spark, d), smoothing=5).select("line_id", F.round("total", 3).alias("total"), F.round("mean", 3).alias("mean"))


@query("p11_metrics", f"""with {PL}, s as (select *, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) as step from pl window w as (partition by line_id order by pos))
    select line_id, round(coalesce(sum(step), 0), 4) as length, round(avg(y), 4) as mean_value, round(avg(x), 4) as mean_x, round(avg(case when y > 0 then y end), 4) as mean_positive from s group by line_id""")
def p11_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = lines.metrics(_lines(spark, d).withColumn("positive", F.col("value")), ("positive",))
    return found.select("line_id", *[F.round(c, 4).alias(c) for c in ("length", "mean_value", "mean_x", "mean_positive")])


#: point by point: each step drops the inner point of every line that is nearest to the chord through its neighbours, if nearer than 5
DECIMATED = f"""{PL}, gap as (select 5.0::double as most), pts as (select line_id, list(struct_pack(pos := pos, x := x, y := y) order by pos) as p from pl group by line_id),
thin(line_id, step, p) as (select line_id, 0, p from pts union all select line_id, step + 1, list_filter(p, lambda q, i: i <> pick.i) from (
    select line_id, step, p, list_sort(list_transform(list_transform(list_transform(range(2, len(p)), lambda i: {{'i': i, 'x': p[i].x - p[i - 1].x, 'y': p[i].y - p[i - 1].y, 'cx': p[i + 1].x - p[i - 1].x, 'cy': p[i + 1].y - p[i - 1].y}}),
        lambda g: {{'i': g.i, 'x': g.x, 'y': g.y, 'cx': g.cx, 'cy': g.cy, 's': (g.x * g.cx + g.y * g.cy) / greatest(g.cx * g.cx + g.cy * g.cy, 1e-300)}}),
        lambda g: {{'g': sqrt((g.x - g.cx * g.s) * (g.x - g.cx * g.s) + (g.y - g.cy * g.s) * (g.y - g.cy * g.s)), 'i': g.i}}))[1] as pick from thin) where pick.g < (select most from gap)),
left_over as (select line_id, arg_max(p, step) as p from thin group by line_id)"""


@query("p3_decimate", f"with recursive {DECIMATED} select line_id, q.pos as pos, q.x as x, q.y as y, 0.0::double as z, q.y as value from (select line_id, unnest(p) as q from left_over)")
def p3_decimate(spark: SparkSession, d: str) -> DataFrame:
    return lines.decimate(_lines(spark, d), 5.0)


@query("p13_radius_join", """select a.p_partkey as p_partkey, count(*) as n, min(b.p_partkey) as first from part a join part b
    on abs(a.p_size - b.p_size) <= 2 and (a.p_size - b.p_size) ** 2 + (round(a.p_retailprice) - round(b.p_retailprice)) ** 2 <= 4 group by a.p_partkey""")
def p13_radius(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("x"), F.round("p_retailprice").alias("y"))
    return lines.around(points, points, 2.0, "p_partkey", ("x", "y")).groupBy("p_partkey").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def _graph(spark: SparkSession, d: str) -> DataFrame:
    near = G.neighbours(raster.lineitem_field(spark, d), raster.LQ)
    return cut(near.select(F.col("vid").alias("src"), F.col("nvid").alias("dst"), F.abs(F.col("value") - F.col("nvalue")).alias("weight")))


@query("l14_nearest_source", f"with recursive {LQ}, {NEAR}, {S.nearest('select vid from lq where vid % 97 = 0')} select * from nearest")
def l14_nearest(spark: SparkSession, d: str) -> DataFrame:
    edges = _graph(spark, d)
    return iterate.nearest_source(edges, edges.select(F.col("src").alias("vertex")).where("vertex % 97 = 0").distinct())


@query("l12_shortest_path", f"""with recursive {LQ}, {NEAR}, {S.nearest('select min(vid) as vid from lq')},
    back(vertex, hop) as (select max(vid), 0 from lq union all select n.prev, hop + 1 from back b join nearest n using (vertex) where n.prev is not null)
    select (select max(hop) from back) - hop as pos, vertex, dist from back join nearest using (vertex)""")
def l12_path(spark: SparkSession, d: str) -> DataFrame:
    edges = _graph(spark, d)
    ends = edges.agg(F.min("src").alias("a"), F.max("src").alias("b"))
    return iterate.shortest_path(edges, ends.select(F.col("a").alias("vertex")), ends.select(F.col("b").alias("vertex")))


def _gradient(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    field = cut(raster.lineitem_field(spark, d))
    return field, cut(D.discrete_gradient(field, raster.LQ))


@query("d4_gradient", f"with recursive {LQ}, {S.GRAD} select * from grad")
def d4_gradient(spark: SparkSession, d: str) -> DataFrame:
    return D.discrete_gradient(raster.lineitem_field(spark, d), raster.LQ)


@query("d4_gradient_volume")
def d4_gradient_volume(spark: SparkSession, d: str) -> DataFrame:
    return D.discrete_gradient(raster.lineitem_volume(spark, d), raster.LQD)


#: minima of the complex are the vertices without a lower face neighbour, whatever the pairing above them
@query("m1_minima", f"""with {LQ}, {NEAR} select vid % 46 * 2 + vid // 46 * 2 * 91 as cid, any_value(v) as value from near group by vid having max(cast(nv < v or (nv = v and nvid < vid) as int)) = 0""")
def m1_minima(spark: SparkSession, d: str) -> DataFrame:
    field, grad = _gradient(spark, d)
    return M.nodes(grad, field, raster.LQ).where("dim = 0").select("cid", "value")


#: a vertex paired with its steepest edge flows to its lowest neighbour, so basins follow the steepest pointer
@query("r7_basins", f"""with recursive {LQ}, {NEAR}, best as (select vid, v, nvid, nv, row_number() over (partition by vid order by nv, nvid) as r from near),
    ptr as (select vid, case when nv < v or (nv = v and nvid < vid) then nvid else vid end as next from best where r = 1),
    walk(vid, top) as (select vid, vid from ptr union select w.vid, p.next from walk w join ptr p on p.vid = w.top)
    select w.vid % 46 * 2 + w.vid // 46 * 2 * 91 as cid, w.top % 46 * 2 + w.top // 46 * 2 * 91 as label from walk w join ptr p on p.vid = w.top and p.next = p.vid""")
def r7_basins(spark: SparkSession, d: str) -> DataFrame:
    return M.ends_down(_gradient(spark, d)[1], raster.LQ)


@query("m1_nodes", f"with recursive {LQ}, {S.GRAD}, {S.NODES} select * from nodes")
def m1_nodes(spark: SparkSession, d: str) -> DataFrame:
    field, grad = _gradient(spark, d)
    return M.nodes(grad, field, raster.LQ)


@query("m2_arcs", f"with recursive {LQ}, {S.COMPLEX} select * from arcs")
def m2_arcs(spark: SparkSession, d: str) -> DataFrame:
    field, grad = _gradient(spark, d)
    return M.arcs(grad, field, raster.LQ)


def _pairs(spark: SparkSession, d: str, maxima: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    field, grad = _gradient(spark, d)
    nodes, arcs = cut(M.nodes(grad, field, raster.LQ)), cut(M.arcs(grad, field, raster.LQ))
    edges = M.extremum_graph(arcs, nodes, raster.LQ, maxima)
    extrema = nodes.where(f"dim = {2 if maxima else 0}").select("nid", "value")
    return grad, nodes, M.merge_pairs(edges, extrema, maxima)


@query("r12_merge_pairs", f"with recursive {LQ}, {S.COMPLEX}, {S.merges()} select * from pairs")
def r12_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)[2]


@query("r12_merge_pairs_maxima", f"with recursive {LQ}, {S.COMPLEX}, {S.merges(maxima=True)} select * from pairs")
def r12_pairs_maxima(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, maxima=True)[2]


#: merges up to a tenth of the field's range, the default limit of m14, and where each extremum ends
LIMITED = "lim as (select (max(v) - min(v)) * 0.1::double as cancel from lq), chosen as (select * from pairs where persistence <= (select cancel from lim))"
MERGED = "moved(nid, spot) as (select nid, nid from ext union select m.nid, c.into from moved m join chosen c on c.nid = m.spot), living as (select nid, spot as root from moved where spot not in (select nid from chosen))"


def _cancel(spark: SparkSession, d: str) -> float:
    return M.default_limits(raster.lineitem_field(spark, d)).first()["cancel"]  # one number


@query("r9_relabel", f"with recursive {LQ}, {S.COMPLEX}, {S.merges()}, {LIMITED}, {MERGED} select cid, root as label from ends join living on nid = label where cid % 91 % 2 = 0 and cid // 91 % 2 = 0")
def r9_relabel(spark: SparkSession, d: str) -> DataFrame:
    grad, _, pairs = _pairs(spark, d)
    return M.survivors(M.ends_down(grad, raster.LQ), cut(pairs), _cancel(spark, d))


@query("m12_living", f"with recursive {LQ}, {S.COMPLEX}, {S.merges()}, {LIMITED} select * from nodes where nid not in (select nid from chosen) and nid not in (select sid from chosen)")
def m12_living(spark: SparkSession, d: str) -> DataFrame:
    _, nodes, pairs = _pairs(spark, d)
    return M.living(nodes, cut(pairs), _cancel(spark, d))


@query("m18_constituents", f"with recursive {LQ}, {S.COMPLEX}, {S.merges()}, {LIMITED}, {MERGED} select l.nid, root from living l join chosen using (nid)")
def m18_constituents(spark: SparkSession, d: str) -> DataFrame:
    return M.constituents(cut(_pairs(spark, d)[2]), _cancel(spark, d))


@query("m7_arc_weights", f"with recursive {LQ}, {S.COMPLEX} select lower, upper, dim, mult, persistence, cast((sum(mult) over (partition by lower) - 1) * (sum(mult) over (partition by upper) - 1) as bigint) as weight from arcs")
def m7_weights(spark: SparkSession, d: str) -> DataFrame:
    field, grad = _gradient(spark, d)
    return M.arc_weight(cut(M.arcs(grad, field, raster.LQ)))


@query("l15_min_network", f"""with recursive {LQ}, {S.COMPLEX}, {S.merges()}, best as (select r.e1, r.e2, s.sid, svalue, row_number() over (partition by r.e1, r.e2 order by svalue, s.sid) as n from sorted s join joined r using (sid)),
    lim as (select unnest([0, 0.1, 0.3]) * max(v)::double as "limit" from lq) select "limit", e1, e2, sid, svalue from best join lim on svalue >= "limit" where n = 1""")
def l15_network(spark: SparkSession, d: str) -> DataFrame:
    high = float(C.value_range(raster.lineitem_field(spark, d)).first()["high"])  # one number
    field, grad = _gradient(spark, d)
    nodes, arcs = cut(M.nodes(grad, field, raster.LQ)), cut(M.arcs(grad, field, raster.LQ))
    return M.minimal_network(M.extremum_graph(arcs, nodes, raster.LQ, maxima=False), [share * high for share in (0.0, 0.1, 0.3)])


#: every cell of the doubled lattice: (cid, cx, cy)
CELL = "cell as (select g as cid, g % 91 as cx, g // 91 as cy from range(9009) t(g))"


@query("g9_cells", f"with {CELL} select cid, cast(cx % 2 + cy % 2 as int) as dim, cast(cx in (0, 90) as int) + cast(cy in (0, 98) as int) as bnd, cx * 0.5::double as x, cy * 0.5::double as y, cast(2 - cx % 2 - cy % 2 as int) as dual_dim from cell")
def g9_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells, boundary classes, centroids and dual dimensions of the grid that a field is on."""
    cells = G.cells(spark, raster.LQ)
    dual = G.dual(cells.select("cid", "dim"), raster.LQ).select("cid", F.col("dim").cast("int").alias("dual_dim"))
    x, y, _ = G.centroid()
    return cells.select("cid", "dim", "bnd", x.alias("x"), y.alias("y")).join(dual, "cid")


def _incidence_sql(steps: str) -> str:
    return f"""with {LQ}, {CELL}, value as (select c.cid, c.cx, c.cy, max(lq.v) as v from cell c join lq on lq.x in (c.cx // 2, (c.cx + 1) // 2) and lq.y in (c.cy // 2, (c.cy + 1) // 2) group by 1, 2, 3)
        select a.cid, count(*) as n, cast(sum(b.v) as bigint) as total from value a join value b on {steps} group by a.cid"""


def _cell_values(spark: SparkSession, d: str) -> DataFrame:
    found = G.cell_extremes(G.cells(spark, raster.LQ), raster.lineitem_field(spark, d), raster.LQ)
    return cut(found.select("cid", F.col("max_value").alias("value")))


def _incident(spark: SparkSession, d: str, relation, name: str) -> DataFrame:
    values = _cell_values(spark, d)
    pairs = relation(values.select("cid"), raster.LQ).join(values.withColumnRenamed("cid", name), name)
    return pairs.groupBy("cid").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("g10_facets", _incidence_sql("(a.cx % 2 = 1 and abs(a.cx - b.cx) = 1 and a.cy = b.cy) or (a.cy % 2 = 1 and abs(a.cy - b.cy) = 1 and a.cx = b.cx)"))
def g10_facets(spark: SparkSession, d: str) -> DataFrame:
    return _incident(spark, d, G.facets, "fcid")


@query("g11_cofacets", _incidence_sql("(a.cx % 2 = 0 and abs(a.cx - b.cx) = 1 and a.cy = b.cy) or (a.cy % 2 = 0 and abs(a.cy - b.cy) = 1 and a.cx = b.cx)"))
def g11_cofacets(spark: SparkSession, d: str) -> DataFrame:
    return _incident(spark, d, G.cofacets, "ccid")


@query("g12_star", _incidence_sql("greatest(abs(a.cx - b.cx), abs(a.cy - b.cy)) = 1"))
def g12_star(spark: SparkSession, d: str) -> DataFrame:
    return _incident(spark, d, G.star, "acid")


@query("g5_same_boundary", f"with {LQ}, {NEAR}, b as (select vid, cast(x in (0, 45) as int) + cast(y in (0, 49) as int) as bnd from lq) select n.vid, count(*) as n, cast(sum(nv) as bigint) as total from near n join b p on p.vid = n.vid join b q on q.vid = n.nvid where p.bnd = q.bnd group by n.vid")
def g5_same_boundary(spark: SparkSession, d: str) -> DataFrame:
    near = G.neighbours(raster.lineitem_field(spark, d), raster.LQ, same_boundary=True)
    return near.groupBy("vid").agg(F.count("*").alias("n"), F.sum("nvalue").alias("total"))


@query("g6_line_neighbours", f"with {LQ} select a.vid, count(*) as n, cast(sum(b.v) as bigint) as total from lq a join lq b on a.y = b.y and abs(a.x - b.x) <= 3 group by a.vid")
def g6_line(spark: SparkSession, d: str) -> DataFrame:
    return G.line_neighbours(raster.lineitem_field(spark, d), raster.LQ, 0, 3).groupBy("vid").agg(F.count("*").alias("n"), F.sum("nvalue").alias("total"))


@query("g21_cell_mask", f"with {LQ}, {CELL} select c.cid from cell c join lq on lq.x in (c.cx // 2, (c.cx + 1) // 2) and lq.y in (c.cy // 2, (c.cy + 1) // 2) group by c.cid having min(lq.v) > (select avg(v) from lq)")
def g21_mask(spark: SparkSession, d: str) -> DataFrame:
    return G.cell_mask(G.cells(spark, raster.LQ), _mask(spark, d)[1], raster.LQ).select("cid")


@query("f2_interpolated", f"with {LQ}, p as (select vid as pid, x, y from lq where x < 45 and y < 49) select pid, round(sum(lq.v * (case when lq.x = p.x then 0.375::double else 0.125::double end)), 2) as value from p join lq on lq.x in (p.x, p.x + 1) and lq.y in (p.y, p.y + 1) group by pid")
def f2_interpolated(spark: SparkSession, d: str) -> DataFrame:
    field = raster.lineitem_field(spark, d)
    points = field.where("x < 45 and y < 49").select(F.col("vid").alias("pid"), (F.col("x") + 0.25).alias("px"), (F.col("y") + 0.5).alias("py"), F.lit(0.0).alias("pz"))
    return C.interpolate(points, field, raster.LQ).select("pid", F.round("value", 2).alias("value"))


@query("m14_limits", f"with {LQ} select (max(v) - min(v)) * 0.1::double as cancel, (max(v) - min(v)) * 0.01::double as base from lq")
def m14_limits(spark: SparkSession, d: str) -> DataFrame:
    return M.default_limits(raster.lineitem_field(spark, d)).select(F.col("cancel").cast("double").alias("cancel"), F.col("base").cast("double").alias("base"))


@query("p9_slices", f"""with {PL}, s as (select *, coalesce(sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2), 0) as step from pl window w as (partition by line_id order by pos)),
    a as (select *, sum(step) over (partition by line_id order by pos) as arc from s), l as (select line_id, arg_min(arc, struct_pack(y := y, pos := pos)) as anchor from a group by line_id),
    n as (select line_id, pos, floor((arc - anchor) / 100.0) as slice from a join l using (line_id)), b as (select *, lag(slice) over (partition by line_id order by pos) as before from n)
    select line_id, pos, cast(slice as bigint) as slice from b where before is null or before <> slice""")
def p9_slices(spark: SparkSession, d: str) -> DataFrame:
    return lines.slices(_lines(spark, d), 100.0).select("line_id", "pos", "slice")


@query("p2_smooth", f"with {_smoothed_sql(5)} select line_id, pos, round(x, 3) as x, round(y, 3) as y from s5")
def p2_smooth(spark: SparkSession, d: str) -> DataFrame:
    return lines.smooth(_lines(spark, d), 5).select("line_id", "pos", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("m4_geometry", f"with recursive {LQ}, {S.COMPLEX}, {S.LINES} select sid, side, pos, cid, cast(dim as int) as dim from line")
def m4_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Valley and ridge lines from every saddle, cell by cell."""
    grad = _gradient(spark, d)[1]
    return L.arc_geometry(grad, raster.LQ).withColumn("dim", F.lit(0)).union(L.arc_geometry(grad, raster.LQ, up=True).withColumn("dim", F.lit(1)))


@query("l3_mean_along", f"with recursive {LQ}, {S.COMPLEX}, {S.LINES}, {CELL}, value as (select c.cid, max(lq.v) as v from cell c join lq on lq.x in (c.cx // 2, (c.cx + 1) // 2) and lq.y in (c.cy // 2, (c.cy + 1) // 2) group by 1) select sid, side, count(*) as n_cells, avg(v) as mean_value from line join value using (cid) where dim = 0 group by 1, 2")
def l3_mean(spark: SparkSession, d: str) -> DataFrame:
    return L.mean_along(L.arc_geometry(_gradient(spark, d)[1], raster.LQ), _cell_values(spark, d))


@query("t7_history", f"""with recursive {LQ}, {S.COMPLEX}, {S.merges()}, t as (select row_number() over (order by persistence, nid) - 1 as rank, nid, sid, persistence from pairs) select rank, nid, sid, persistence, persistence as cum_persistence, (select count(*) from ext) - rank - 1 as "left" from t""")
def t7_history(spark: SparkSession, d: str) -> DataFrame:
    _, nodes, pairs = _pairs(spark, d)
    return L.cancellation_history(cut(pairs), nodes.where("dim = 0").agg(F.count("*").alias("n")))


@query("t11_persistence_pairs", f"with recursive {LQ}, {S.COMPLEX} select lower, upper, a.value as lower_value, b.value as upper_value from arcs join nodes a on a.nid = lower join nodes b on b.nid = upper where arcs.dim = 1")
def t11_pairs(spark: SparkSession, d: str) -> DataFrame:
    field, grad = _gradient(spark, d)
    nodes, arcs = cut(M.nodes(grad, field, raster.LQ)), cut(M.arcs(grad, field, raster.LQ))
    return L.persistence_pairs(M.ridge_arcs(arcs, raster.LQ), nodes, nodes)


@query("m22_reasons", f"with recursive {LQ}, {S.COMPLEX} select case when a.bnd <> b.bnd then 'boundary' when mult > 1 then 'multiplicity' else 'none' end as reason, count(*) as n from arcs join nodes a on a.nid = lower join nodes b on b.nid = upper group by 1")
def m22_reasons(spark: SparkSession, d: str) -> DataFrame:
    field, grad = _gradient(spark, d)
    return L.blocking_reasons(M.arcs(grad, field, raster.LQ), M.nodes(grad, field, raster.LQ))


def _hierarchy(spark: SparkSession, d: str, share: float = 0.1) -> tuple[DataFrame, DataFrame, H.Hierarchy]:
    """Gradient, nodes and the hierarchy up to a share of the field's range."""
    field, grad = _gradient(spark, d)
    nodes, arcs = cut(M.nodes(grad, field, raster.LQ)), cut(M.arcs(grad, field, raster.LQ))
    return grad, nodes, H.hierarchy(arcs, nodes, 10 * share * _cancel(spark, d))


HIER = f"with recursive {LQ}, {S.COMPLEX}, {S.hierarchy()}"


@query("m9_hierarchy", f"{HIER} select * from gone")
def m9_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return _hierarchy(spark, d)[2].gone


@query("m9_hierarchy_whole", f"with recursive {LQ}, {S.COMPLEX}, {S.hierarchy(1.0)} select dim, count(*) as n, sum(round) as rounds, max(time) as time, sum(lower) as lowers, sum(upper) as uppers from gone group by dim")
def m9_hierarchy_whole(spark: SparkSession, d: str) -> DataFrame:
    """The hierarchy up to the whole range of the field, summed up by dimension."""
    gone = _hierarchy(spark, d, 1.0)[2].gone
    return gone.groupBy("dim").agg(F.count("*").alias("n"), F.sum("round").alias("rounds"), F.max("time").alias("time"), F.sum("lower").alias("lowers"), F.sum("upper").alias("uppers"))


@query("m15_living_arcs", f"{HIER} select lower, upper, dim, mult, persistence from alive")
def m15_living_arcs(spark: SparkSession, d: str) -> DataFrame:
    return _hierarchy(spark, d)[2].live.select("lower", "upper", "dim", "mult", "persistence")


@query("m12_living_at", f"{HIER} select n.* from nodes n where nid not in (select lower from gone where time <= (select cancel / 2 from lim) union all select upper from gone where time <= (select cancel / 2 from lim))")
def m12_living_at(spark: SparkSession, d: str) -> DataFrame:
    """Living nodes of all dimensions at half of the limit that the hierarchy was built to."""
    _, nodes, found = _hierarchy(spark, d)
    return H.living_nodes(nodes, H.until(found.gone, _cancel(spark, d) / 2))


@query("m15_living_arcs_at", f"""{HIER}, stop as (select count(*) as n from gone where time <= (select cancel / 2 from lim))
    select low as lower, up as upper, dim, mult, uv - lv as persistence from hier where kind = 0 and step = (select n from stop)""")
def m15_living_arcs_at(spark: SparkSession, d: str) -> DataFrame:
    """Living arcs at half of the limit, from the history alone."""
    field, grad = _gradient(spark, d)
    nodes, arcs = cut(M.nodes(grad, field, raster.LQ)), cut(M.arcs(grad, field, raster.LQ))
    found, limit = H.hierarchy(arcs, nodes, _cancel(spark, d)), _cancel(spark, d) / 2
    return H.living_arcs(arcs, nodes, found, limit).select("lower", "upper", "dim", "mult", "persistence")


@query("t7_history_all", f"""{HIER}, total as (select count(*) filter (dim = 0) as n0, count(*) filter (dim = 1) as n1, count(*) filter (dim = 2) as n2 from nodes)
    select round - 1 as rank, lower, upper, dim, persistence, time, n0 - count(*) filter (dim = 0) over w as left0, n1 - round as left1, n2 - count(*) filter (dim = 1) over w as left2 from gone cross join total window w as (order by round)""")
def t7_history_all(spark: SparkSession, d: str) -> DataFrame:
    """Cancellations in order with the running largest persistence and the nodes of each dimension that are left."""
    _, nodes, found = _hierarchy(spark, d)
    return H.history(found.gone, nodes, (0, 1, 2))


@query("m13_limit_maxima", f"""{HIER}, left_at as (select time, (select count(*) from nodes where dim = 2) - count(*) filter (dim = 1) over (order by round) as n from gone)
    select coalesce(min(time), 0) as "limit" from left_at where n <= 0.9 * (select count(*) from nodes where dim = 2)""")
def m13_limit_maxima(spark: SparkSession, d: str) -> DataFrame:
    """The least persistence at which nine tenths of the maxima are left."""
    _, nodes, found = _hierarchy(spark, d)
    return H.limit_for(found.gone, nodes, 2, int(0.9 * nodes.where("dim = 2").count()))


BLOCKS = "select a.nid from (select lower, upper from arcs) e join nodes a on a.nid in (e.lower, e.upper) join nodes l on l.nid = e.lower join nodes u on u.nid = e.upper where floor(l.x / 16) + 4 * floor(l.y / 16) <> floor(u.x / 16) + 4 * floor(u.y / 16)"


@query("m24_grouped_hierarchy", f"with recursive {LQ}, {S.COMPLEX}, {S.hierarchy(frozen=BLOCKS)} select * from gone")
def m24_grouped(spark: SparkSession, d: str) -> DataFrame:
    """Cancellations inside blocks of 16 x 16 samples, with the ends of arcs between blocks frozen."""
    field, grad = _gradient(spark, d)
    nodes, arcs = cut(M.nodes(grad, field, raster.LQ)), cut(M.arcs(grad, field, raster.LQ))
    groups = nodes.select("nid", (F.floor(F.col("x") / 16) + 4 * F.floor(F.col("y") / 16)).alias("group"))
    return H.grouped_hierarchy(arcs, nodes, groups, _cancel(spark, d)).gone


@query("m19_merged_lines", f"{HIER}, {S.LINES}, {S.MERGED_LINES} select lower, upper, number, pos, cid from merged")
def m19_merged_lines(spark: SparkSession, d: str) -> DataFrame:
    """The cells of every living arc."""
    grad, _, found = _hierarchy(spark, d)
    return merged.merged_lines(cut(merged.base_lines(grad, raster.LQ)), found, found.live)


#: nodes that each node has taken over: (nid, part, descending), through all events
TAKEN = """taken as (select x.up as nid, g.upper as part, true as descending from gone g join hier x on x.kind = 0 and x.step = g.round - 1 and x.low = g.lower and x.up <> g.upper
    union all select w.low, g.lower, false from gone g join hier w on w.kind = 0 and w.step = g.round - 1 and w.up = g.upper and w.low <> g.lower),
living as (select nid, dim from nodes where nid not in (select lower from gone union all select upper from gone)),
part_of(nid, part, descending) as (select nid, nid, b from living cross join (values (true), (false)) t(b) union select p.nid, t.part, p.descending from part_of p join taken t on t.nid = p.part and t.descending = p.descending)"""


@query("m18_parts", f"{HIER}, {TAKEN} select nid, part, descending from part_of")
def m18_parts(spark: SparkSession, d: str) -> DataFrame:
    """The nodes, saddles too, whose manifolds belong to each living node."""
    _, nodes, found = _hierarchy(spark, d)
    return merged.constituents(found.parts, H.living_nodes(nodes, found.gone))


@query("m20_saddle_manifolds", f"{HIER}, {TAKEN}, {S.LINES} select distinct p.nid, l.cid from part_of p join living v on v.nid = p.nid and v.dim = 1 join line l on l.sid = p.part and l.dim = 0 where p.descending and (l.cid % 91 + l.cid // 91) % 2 = 1")
def m20_saddle_manifolds(spark: SparkSession, d: str) -> DataFrame:
    """The edges of the descending manifolds of living saddles, with those of the saddles that they have taken over."""
    grad, nodes, found = _hierarchy(spark, d)
    living = H.living_nodes(nodes, found.gone).where("dim = 1")
    owned = merged.constituents(found.parts, living).where("descending")
    return merged.living_manifolds(merged.flow_manifolds(grad, raster.LQ, 1), owned)


@query("l2_living_soup", f"{HIER}, {S.LINES}, {S.MERGED_LINES} select distinct merged.cid from merged join nodes p on p.nid = lower where p.dim = 1")
def l2_living_soup(spark: SparkSession, d: str) -> DataFrame:
    """The different cells of the living ridge lines."""
    grad, _, found = _hierarchy(spark, d)
    lines_of = merged.merged_lines(cut(merged.base_lines(grad, raster.LQ)), found, found.live.where("dim = 1"))
    return L.line_soup(lines_of)


@query("m3_saddle_arcs")
def m3_saddle_arcs(spark: SparkSession, d: str) -> DataFrame:
    return H.saddle_arcs(cut(D.discrete_gradient(raster.lineitem_volume(spark, d), raster.LQD)), raster.LQD)


@query("r5_boundary_map", f"""with recursive {PEAKS}, {CELL}, corner as (select c.cid, c.cx, c.cy, cx % 2 + cy % 2 as dim, p.label from cell c join lq on lq.x in (c.cx // 2, (c.cx + 1) // 2) and lq.y in (c.cy // 2, (c.cy + 1) // 2) join peak p using (vid)),
    seen as (select cid, cx, cy, dim, count(distinct label) as n_labels from corner group by all), e as (select cx, cy from seen where dim = 1 and n_labels = 2),
    marked as (select s.*, dim > 0 and exists (select 1 from e where (e.cx = s.cx and e.cy = s.cy) or (s.dim = 2 and abs(e.cx - s.cx) + abs(e.cy - s.cy) = 1)) as is_boundary from seen s)
    select cid, cast(dim as int) as dim, n_labels, is_boundary, cast(case when not is_boundary then 0 when dim = 2 and n_labels > 2 then 2 else 1 end as int) as kind from marked""")
def r5_boundary_map(spark: SparkSession, d: str) -> DataFrame:
    labels = cut(regions.basins(raster.lineitem_field(spark, d), raster.LQ))
    return regions.boundary_map(labels, G.cells(spark, raster.LQ), raster.LQ).select("cid", "dim", "n_labels", "is_boundary", "kind")


#: the cells of all valley lines as a graph: cells joined where one is a facet of the other
SOUP = """soup as (select distinct cid, cid % 91 as cx, cid // 91 as cy from line where dim = 0),
met as (select a.cid as a, b.cid as b from soup a join soup b on (b.cy = a.cy and abs(b.cx - a.cx) = 1) or (b.cx = a.cx and abs(b.cy - a.cy) = 1)),
deg as (select s.cid, count(m.b) as degree from soup s left join met m on m.a = s.cid group by 1),
inner_cell as (select cid from deg where degree = 2),
link as (select a, b from met where a in (select cid from inner_cell) and b in (select cid from inner_cell)),
walked(cid, spot) as (select cid, cid from inner_cell union select w.cid, l.b from walked w join link l on l.a = w.spot),
chain as (select cid, min(spot) as edge_id from walked group by 1)"""


def _valley_graph(spark: SparkSession, d: str) -> DataFrame:
    lines_of = cut(L.arc_geometry(_gradient(spark, d)[1], raster.LQ))
    return L.mesh_graph(L.line_soup(lines_of), raster.LQ)


@query("l4_mesh_graph", f"with recursive {LQ}, {S.COMPLEX}, {S.LINES}, {SOUP} select cid, degree, degree <> 2 as is_vertex, edge_id from deg left join chain using (cid)")
def l4_mesh_graph(spark: SparkSession, d: str) -> DataFrame:
    return _valley_graph(spark, d)


@query("l6_graph_edges", f"""with recursive {LQ}, {S.COMPLEX}, {S.LINES}, {SOUP}, ends_of as (select edge_id, min(b) as vertex1, max(b) as vertex2 from met join chain on chain.cid = a where b not in (select cid from inner_cell) group by 1)
    select edge_id, n_cells, vertex1, vertex2 from (select edge_id, count(*) as n_cells from chain group by 1) left join ends_of using (edge_id)""")
def l6_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return L.graph_edges(_valley_graph(spark, d), raster.LQ)


@query("l5_forced_vertices", f"""with recursive {LQ}, {S.COMPLEX}, {S.LINES}, {CELL}, value as (select c.cid, max(lq.v) as v from cell c join lq on lq.x in (c.cx // 2, (c.cx + 1) // 2) and lq.y in (c.cy // 2, (c.cy + 1) // 2) group by 1),
    w as (select cid, v, lag(v) over o as before, lead(v) over o as later from line join value using (cid) where dim = 0 window o as (partition by sid, side order by pos)), c as (select max(v) // 2 as level from lq)
    select distinct cid from w cross join c where before is null or later is null or (before < level) <> (v < level)""")
def l5_forced(spark: SparkSession, d: str) -> DataFrame:
    level = float(C.value_range(raster.lineitem_field(spark, d)).first()["high"] // 2)  # one number
    return L.forced_vertices(L.arc_geometry(_gradient(spark, d)[1], raster.LQ), _cell_values(spark, d), [level])


@query("t8_death_records", f"with recursive {LQ}, {S.COMPLEX}, {S.merges()} select sid, p.nid, s.value as saddle_value, m.value as value, persistence from pairs p join nodes s on s.nid = sid join nodes m on m.nid = p.nid")
def t8_deaths(spark: SparkSession, d: str) -> DataFrame:
    _, nodes, pairs = _pairs(spark, d)
    return L.death_records(cut(pairs), nodes)


@query("t10_sampled_soup", f"""with recursive {LQ}, {S.COMPLEX}, {S.LINES} select c.cid, max(lq.v) as high, min(lq.v) as low from (select distinct cid, cid % 91 as cx, cid // 91 as cy from line where dim = 1) c
    join lq on lq.x in (c.cx // 2, (c.cx + 1) // 2) and lq.y in (c.cy // 2, (c.cy + 1) // 2) group by 1""")
def t10_soup(spark: SparkSession, d: str) -> DataFrame:
    found = cut(G.cell_extremes(G.cells(spark, raster.LQ), raster.lineitem_field(spark, d), raster.LQ))
    soup = L.line_soup(L.arc_geometry(_gradient(spark, d)[1], raster.LQ, up=True))
    return L.sampled_soup(soup, {"high": found.select("cid", F.col("max_value").alias("value")), "low": found.select("cid", F.col("min_value").alias("value"))})


def _complex(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    field, grad = _gradient(spark, d)
    return cut(M.nodes(grad, field, raster.LQ)), cut(M.arcs(grad, field, raster.LQ))


@query("d12_violations", f"with recursive {LQ}, {S.GRAD} select a.dim, count(*) as n_cells, cast(sum(cast(a.is_critical as int)) as bigint) as n_critical, cast(sum(case when coalesce(case when a.is_critical then a.pair_cid = a.cid else b.pair_cid = a.cid and abs(a.dim - b.dim) = 1 end, false) then 0 else 1 end) as bigint) as n_wrong from grad a left join grad b on b.cid = a.pair_cid group by a.dim")
def d12_violations(spark: SparkSession, d: str) -> DataFrame:
    """Cells, critical cells and cells with a wrong partner, by dimension."""
    grad = _gradient(spark, d)[1]
    wrong = D.violations(grad).groupBy("dim").agg(F.count("*").alias("n_wrong"))
    every = grad.groupBy("dim").agg(F.count("*").alias("n_cells"), F.sum(F.col("is_critical").cast("long")).alias("n_critical"))
    return every.join(wrong, "dim", "left").fillna(0, ["n_wrong"])


@query("d14_critical_counts", f"with recursive {LQ}, {S.GRAD}, {S.NODES} select dim, bnd, count(*) as n from nodes group by dim, bnd")
def d14_counts(spark: SparkSession, d: str) -> DataFrame:
    return D.critical_counts(_gradient(spark, d)[1], raster.LQ)


@query("m5_ridge_arcs_only", f"with recursive {LQ}, {S.COMPLEX} select * from arcs where dim = 1")
def m5_ridges_only(spark: SparkSession, d: str) -> DataFrame:
    field, grad = _gradient(spark, d)
    return M.arcs(grad, field, raster.LQ, low=False)


@query("m13_limit", f"with recursive {LQ}, {S.COMPLEX}, {S.merges()} select cast(coalesce(max(persistence), 0) as double) as \"limit\" from (select persistence from pairs order by 1 limit greatest((select count(*) from ext) - 100, 0))")
def m13_limit(spark: SparkSession, d: str) -> DataFrame:
    """The least persistence at which 100 minima are left."""
    _, nodes, pairs = _pairs(spark, d)
    return M.limit_for_extrema(pairs, 100, nodes.where("dim = 0").count()).select(F.col("limit").cast("double").alias("limit"))


@query("m17_saddle_ends", f"with recursive {LQ}, {S.COMPLEX} select upper as sid, count(*) as n, min(lower) as first, max(lower) as last from arcs where dim = 0 group by 1")
def m17_saddle_ends(spark: SparkSession, d: str) -> DataFrame:
    found = M.saddle_ends(_complex(spark, d)[1], 0)
    return found.select("sid", F.size("ends").cast("long").alias("n"), F.array_min("ends").alias("first"), F.array_max("ends").alias("last"))


@query("m20_manifolds", f"with recursive {LQ}, {S.COMPLEX} select label as nid, ends.cid from ends join nodes on nodes.nid = label where nodes.dim = 2")
def m20_manifolds(spark: SparkSession, d: str) -> DataFrame:
    field, grad = _gradient(spark, d)
    return L.manifold(M.ends_up(grad, raster.LQ), M.nodes(grad, field, raster.LQ).where("dim = 2"))


@query("m21_summary", f"with recursive {LQ}, {S.GRAD}, {S.NODES} select dim, count(*) as n from nodes group by dim")
def m21_summary(spark: SparkSession, d: str) -> DataFrame:
    field, grad = _gradient(spark, d)
    return M.summary(M.nodes(grad, field, raster.LQ))


@query("m23_endpoints", f"with recursive {LQ}, {S.COMPLEX} select lower, upper, cast(sum(mult) as bigint) as n from arcs group by lower, upper")
def m23_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return L.endpoint_histogram(_complex(spark, d)[1])


@query("m26_incident_arcs", f"with recursive {LQ}, {S.COMPLEX} select n.nid, a.lower, a.upper, a.dim, a.mult, a.persistence from arcs a join nodes n on n.nid in (a.lower, a.upper) where n.dim = 1 and n.bnd = 0")
def m26_incident(spark: SparkSession, d: str) -> DataFrame:
    nodes, arcs = _complex(spark, d)
    return M.incident(arcs, nodes.where("dim = 1 and bnd = 0"))


@query("m27_arc_values", f"with recursive {LQ}, {S.COMPLEX} select a.lower, a.upper, a.dim, a.persistence, p.value as lower_value, q.value as upper_value, p.bnd as lower_bnd, q.bnd as upper_bnd, p.x as lower_x, p.y as lower_y, q.x as upper_x, q.y as upper_y from arcs a join nodes p on p.nid = lower join nodes q on q.nid = upper")
def m27_values(spark: SparkSession, d: str) -> DataFrame:
    nodes, arcs = _complex(spark, d)
    return M.arc_values(arcs, nodes).drop("mult", "lower_z", "upper_z")


@query("m29_representatives", f"with recursive {LQ}, {S.COMPLEX}, {S.merges()} select r.e1, r.e2, arg_min(s.sid, (svalue, s.sid)) as sid, min(svalue) as svalue from sorted s join joined r using (sid) group by 1, 2")
def m29_representatives(spark: SparkSession, d: str) -> DataFrame:
    nodes, arcs = _complex(spark, d)
    return M.representative_saddles(M.extremum_graph(arcs, nodes, raster.LQ, maxima=False))


@query("l2_filtered_arcs", f"with recursive {LQ}, {S.COMPLEX} select lower, upper, p.value as lower_value, q.value as upper_value from arcs join nodes p on p.nid = lower join nodes q on q.nid = upper where p.value >= (select max(v) // 4 from lq)")
def l2_filtered(spark: SparkSession, d: str) -> DataFrame:
    nodes, arcs = _complex(spark, d)
    low = C.value_range(raster.lineitem_field(spark, d)).first()["high"] // 4  # one number
    return M.filtered_arcs(arcs, nodes, low=low).select("lower", "upper", "lower_value", "upper_value")


#: cells with their highest vertex, lowest vertex, dimension and boundary class
OWNED = f"""{CELL}, owned as (select c.cid, cx % 2 + cy % 2 as dim, cast(cx in (0, 90) as int) + cast(cy in (0, 98) as int) as bnd, arg_max(lq.vid, (lq.v, lq.vid)) as vmax, arg_max(lq.vid, (-lq.v, lq.vid)) as gmax
    from cell c join lq on lq.x in (c.cx // 2, (c.cx + 1) // 2) and lq.y in (c.cy // 2, (c.cy + 1) // 2) group by c.cid, cx, cy)"""


def _split(grad: DataFrame, classes: DataFrame) -> DataFrame:
    """(owner, label, n_cells, euler, crossings): each class of each star, the alternating sum of its critical cells, and pairs that leave it."""
    other = classes.select(F.col("cid").alias("pair_cid"), F.col("label").alias("_other"))
    met = grad.join(classes, "cid").join(other, "pair_cid")
    sign = F.when(F.col("dim") % 2 == 0, 1).otherwise(-1)
    return met.groupBy("owner", "label").agg(F.count("*").alias("n_cells"), F.coalesce(F.sum(F.when(F.col("is_critical"), sign)), F.lit(0)).alias("euler"), F.sum((F.col("label") != F.col("_other")).cast("int")).alias("crossings"))


@query("d6_label_gradient", f"""with recursive {PEAKS}, {OWNED}, seen as (select c.cid, count(distinct p.label) > 1 as wide from cell c join lq on lq.x in (c.cx // 2, (c.cx + 1) // 2) and lq.y in (c.cy // 2, (c.cy + 1) // 2) join peak p using (vid) group by 1)
    select vmax as owner, cast(wide as int) * 4 + bnd as label, count(*) as n_cells, cast(sum(case when dim = 1 then -1 else 1 end) as bigint) as euler, 0 as crossings from owned join seen using (cid) group by 1, 2""")
def d6_label_gradient(spark: SparkSession, d: str) -> DataFrame:
    """The gradient that keeps apart the cells on the borders of the peak regions and those inside; sums of critical cells by class."""
    field = cut(raster.lineitem_field(spark, d))
    cells = G.cells(spark, raster.LQ)
    wide = cut(regions.boundary_map(cut(regions.basins(field, raster.LQ)), cells, raster.LQ).select("cid", (F.col("n_labels") > 1).cast("int").alias("label")))
    grad = D.by_labels(field, wide, raster.LQ)
    return _split(grad, wide.join(cells.select("cid", "bnd"), "cid").select("cid", (F.col("label") * 4 + F.col("bnd")).alias("label")))


@query("d7_two_fields", f"with {LQ}, {OWNED} select vmax as owner, gmax as label, count(*) as n_cells, cast(sum(case when dim = 1 then -1 else 1 end) as bigint) as euler, 0 as crossings from owned group by 1, 2")
def d7_two_fields(spark: SparkSession, d: str) -> DataFrame:
    """The gradient of the field and its negative at once; sums of critical cells by class."""
    field = cut(raster.lineitem_field(spark, d))
    other = cut(C.negate(field))
    classes = G.cell_extremes(G.cells(spark, raster.LQ).select("cid"), other, raster.LQ).select("cid", F.col("vmax").alias("label"))
    return _split(D.by_second_field(field, other, raster.LQ), classes)


@query("d11_ascending_dimensions", f"with recursive {LQ}, {S.COMPLEX}, {S.LINES}, marked as (select distinct cid from line where dim = 1) select g.cid, cast(case when g.is_critical and g.dim = 2 then 0 when m.cid is not null then 1 else 2 end as int) as asc_dim from grad g left join marked m using (cid)")
def d11_ascending(spark: SparkSession, d: str) -> DataFrame:
    return D.ascending_dimensions(_gradient(spark, d)[1], raster.LQ)


@query("d13_loops", f"""with recursive {LQ}, {NEAR}, best as (select vid, nvid, row_number() over (partition by vid order by nv desc, nvid desc) as r from near), ptr as (select vid, nvid as next from best where r = 1),
    ring as (select p.vid, least(p.vid, p.next) as loop from ptr p join ptr q on q.vid = p.next and q.next = p.vid),
    walk(vid, spot) as (select vid, vid from ptr union select w.vid, p.next from walk w join ptr p on p.vid = w.spot where w.spot not in (select vid from ring))
    select w.vid as id, r.loop, w.vid in (select vid from ring) as on_loop from walk w join ring r on r.vid = w.spot""")
def d13_loops(spark: SparkSession, d: str) -> DataFrame:
    """Every sample pointing to its highest neighbour: all chains run into pairs that point to each other."""
    near = G.neighbours(raster.lineitem_field(spark, d), raster.LQ)
    best = near.groupBy("vid").agg(F.max(G.order_of("nvalue", "nvid"))["i"].alias("next"))
    return iterate.loops(best.select(F.col("vid").alias("id"), "next"))


@query("r19_restricted_regions", f"""with recursive {LQ}, {CELL}, value as (select c.cid, c.cx, c.cy, max(lq.v) as v from cell c join lq on lq.x in (c.cx // 2, (c.cx + 1) // 2) and lq.y in (c.cy // 2, (c.cy + 1) // 2) where c.cx % 2 + c.cy % 2 = 1 group by 1, 2, 3),
    e as (select * from value where v > (select avg(v) from lq)),
    link as (select a.cid, b.cid as ncid, row_number() over (partition by a.cid order by b.v desc, b.cid desc) as r from e a join e b on a.cid <> b.cid and (b.v, b.cid) > (a.v, a.cid) and
        ((abs(a.cx - b.cx) = 1 and abs(a.cy - b.cy) = 1) or (a.cx = b.cx and abs(a.cy - b.cy) = 2 and a.cx % 2 = 1) or (a.cy = b.cy and abs(a.cx - b.cx) = 2 and a.cy % 2 = 1))),
    up as (select e.cid, coalesce(l.ncid, e.cid) as next from e left join link l on l.cid = e.cid and l.r = 1),
    walk(cid, spot) as (select cid, cid from up union select w.cid, u.next from walk w join up u on u.cid = w.spot) select w.cid, w.spot as label from walk w join up u on u.cid = w.spot and u.next = u.cid""")
def r19_restricted(spark: SparkSession, d: str) -> DataFrame:
    """Regions of the edges above the mean, grown inside these edges alone."""
    field = cut(raster.lineitem_field(spark, d))
    mean = field.agg(F.avg("value").alias("mean"))
    found = G.cell_extremes(G.cells(spark, raster.LQ, [1]), field, raster.LQ).select("cid", F.col("max_value").alias("value"))
    return regions.restricted_regions(found.join(F.broadcast(mean), F.col("value") > F.col("mean")).select("cid", "value"), raster.LQ)  # one row


@query("l7_region_graph", f"with recursive {PEAKS}, s as (select label, count(*) as area from peak group by 1), b as (select a.label as label1, b.label as label2, count(*) as n_edges from near n join peak a on a.vid = n.vid join peak b on b.vid = n.nvid where a.label < b.label group by 1, 2) select label1, label2, n_edges, p.area as area1, q.area as area2 from b join s p on p.label = label1 join s q on q.label = label2")
def l7_region_graph(spark: SparkSession, d: str) -> DataFrame:
    """The peak regions as a graph: each two with a common border, its length and both areas."""
    areas, edges, _ = regions.region_graph(cut(regions.basins(raster.lineitem_field(spark, d), raster.LQ)), raster.LQ)
    for i in (1, 2):
        edges = edges.join(areas.select(F.col("label").alias(f"label{i}"), F.col("area").alias(f"area{i}")), f"label{i}")
    return edges.select("label1", "label2", "n_edges", "area1", "area2")


@query("p14_geodesic_density", f"""with recursive {LQ}, m as (select avg(v)::double as mean from lq), open as (select vid, x, y, v::double as v from lq, m where v > mean / 2),
    step as (select a.vid, b.vid as nvid, sqrt(abs(a.x - b.x) + abs(a.y - b.y)) * (1 + (mean - least(a.v, b.v, mean)) / (mean / 2)) as cost from open a join open b on greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1 cross join m),
    walk(seed, vid, dist) as (select vid, vid, 0::double from open where vid % 23 = 0 union all select w.seed, s.nvid, w.dist + s.cost from walk w join step s on s.vid = w.vid where w.dist + s.cost <= 3.0)
    select seed, count(distinct vid) as volume, 29 as free, count(distinct vid) / 29.0::double as density from walk group by seed""")
def p14_density(spark: SparkSession, d: str) -> DataFrame:
    """How much a walk of length 3 reaches through samples over half the mean, slowed down under the mean."""
    field = cut(raster.lineitem_field(spark, d))
    mean = float(field.agg(F.avg("value")).first()[0])  # one number
    return regions.geodesic_density(field.where("vid % 23 = 0").select("vid"), field, raster.LQ, 3.0, mean / 2, mean)


VALUE = "value as (select c.cid, c.cx, c.cy, max(lq.v) as v, avg(lq.v) as mean, count(*) as n, cast(sum(lq.v) as bigint) as total from cell c join lq on lq.x in (c.cx // 2, (c.cx + 1) // 2) and lq.y in (c.cy // 2, (c.cy + 1) // 2) group by 1, 2, 3)"


@query("g13_cell_vertices", f"with {LQ}, {CELL}, {VALUE} select cid, n, total, round(mean, 2) as mean from value")
def g13_vertices(spark: SparkSession, d: str) -> DataFrame:
    """The vertices of every cell: their number, sum and mean."""
    met = G.cell_vertices(G.cells(spark, raster.LQ).select("cid"), raster.LQ).join(raster.lineitem_field(spark, d).select("vid", "value"), "vid")
    return met.groupBy("cid").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.round(F.avg("value"), 2).alias("mean"))


@query("f5_magnitude", f"""with {LQ}, k(dx, dy, w) as (values {", ".join(f"({x}, {y}, {x * (2 - abs(y))})" for x in (-1, 1) for y in (-1, 0, 1))}),
    s as (select a.vid, sum(k.w * b.v) as gx, sum(k.w * c.v) as gy from lq a cross join k join lq b on b.x = least(greatest(a.x + k.dx, 0), 45) and b.y = least(greatest(a.y + k.dy, 0), 49)
    join lq c on c.x = least(greatest(a.x + k.dy, 0), 45) and c.y = least(greatest(a.y + k.dx, 0), 49) group by a.vid) select vid, round(sqrt(gx::double * gx::double + gy::double * gy::double), 1) as value from s""")
def f5_magnitude(spark: SparkSession, d: str) -> DataFrame:
    return C.magnitude(raster.lineitem_field(spark, d), raster.LQ).select("vid", F.round("value", 1).alias("value"))


@query("f8_weighed", f"""with {LQ}, n as (select vid, v, (v - min(v) over ())::double / (max(v) over () - min(v) over ()) as s from lq) select vid, round(sqrt(s), 6) as root, round(pow(s, 2) * (s + 0.001), 6) as value from n""")
def f8_weighed(spark: SparkSession, d: str) -> DataFrame:
    """The scaled field remapped by a gamma, and weighed by its own square."""
    field = cut(raster.lineitem_field(spark, d).withColumn("value", F.col("value").cast("double")))
    scaled = cut(C.normalised(field))
    square = scaled.withColumn("value", C.remap(F.col("value"), 2.0))
    both = C.sample(scaled.select("vid", C.remap(F.col("value"), 0.5).alias("root")), {"weighed": C.weigh(square, field)})
    return both.select("vid", F.round("root", 6).alias("root"), F.round("weighed", 6).alias("value"))


@query("d8_masked_minima", f"with {LQ}, {NEAR}, m as (select vid, v from lq where v > (select avg(v) from lq)) select m.vid % 46 * 2 + m.vid // 46 * 2 * 91 as cid from m where not exists (select 1 from near n join m o on o.vid = n.nvid where n.vid = m.vid and (n.nv, n.nvid) < (m.v, m.vid))")
def d8_masked_minima(spark: SparkSession, d: str) -> DataFrame:
    """The minima of the gradient inside the samples above the mean."""
    field, mask = _mask(spark, d)
    return D.restricted(field, mask, raster.LQ).where("is_critical and dim = 0").select("cid")


@query("r13_certain_regions", f"""with recursive {PEAKS}, climb(vid, spot) as (select vid, vid from lq union select c.vid, n.nvid from climb c join near n on n.vid = c.spot where (n.nv, n.nvid) > (n.v, n.vid)),
    tops as (select c.vid, count(distinct p.label) as n, min(p.label) as label from climb c join peak p on p.vid = c.spot and p.label = c.spot group by 1) select vid, label from tops where n = 1""")
def r13_certain(spark: SparkSession, d: str) -> DataFrame:
    """Samples from which every rising path, steepest or not, ends at the same peak."""
    return regions.certain_regions(cut(raster.lineitem_field(spark, d)), raster.LQ)


@query("r16_blobs", f"with recursive {PEAKS}, big as (select vid from lq where v > (select 2 * avg(v) from lq)) select peak.vid, peak.label from peak join lq using (vid) where v > 0 and peak.label in (select vid from big)")
def r16_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Samples over 0 in the regions of the peaks above twice the mean."""
    field = cut(raster.lineitem_field(spark, d))
    mean = field.agg(F.avg("value").alias("mean"))
    high = field.join(F.broadcast(mean), F.col("value") > 2 * F.col("mean")).select("vid")  # one row
    return L.blobs(regions.basins(field, raster.LQ), field, high, raster.LQ)


JOINED = "joined as (select lower as sid, min(upper) as e1, max(upper) as e2 from arcs where dim = 1 group by 1 having min(upper) <> max(upper))"


@query("l16_ligaments", f"with recursive {LQ}, {S.COMPLEX}, {JOINED} select e1, e2, sid, value as svalue from joined join nodes on nid = sid where value >= (select avg(v) from lq)")
def l16_ligaments(spark: SparkSession, d: str) -> DataFrame:
    nodes, arcs = _complex(spark, d)
    mean = float(raster.lineitem_field(spark, d).agg(F.avg("value")).first()[0])  # one number
    return M.ligaments(arcs, nodes, raster.LQ, mean)


@query("l21_ligament_lines", f"""with recursive {LQ}, {S.COMPLEX}, {JOINED}, {S.LINES}, fin as (select sid, side, max(pos) as top, arg_max(cid, pos) as peak from line where dim = 1 group by 1, 2),
    walk as (select j.sid, e1, e2, case when f.peak = e1 then l.pos * -1 else l.pos end as spot, l.cid from joined j join fin f on f.sid = j.sid join line l on l.dim = 1 and l.sid = f.sid and l.side = f.side where f.peak in (e1, e2) and not (f.peak = e2 and l.pos = 0))
    select sid, e1, e2, row_number() over (partition by sid order by spot) - 1 as pos, cid from walk""")
def l21_ligament_lines(spark: SparkSession, d: str) -> DataFrame:
    """From maximum to maximum over each saddle between two of them."""
    grad, (nodes, _) = _gradient(spark, d)[1], _complex(spark, d)
    return features.ligament_lines(cut(merged.base_lines(grad, raster.LQ)), nodes, raster.LQ)


@query("l18_voids", f"with recursive {LQ}, {S.COMPLEX} select n.nid, count(distinct b.upper) as n_maxima from nodes n join arcs a on a.lower = n.nid and a.dim = 0 join arcs b on b.lower = a.upper and b.dim = 1 where n.dim = 0 and n.bnd = 0 group by 1")
def l18_voids(spark: SparkSession, d: str) -> DataFrame:
    """Inner minima and the number of maxima around them."""
    nodes, arcs = _complex(spark, d)
    return features.voids(arcs, nodes, raster.LQ).select("nid", "n_maxima")


@query("l8_ridge_graph", f"""with recursive {LQ}, {S.COMPLEX}, {S.LINES}, {SOUP.replace("line where dim = 0", "line where dim = 1")}, tips as (select edge_id, b from met join chain on chain.cid = a where b not in (select cid from inner_cell))
    select edge_id as line_id, min(b) as vertex1, max(b) as vertex2, any_value(n_cells) as n_cells from tips join (select edge_id, count(*) as n_cells from chain group by 1) using (edge_id) group by 1""")
def l8_ridge_graph(spark: SparkSession, d: str) -> DataFrame:
    """The edges of the ridge lines' graph, as ordered lines between two vertices."""
    soup = L.line_soup(L.arc_geometry(_gradient(spark, d)[1], raster.LQ, up=True))
    return features.ridge_graph(cut(soup), raster.LQ)[1].where("line_id >= 0").select("line_id", "vertex1", "vertex2", "n_cells")


@query("l9_line_graph", f"with recursive {LQ}, {S.COMPLEX}, {JOINED}, tips as (select e1 as vertex, sid from joined union select e2, sid from joined) select a.vertex, a.sid as line1, b.sid as line2 from tips a join tips b on b.vertex = a.vertex and a.sid < b.sid union all select vertex, min(sid), -1 from tips group by 1 having count(*) = 1")
def l9_line_graph(spark: SparkSession, d: str) -> DataFrame:
    """Ridges that share a maximum."""
    nodes, arcs = _complex(spark, d)
    return lines.line_graph(M.extremum_graph(arcs, nodes, raster.LQ).select(F.col("sid").alias("line_id"), F.col("e1").alias("vertex1"), F.col("e2").alias("vertex2")))


@query("l10_line_ends", f"with recursive {LQ}, {S.COMPLEX}, {JOINED} select sid as line_id, e1 as vertex1, e2 as vertex2 from joined")
def l10_line_ends(spark: SparkSession, d: str) -> DataFrame:
    """The ridges' ends again, from their line graph."""
    return L.line_saddle_ends(l9_line_graph(spark, d))


@query("l13_set_to_set", f"""with recursive {LQ}, {NEAR}, {S.nearest('select vid from lq where vid % 97 = 0')}, goal as (select vertex from nearest where vertex % 89 = 1 and dist = (select max(dist) from nearest where vertex % 89 = 1) order by vertex limit 1),
    back(vertex, hop) as (select vertex, 0 from goal union all select n.prev, hop + 1 from back b join nearest n using (vertex) where n.prev is not null) select (select max(hop) from back) - hop as pos, vertex, dist from back join nearest using (vertex)""")
def l13_set_to_set(spark: SparkSession, d: str) -> DataFrame:
    """The path from a set of samples to the one of another set that is farthest from it."""
    edges = _graph(spark, d)
    sources = edges.select(F.col("src").alias("vertex")).where("vertex % 97 = 0").distinct()
    far = iterate.nearest_source(edges, sources).where("vertex % 89 = 1").orderBy(F.desc("dist"), "vertex").limit(1).select("vertex")
    return iterate.shortest_path(edges, sources, cut(far))


@query("l17_apart", """with p as (select p_partkey % 7 as line_id, p_partkey as pos, p_size as x, round(p_retailprice) as y from part) select line_id, pos from p a where not exists (select 1 from p b where b.line_id <> a.line_id and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 1)""")
def l17_apart(spark: SparkSession, d: str) -> DataFrame:
    """Points without a point of another line within one."""
    points = table(spark, d, "part").select((F.col("p_partkey") % 7).alias("line_id"), F.col("p_partkey").alias("pos"), F.col("p_size").cast("double").alias("x"), F.round("p_retailprice").alias("y"), F.lit(0.0).alias("z"))
    return lines.apart(points, 1.0).select("line_id", "pos")


@query("i4_digitised", f"""with {PL}, b as (select line_id, pos, least(floor(least(greatest(x / 24, 0), 39)), 38) as bx, least(floor(least(greatest(y / 10 + 20, 0), 39)), 38) as b_y from pl),
    s as (select *, coalesce(abs(bx - lag(bx) over w) + abs(b_y - lag(b_y) over w), 0) as n from b window w as (partition by line_id order by pos)) select line_id, cast(1 + 2 * sum(n) as bigint) as n_cells, cast(arg_max(2 * bx + 1 + 79 * (2 * b_y + 1), pos) as bigint) as last from s group by 1""")
def i4_digitised(spark: SparkSession, d: str) -> DataFrame:
    """The cells that the users' lines pass through on a grid of 40 x 40 samples: their number and the last one."""
    at = _lines(spark, d).select(F.col("line_id").alias("pid"), F.col("pos").alias("step"), (F.col("x") / 24).alias("px"), (F.col("y") / 10 + 20).alias("py"))
    return advect.digitised(at, G.GridMeta(40, 40)).groupBy(F.col("pid").alias("line_id")).agg(F.count("*").alias("n_cells"), F.max_by("cid", "pos").alias("last"))


@query("i2_labels")
def i2_labels(spark: SparkSession, d: str) -> DataFrame:
    """The certain regions of the peaks, and where the integral lines of the other samples end."""
    field = cut(raster.lineitem_field(spark, d))
    return advect.integration_labels(field, cut(regions.certain_regions(field, raster.LQ)), raster.LQ, steps=3, rounds=2)


@query("m28_descriptions", f"with recursive {LQ}, {S.GRAD}, {S.NODES}, {CELL}, {VALUE} select nid, case when dim = 0 then nid % 91 // 2 + nid // 91 // 2 * 46 end as vid, dim, bnd, x, y, round(mean, 2) as value from nodes join value using (cid)")
def m28_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Grid id, dimension, boundary class, position and interpolated value of every critical cell."""
    field, grad = _gradient(spark, d)
    found = features.described(grad.where("is_critical").select(F.col("cid").alias("nid")), raster.LQ, field, "nid")
    return found.select("nid", "vid", "dim", "bnd", "x", "y", F.round("value", 2).alias("value"))


#: the volume of lineitem's counts and the peaks of its steepest paths
VOLUME = """raw as (select date_diff('day', date '1992-01-01', cast(l_shipdate as date)) // 112 - 9 as x, (cast(l_quantity as bigint) - 1) // 5 as y, cast(round(l_discount * 100) as bigint) as z, count(*) as v from lineitem group by 1, 2, 3),
lqd as (select g as vid, g % 24 as x, g // 24 % 10 as y, g // 240 as z, coalesce(v, 0) as v from range(2640) t(g) left join raw on raw.x = g % 24 and raw.y = g // 24 % 10 and raw.z = g // 240),
near3 as (select a.vid, a.v, b.vid as nvid, b.v as nv, a.x, a.y, a.z, b.x as bx, b.y as b_y, b.z as bz from lqd a join lqd b on abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1),
ptr3 as (select vid, case when (max(struct_pack(v := nv, i := nvid))) > struct_pack(v := any_value(v), i := vid) then max(struct_pack(v := nv, i := nvid)).i else vid end as next from near3 group by vid),
walk3(vid, top) as (select vid, vid from ptr3 union select w.vid, p.next from walk3 w join ptr3 p on p.vid = w.top),
peak3 as (select w.vid, w.top as label from walk3 w join ptr3 p on p.vid = w.top and p.next = p.vid)"""


@query("l20_surfaces", f"""with recursive {VOLUME} select least(p.label, q.label) as label1, greatest(p.label, q.label) as label2, count(*) as n_quads from near3 n join peak3 p on p.vid = n.vid join peak3 q on q.vid = n.nvid
    where n.vid < n.nvid and p.label <> q.label and (n.x <> n.bx or n.x between 1 and 22) and (n.y <> n.b_y or n.y between 1 and 8) and (n.z <> n.bz or n.z between 1 and 9) group by 1, 2""")
def l20_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """The surfaces between the peak regions of the volume, and the number of their quads."""
    labels = cut(regions.basins(raster.lineitem_volume(spark, d), raster.LQD))
    return surfaces.separating_surfaces(labels, raster.LQD, times=1).select("label1", "label2", "n_quads")


@query("d9_convergent", f"""with {LQ}, {NEAR} select count(distinct vid) as n_samples, cast(count(distinct vid) filter (vid not in (select vid from near where (nv, nvid) < (v, vid))) as bigint) as n_minima, cast(count(distinct vid) as double) as shares, 1 as euler, 0 as n_wrong from lq""")
def d9_convergent(spark: SparkSession, d: str) -> DataFrame:
    """The gradient by the shares of destinations: samples, minima, the sum of all shares, the alternating sum of critical cells, wrong partners."""
    grad, shares = D.convergent_gradient(raster.lineitem_field(spark, d), raster.LQ)
    grad = cut(grad)
    told = cut(shares).agg(F.countDistinct("vid").alias("n_samples"), F.countDistinct("dest").alias("n_minima"), F.round(F.sum("share"), 3).alias("shares"))
    euler = grad.where("is_critical").agg(F.sum(F.when(F.col("dim") == 1, -1).otherwise(1)).alias("euler"))
    return told.crossJoin(euler).crossJoin(D.violations(grad).agg(F.count("*").alias("n_wrong")))  # one row each


#: a grid that grows with the table: users by six-hour periods, the users' cents as values
USERS = """size as (select max(user_id) + 1 as nx from events), rawu as (select user_id as x, date_diff('second', timestamp '2024-01-01', ts) // 21600 as y, cast(sum(cast(round(value * 100) as bigint)) as bigint) as v from events group by 1, 2),
us as (select g as vid, nx, g % nx as x, g // nx as y, coalesce(v, 0) as v from (select unnest(range(nx * 120)) as g, nx from size) left join rawu on rawu.x = g % nx and rawu.y = g // nx),
nearu as (select a.vid, a.v, a.nx, b.vid as nvid, b.v as nv from us a join us b on b.vid = a.vid + 1 and a.x + 1 < a.nx union all select b.vid, b.v, b.nx, a.vid, a.v from us a join us b on b.vid = a.vid + 1 and a.x + 1 < a.nx
    union all select a.vid, a.v, a.nx, b.vid, b.v from us a join us b on b.vid = a.vid + a.nx union all select b.vid, b.v, b.nx, a.vid, a.v from us a join us b on b.vid = a.vid + a.nx)"""


@query("d4_users_minima", f"with {USERS} select vid % nx * 2 + vid // nx * 2 * (2 * nx - 1) as cid, vid as owner from nearu group by vid, nx having max(cast((nv, nvid) < (v, vid) as int)) = 0")
def d4_users_minima(spark: SparkSession, d: str) -> DataFrame:
    """Minima of the discrete gradient on the grid of users and periods, whose tiles grow in number with the users."""
    field, meta = raster.user_field(spark, d)
    return D.discrete_gradient(field, meta).where("is_critical and dim = 0").select("cid", "owner")


@query("r8_users_peaks", f"""with recursive {USERS}, best as (select vid, max(struct_pack(v := nv, i := nvid)) as b, max(struct_pack(v := v, i := vid)) as own from nearu group by vid), ptr as (select vid, case when b > own then b.i else vid end as next from best),
    walk(vid, top) as (select vid, vid from ptr union select w.vid, p.next from walk w join ptr p on p.vid = w.top), peak as (select w.vid, w.top as label from walk w join ptr p on p.vid = w.top and p.next = p.vid)
    select label, count(*) as n_cells, cast(sum(v) as bigint) as total from peak join us using (vid) group by label""")
def r8_users_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Cells and cents of every peak region of the users' grid."""
    field, meta = raster.user_field(spark, d)
    field = cut(field)
    return regions.basins(field, meta).join(field, "vid").groupBy("label").agg(F.count("*").alias("n_cells"), F.sum("value").alias("total"))


def entry(spark: SparkSession) -> DataFrame:
    return revenue_by_peak(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    from isoweave.plans import elementary  # noqa: F401  (registers its queries)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from isoweave.plans import elementary  # noqa: F401

    return dict(ORACLES)
