"""SQL of the discrete gradient, the complex and its merges over the table lq (vid, x, y, v) of the revenue field."""

#: In the plane the cells of a lower star lie on a ring of four edges (k) and the four quads after them.  A run of cells is paired outwards
#: from its lowest edge; where the whole ring is in the star, the quad with the largest lowest vertex is left over (qn: its place among ties).
GRAD = """
ring(k, ex, ey, qx, qy, qn) as (values (0, 1, 0, 1, 1, 7), (1, 0, 1, -1, 1, 2), (2, -1, 0, -1, -1, 0), (3, 0, -1, 1, -1, 5)),
ranked as (select vid, x, y, v, row_number() over (order by v, vid) as r from lq),
e as (select a.vid, k, b.r as low, a.x * 2 + ex + 91 * (a.y * 2 + ey) as cid from ranked a cross join ring join ranked b on b.x = a.x + ex and b.y = a.y + ey and b.r < a.r),
q0 as (select a.vid, ring.k, least(e1.low, e2.low, b.r) as low, qn, a.x * 2 + qx + 91 * (a.y * 2 + qy) as cid from ranked a cross join ring
    join e e1 on e1.vid = a.vid and e1.k = ring.k join e e2 on e2.vid = a.vid and e2.k = (ring.k + 1) % 4 join ranked b on b.x = a.x + qx and b.y = a.y + qy and b.r < a.r),
q as (select *, count(*) over (partition by vid) = 4 and row_number() over (partition by vid order by low desc, qn desc) = 1 as spare from q0),
run(vid, src, low, k, way, via) as (select vid, k, low, k, way, cast(null as bigint) from e cross join (values (1), (-1)) w(way)
    union all select r.vid, r.src, r.low, (r.k + r.way + 4) % 4, r.way, q.cid from run r join q on q.vid = r.vid and not q.spare and q.k = case when r.way = 1 then r.k else (r.k + 3) % 4 end where (r.k + r.way + 4) % 4 <> r.src),
root as (select vid, k, src, via from (select *, row_number() over (partition by vid, k order by low, way) as n from run) where n = 1),
steep as (select vid, k, cid from (select *, row_number() over (partition by vid order by low) as n from e) where n = 1),
edge_pair as (select e.vid, e.cid, case when root.src = e.k then case when s.k = e.k then a.x * 2 + 91 * a.y * 2 else e.cid end else root.via end as pair_cid
    from e join root on root.vid = e.vid and root.k = e.k join steep s on s.vid = e.vid join ranked a on a.vid = e.vid),
grad as materialized (select a.x * 2 + 91 * a.y * 2 as cid, 0 as dim, coalesce(s.cid, a.x * 2 + 91 * a.y * 2) as pair_cid, s.cid is null as is_critical, a.vid as owner from ranked a left join steep s on s.vid = a.vid
    union all select cid, 1, pair_cid, cid = pair_cid, vid from edge_pair
    union all select q.cid, 2, case when q.spare then q.cid else p.cid end, q.spare, q.vid from q left join edge_pair p on p.pair_cid = q.cid)
"""
NODES = """
nodes as (select cid as nid, cid, dim, cast(cid % 91 in (0, 90) as int) + cast(cid // 91 in (0, 98) as int) as bnd, lq.v as value, cid % 91 * 0.5::double as x, cid // 91 * 0.5::double as y, 0.0::double as z
    from grad join lq on lq.vid = owner where is_critical)
"""
#: where each vertex and each quad flows to; a step across the paired cell mirrors the id at it
ENDS = """
step as (select cid, dim, case when is_critical then cid when dim = 0 then 2 * pair_cid - cid when abs(pair_cid - cid) = 1 and (2 * (pair_cid % 91) - cid % 91) not between 0 and 90 then -1
    when abs(pair_cid - cid) = 91 and (2 * (pair_cid // 91) - cid // 91) not between 0 and 98 then -1 else 2 * pair_cid - cid end as next from grad where dim <> 1),
flow(cid, spot) as (select cid, cid from step union select f.cid, s.next from flow f join step s on s.cid = f.spot where s.next >= 0),
ends as (select f.cid, f.spot as label from flow f join step s on s.cid = f.spot and s.next = s.cid)
"""
ARCS = """
arc_ends as (select n.cid as saddle, d.label, case when d.label in (select cid from nodes where dim = 0) then 0 else 1 end as dim from nodes n join (values (1), (-1), (91), (-91)) o(o) on true
    join ends d on d.cid = n.cid + o where n.dim = 1 and (abs(o) = 91 or n.cid % 91 + o between 0 and 90)),
arcs as (select case when a.dim = 0 then label else saddle end as lower, case when a.dim = 0 then saddle else label end as upper, a.dim, count(*) as mult, abs(any_value(m.value) - any_value(n.value)) as persistence
    from arc_ends a join nodes n on n.nid = saddle join nodes m on m.nid = label group by 1, 2, 3)
"""
COMPLEX = f"{GRAD}, {NODES}, {ENDS}, {ARCS}"


def merges(maxima: bool = False) -> str:
    """Pairs by the elder rule: saddles in order join two components, and the extremum of the younger one dies.

    The list ``lab`` holds for each extremum, by its rank from the most extreme one, the rank of its component's eldest.
    """
    dim, way, saddle, end = (2, "desc", "lower", "upper") if maxima else (0, "", "upper", "lower")
    return f"""
ext as (select nid, value, row_number() over (order by value {way}, nid {way}) as r from nodes where dim = {dim}),
joined as (select {saddle} as sid, min({end}) as e1, max({end}) as e2 from arcs where dim = {1 if maxima else 0} group by 1 having min({end}) <> max({end})),
sorted as (select sid, n.value as svalue, p.r as r1, q.r as r2, row_number() over (order by n.value {way}, sid {way}) as i from joined join nodes n on n.nid = sid join ext p on p.nid = e1 join ext q on q.nid = e2),
grown(i, lab, dead, other, sid, svalue) as (select 0::bigint, (select list(r order by r) from ext), null::bigint, null::bigint, null::bigint, null::bigint
    union all select s.i, list_transform(g.lab, lambda t: case when t = greatest(g.lab[s.r1], g.lab[s.r2]) then least(g.lab[s.r1], g.lab[s.r2]) else t end),
        case when g.lab[s.r1] <> g.lab[s.r2] then greatest(g.lab[s.r1], g.lab[s.r2]) end, case when g.lab[s.r1] < g.lab[s.r2] then s.r1 else s.r2 end, s.sid, s.svalue from grown g join sorted s on s.i = g.i + 1),
pairs as (select d.nid, o.nid as into, sid, abs(svalue - d.value) as persistence from grown join ext d on d.r = dead join ext o on o.r = other)"""



#: cells from every saddle along the paths from its sides (dim 0: down, 1: up), one paired cell and one further cell a step
LINES = """
tip as (select n.cid as sid, n.cid + o as side, s.dim // 2 as dim from nodes n join (values (1), (-1), (91), (-91)) o(o) on true join step s on s.cid = n.cid + o where n.dim = 1 and (abs(o) = 91 or n.cid % 91 + o between 0 and 90)),
path(sid, side, dim, pos, cid) as (select sid, side, dim, 1::bigint, side from tip union all select p.sid, p.side, p.dim, p.pos + 2, s.next from path p join step s on s.cid = p.cid where s.next <> p.cid and p.cid >= 0),
line as (select sid, side, dim, 0::bigint as pos, sid as cid from tip union all select sid, side, dim, pos, cid from path where cid >= 0
    union all select p.sid, p.side, p.dim, p.pos + 1, g.pair_cid from path p join grad g on g.cid = p.cid where not g.is_critical)
"""
def nearest(sources: str) -> str:
    """Relaxation in rounds over the face neighbours; a tie keeps the earlier round's row, then the smaller previous vertex."""
    return f"""
reached(i, vertex, source, prev, dist, fresh) as (select 0, vid, vid, cast(null as bigint), cast(0 as hugeint), 1 from ({sources})
    union all select i + 1, vertex, source, prev, dist, new from (
        select *, row_number() over (partition by vertex order by dist, source, new, prev) as n from (
            select i, vertex, source, prev, dist, 0 as new from reached union all
            select i, e.nvid, source, r.vertex, dist + abs(e.v - e.nv), 1 from reached r join near e on e.vid = r.vertex where r.fresh = 1)) where n = 1 and (select max(fresh) from reached) = 1),
nearest as (select vertex, source, prev, cast(dist as bigint) as dist from reached where i = (select max(i) from reached))"""


def hierarchy(share: float = 0.1, frozen: str = "select null::bigint where false", weighted: bool = True) -> str:
    """Cancellations one by one: each step takes the first arc of all and writes all living arcs again.

    ``hier`` has kind 0 for a living arc of a step and kind 1 for the arc that the step cancels; ``gone`` and ``alive`` are what is left of it.
    """
    return f"""
lim as (select (max(v) - min(v)) * {share}::double as cancel from lq), still(nid) as ({frozen}),
placed as (select lower as low, upper as up, a.dim, mult, '-infinity'::double as born, p.value as lv, q.value as uv, p.bnd = q.bnd and lower not in (select nid from still) and upper not in (select nid from still) as same
    from arcs a join nodes p on p.nid = lower join nodes q on q.nid = upper),
class as (select nid, value, case when nid in (select nid from still) then null else bnd end as bnd from nodes),
hier(step, kind, low, up, dim, mult, born, lv, uv, same) as (select 0, 0, * from placed union all select * from (
    with own as (select * from hier where kind = 0), ups as (select low, sum(mult) as u from own group by 1), downs as (select up, sum(mult) as d from own group by 1),
    pick as (select own.step, own.low as pl, own.up as pu, dim, greatest(uv - lv, born) as time, lv, uv from own join ups using (low) join downs using (up) where mult = 1 and same and uv - lv <= (select cancel from lim)
        order by uv - lv, {"(u - 1) * (d - 1), " if weighted else ""}own.low, own.up limit 1),
    above as (select up as x, own.uv, mult, time from own join pick on low = pl where up <> pu), below as (select own.low as w, own.lv, own.mult, own.dim from own join pick on up = pu where low <> pl),
    every as (select low, up, own.dim, mult, born, own.lv, own.uv, same from own cross join pick where low not in (pl, pu) and up not in (pl, pu)
        union all select w, x, dim, below.mult * above.mult, time, below.lv, above.uv, coalesce(c.bnd = e.bnd, false) from below cross join above join class c on c.nid = w join class e on e.nid = x)
    select (select step + 1 from pick), 0, low, up, dim, cast(sum(mult) as bigint), max(born), any_value(lv), any_value(uv), any_value(same) from every group by low, up, dim
    union all select step + 1, 1, pl, pu, dim, 1, time, lv, uv, true from pick)),
gone as (select step as round, low as lower, up as upper, dim, cast(uv - lv as double) as persistence, born as time from hier where kind = 1),
alive as (select low as lower, up as upper, dim, mult, born, uv - lv as persistence from hier where kind = 0 and step = (select coalesce(max(round), 0) from gone))"""


#: Lines of living arcs, from the upper node to the lower one, after ``hier``, ``gone``, ``alive`` and ``line``.  The ways of two nodes are their given lines and,
#: for each cancellation, the product of the ways that it joined; a line is taken apart until only given lines are left, and steps back are dropped.
MERGED_LINES = """
given as (select dim, sid, side, arg_max(cid, pos) as fin, max(pos) as top from line group by all having arg_max(cid, pos) in (select nid from nodes)),
base as (select case when g.dim = 0 then fin else g.sid end as lower, case when g.dim = 0 then g.sid else fin end as upper, g.side, case when g.dim = 0 then list(l.cid order by l.pos) else list(l.cid order by l.pos desc) end as cells
    from given g join line l on l.dim = g.dim and l.sid = g.sid and l.side = g.side group by g.dim, g.sid, g.side, fin),
grown_arcs as (select g.round, w.low as lower, x.up as upper, w.mult * x.mult as n, g.lower as vl, g.upper as vu, w.mult as inside
    from gone g join hier x on x.kind = 0 and x.step = g.round - 1 and x.low = g.lower and x.up <> g.upper join hier w on w.kind = 0 and w.step = g.round - 1 and w.up = g.upper and w.low <> g.lower),
options as (select *, coalesce(sum(n) over (partition by lower, upper order by round, side, vl, vu rows between unbounded preceding and 1 preceding), 0) as begun from
    (select -1 as round, lower, upper, 1 as n, side, null::bigint as vl, null::bigint as vu, null::bigint as inside from base union all select round, lower, upper, n, null, vl, vu, inside from grown_arcs)),
tokens(lower, upper, number, place, a, b, way, ahead) as (select lower, upper, i, []::integer[], lower, upper, i, true from (select lower, upper, unnest(range(mult)) as i from alive)
    union all select t.lower, t.upper, t.number, list_append(t.place, case when t.ahead then k else 2 - k end), case k when 2 then t.a else o.vl end, case k when 0 then t.b else o.vu end,
        case k when 0 then (t.way - o.begun) // o.inside when 1 then 0 else (t.way - o.begun) % o.inside end, case k when 1 then not t.ahead else t.ahead end
    from tokens t join options o on o.lower = t.a and o.upper = t.b and t.way >= o.begun and t.way < o.begun + o.n and o.side is null cross join (values (0), (1), (2)) k(k)),
walked_lines as (select t.lower, t.upper, t.number, flatten(list(case when t.ahead then b.cells else list_reverse(b.cells) end order by t.place)) as cells
    from tokens t join options o on o.lower = t.a and o.upper = t.b and t.way = o.begun and o.side is not null join base b on b.lower = t.a and b.upper = t.b and b.side = o.side group by t.lower, t.upper, t.number),
short_lines as (select lower, upper, number, list_reduce(list_prepend([]::bigint[], list_transform(cells, lambda c: [c])), lambda acc, c: case when acc[-1] = c[1] then acc when len(acc) > 1 and acc[-2] = c[1] then acc[:-2] else list_concat(acc, c) end) as cells from walked_lines),
merged as (select lower, upper, number, generate_subscripts(cells, 1) - 1 as pos, unnest(cells) as cid from short_lines)"""
