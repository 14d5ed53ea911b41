"""Hierarchies against a serial version of the same rule, and arcs of saddles against a walk over all paths."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from isoweave.functions import grid as G
from isoweave.functions.grid import GridMeta
from isoweave.operators import complex as M
from isoweave.operators import gradient as D
from isoweave.operators import hierarchy as H
from isoweave.runtime import cut
from tests.test_complex import field_of


def cancel_one_by_one(arcs, nodes, limit, frozen=()):
    """Always the first arc of all; (cancelled arcs, living arcs with their number)."""
    live, gone = Counter(arcs), []
    while True:
        up, down = Counter(), Counter()
        for (a, b), m in live.items():
            up[a] += m
            down[b] += m
        may = [(nodes[b][0] - nodes[a][0], (up[a] - 1) * (down[b] - 1), a, b) for (a, b), m in live.items()
               if m == 1 and nodes[a][1] == nodes[b][1] and nodes[b][0] - nodes[a][0] <= limit and a not in frozen and b not in frozen]
        if not may:
            return gone, dict(live)
        _, _, low, high = min(may)
        gone.append((low, high))
        made = Counter()
        for (w, u), m in live.items():
            for (at, x), k in live.items():
                if u == high and w != low and at == low and x != high:
                    made[w, x] += m * k
        live = Counter({p: m for p, m in live.items() if not {low, high} & set(p)}) + made


def complex_of(spark, shape, seed):
    meta = GridMeta(*shape)
    _, field = field_of(spark, shape, seed)
    field = cut(field)
    grad = cut(D.discrete_gradient(field, meta))
    return meta, grad, cut(M.nodes(grad, field, meta)), cut(M.arcs(grad, field, meta))


@pytest.mark.parametrize(("seed", "limit", "tail"), [(1, 25.0, 0), (2, 60.0, 60), (2, 1e9, None)])
def test_hierarchy_equals_a_serial_one(spark, seed, limit, tail):
    meta, _, nodes, arcs = complex_of(spark, (12, 9, 1), seed)
    known = {r["nid"]: (r["value"], r["bnd"]) for r in nodes.collect()}
    given = {(r["lower"], r["upper"]): r["mult"] for r in arcs.collect()}
    gone, live, parts, made = H.hierarchy(arcs, nodes, limit, tail=tail)
    got = [(r["lower"], r["upper"]) for r in gone.collect()]
    want, left = cancel_one_by_one(given, known, limit)
    assert got and sorted(got) == sorted(want)
    times, high = {}, 0.0
    for low, up in want:
        high = max(high, known[up][0] - known[low][0])
        times[low, up] = high
    assert {(r["lower"], r["upper"]): r["time"] for r in gone.collect()} == times
    order = [(r["lower"], r["upper"]) for r in gone.orderBy("time", "round", "persistence").collect()]
    assert order == want
    assert all(r["time"] == times[r["via_lower"], r["via_upper"]] for r in made.collect())
    assert {(r["lower"], r["upper"]): r["mult"] for r in live.collect()} == left
    euler = lambda df: sum((-1) ** r["dim"] for r in df.collect())
    assert euler(H.living_nodes(nodes, gone)) == euler(nodes) == 1
    assert {r["part"] for r in parts.collect()} <= {n for pair in want for n in pair}


@pytest.mark.parametrize("tail", [0, None])
def test_frozen_nodes_stay_and_groups_keep_their_borders(spark, tail):
    meta, _, nodes, arcs = complex_of(spark, (12, 9, 1), 3)
    groups = nodes.select("nid", (F.col("x") >= 6).cast("int").alias("group"))
    side = {r["nid"]: r["group"] for r in groups.collect()}
    known = {r["nid"]: (r["value"], r["bnd"]) for r in nodes.collect()}
    given = {(r["lower"], r["upper"]): r["mult"] for r in arcs.collect()}
    frozen = {n for pair in given for n in pair if side[pair[0]] != side[pair[1]]}
    gone, live, *_ = H.grouped_hierarchy(arcs, nodes, groups, 50.0, tail=tail)
    got = sorted((r["lower"], r["upper"]) for r in gone.collect())
    want, left = cancel_one_by_one(given, known, 50.0, frozen)
    assert got == sorted(want) and not frozen & {n for p in got for n in p}
    assert {(r["lower"], r["upper"]): r["mult"] for r in live.collect()} == left


def test_arcs_of_saddles_equal_all_walks(spark):
    meta, grad, nodes, arcs = complex_of(spark, (5, 4, 5), 4)
    rows = {r["cid"]: r for r in grad.collect()}
    facets = defaultdict(list)
    for r in G.facets(grad.select("cid"), meta).collect():
        facets[r["cid"]].append(r["fcid"])
    want = Counter()

    def walk(start, quad):
        for edge in facets[quad]:
            if rows[edge]["is_critical"]:
                want[edge, start] += 1
            elif rows[rows[edge]["pair_cid"]]["dim"] == 2 and rows[edge]["pair_cid"] != quad:
                walk(start, rows[edge]["pair_cid"])

    for cid, r in rows.items():
        if r["dim"] == 2 and r["is_critical"]:
            walk(cid, cid)
    found = H.saddle_arcs(grad, meta)
    assert {(r["lower"], r["upper"]): r["mult"] for r in found.collect()} == dict(want) and want
    all_arcs = arcs.select("lower", "upper", "dim", "mult").union(found)
    both = []
    for tail in (0, None):
        gone, live, *_ = H.hierarchy(all_arcs, nodes, 30.0, guarded=True, weighted=False, tail=tail)
        assert sum((-1) ** r["dim"] for r in H.living_nodes(nodes, gone).collect()) == 1
        both.append((sorted((r["lower"], r["upper"]) for r in gone.collect()), sorted((r["lower"], r["upper"], r["mult"]) for r in live.collect())))
    assert both[0] == both[1] and both[0][0]


def test_no_arcs(spark):
    arcs = spark.createDataFrame([], "lower long, upper long, dim int, mult long")
    nodes = spark.createDataFrame([(1, 2.0, 0)], "nid long, value double, bnd int")
    for tail in (0, None):
        assert [df.count() for df in H.hierarchy(arcs, nodes, 1.0, tail=tail)] == [0] * 4
