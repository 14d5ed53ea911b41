import numpy as np

from isoweave.functions.grid import GridMeta
from isoweave.operators import complex as M
from isoweave.operators import geometry as L
from isoweave.operators import gradient as D
from tests.test_complex import field_of


def test_lines_lead_from_saddles_to_extrema(spark):
    meta = GridMeta(12, 9)
    _, field = field_of(spark, (12, 9, 1), 3)
    grad = D.discrete_gradient(field, meta).cache()
    rows = {r.cid: r for r in grad.collect()}
    for up, dim, ends in ((False, 1, M.ends_down), (True, 1, M.ends_up)):
        lines = {}
        for r in L.arc_geometry(grad, meta, up).collect():
            lines.setdefault((r.sid, r.side), {})[r.pos] = r.cid
        label = {r.cid: r.label for r in ends(grad, meta).collect()}
        saddles = {c for c, r in rows.items() if r.is_critical and r.dim == dim}
        assert {s for s, _ in lines} == saddles
        for (sid, side), cells in lines.items():
            line = [cells[i] for i in range(len(cells))]
            assert line[0] == sid and line[1] == side
            # every second step is a pair of the gradient; the line ends where its first cell flows to
            assert all(rows[a].pair_cid == b for a, b in zip(line[1::2], line[2::2]))
            if side in label:
                assert line[-1] == label[side]
    geometry = L.arc_geometry(grad, meta).cache()
    assert L.line_soup(geometry).count() == geometry.select("cid").distinct().count()
    assert L.numbered(geometry).select("line_id").distinct().count() == geometry.select("sid", "side").distinct().count()


def test_history_pairs_and_reasons(spark):
    meta = GridMeta(12, 9)
    _, field = field_of(spark, (12, 9, 1), 4)
    grad = D.discrete_gradient(field, meta).cache()
    nodes, arcs = M.nodes(grad, field, meta).cache(), M.arcs(grad, field, meta).cache()
    pairs = M.merge_pairs(M.extremum_graph(arcs, nodes, meta, False), nodes.where("dim = 0"), False).cache()
    n = nodes.where("dim = 0").count()
    history = L.cancellation_history(pairs, spark.createDataFrame([(n,)], "n long")).orderBy("rank").collect()
    assert [r.left for r in history] == list(range(n - 1, 0, -1)) and np.all(np.diff([r.persistence for r in history]) >= 0)
    assert sum(r.n for r in L.blocking_reasons(arcs, nodes).collect()) == arcs.count()
    assert L.persistence_pairs(arcs, nodes, nodes).count() == arcs.count()
    assert L.persistence_pairs(arcs, nodes, M.living(nodes, pairs, 1e9)).count() < arcs.count()
    assert sum(r.n for r in L.endpoint_histogram(arcs).collect()) == arcs.selectExpr("sum(mult) m").first().m
    labels = M.ends_down(grad, meta)
    assert L.manifold(labels, nodes.where("dim = 0")).count() == labels.count()
