"""What depends on each of many roots: rows without ranks where one kind of edge leads to a node."""

import pytest

from tests.helpers import make_edges
from tests.test_traversal import EDGES, ROOTS, walk
from weftgraph.operators import adjacency, traverse

ONE_KIND = [(f"p{i}", f"s{i % 3}", "instantiates") for i in range(6) for _ in range(2)] + [(f"o{i}", f"p{i % 6}", "calls") for i in range(12)] + [("o1", "p2", "calls"), ("s0", "o1", "implements")]


def reached(rows, root):
    out, level = {root: (0, "")}, [root]
    while level:
        step = {a: k for a, b, k in rows if b in level and a not in out}
        out |= {a: (out[level[0]][0] + 1, k) for a, k in step.items()}
        level = list(step)
    return {(root, a, d, k) for a, (d, k) in out.items() if d}


@pytest.mark.parametrize("large", [1, 1 << 18])
def test_nodes_met_by_one_kind_need_no_ranks(spark, monkeypatch, large):
    for module in (adjacency, traverse):
        monkeypatch.setattr(module, "LARGE", large)
    monkeypatch.setattr(traverse, "bfs", lambda *a: 1 / 0)
    roots = spark.createDataFrame([("s0",), ("s1",), ("s1",), ("x",), (None,)], "root string")
    got = [tuple(r) for r in traverse.impact_of_each(make_edges(spark, ONE_KIND), roots).collect()]
    assert sorted(got) == sorted(reached(ONE_KIND, "s0") | reached(ONE_KIND, "s1")) and len(got) > 10


def test_nodes_met_by_several_kinds_keep_the_queue(spark):
    roots = spark.createDataFrame([(r,) for r in ROOTS[:2]], "root string")
    got = {tuple(r) for r in traverse.impact_of_each(make_edges(spark, EDGES), roots).collect()}
    assert got == {(r, i, d, v) for r in ROOTS[:2] for i, (d, v) in walk(r, False, 0).items()}
