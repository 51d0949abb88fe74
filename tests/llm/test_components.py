import random

from weftgraph.llm import components as C
from weftgraph.llm.components import components


def test_random_graphs(spark):
    for seed in range(3):
        r = random.Random(seed)
        edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(200, 200), (None, 3)]
        parent = {}

        def find(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a is not None and a != b:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
        assert got == {n: find(n) for n in parent}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a string, b string"), "a", "b").collect() == []


def test_no_plan_holds_two_stars(spark, monkeypatch, capsys):
    plans = []

    def explained(edges, written=C._written):
        edges.explain()
        plans.append(capsys.readouterr().out.count("Exchange hashpartitioning"))
        return written(edges)

    monkeypatch.setattr(C, "_written", explained)
    got = C.components(spark.createDataFrame([(i, i + 1) for i in range(20)], "a bigint, b bigint"), "a", "b")
    assert {(x.node, x.component) for x in got.collect()} == {(i, 0) for i in range(21)}
    assert len(plans) > 2 and max(plans) <= 3
