"""Indexed edges and bucketed levels, on the graphs of the traversal tests."""

import pytest

from tests.helpers import make_edges, make_nodes
from tests.test_traversal import EDGES, NODES, ROOTS, roots_frame, walk
from weftgraph.operators import adjacency, model, traverse
from weftgraph.sources.store import GraphStore


@pytest.fixture
def all_large(monkeypatch):
    for module in (adjacency, traverse):
        monkeypatch.setattr(module, "LARGE", 1)
    monkeypatch.setattr(adjacency, "INDEXED", 0)
    monkeypatch.setattr(adjacency, "HUB", 3)
    monkeypatch.setattr(adjacency, "LOOKUP", 2)
    monkeypatch.setattr(traverse, "TRAIL", 2)


def test_large_levels_match_the_queue(spark, all_large):
    nodes, edges = make_nodes(spark, NODES), make_edges(spark, EDGES)
    got = {(r["root"], r["id"]): (r["distance"], r["via"]) for r in traverse.dependencies(nodes, edges, roots_frame(spark)).collect()}
    assert got == {(root, i): v for root in ROOTS for i, v in walk(root, True, 0).items()}


def test_distances_over_large_levels(spark, all_large):
    edges = make_edges(spark, EDGES)
    got = {r["id"]: r["distance"] for r in traverse.nearest(edges, roots_frame(spark).withColumnRenamed("root", "id")).collect()}
    want = {root: 0 for root in ROOTS}
    for root in ROOTS:
        for i, (d, _) in walk(root, False, 0).items():
            want[i] = min(want.get(i, d), d)
    assert got == want


def test_hubs_are_kept_apart_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(adjacency, "HUB", 3)
    monkeypatch.setattr(adjacency, "_buckets", lambda spark, n=0: 40)
    rows = [("hub", f"x{i}", "calls") for i in range(30)] + [(f"x{i}", "hub", "calls") for i in range(10)]
    parts = adjacency.index(model.outgoing(make_edges(spark, rows)))
    assert [p.count() for p in parts] == [10, 30]
    assert {r.src for r in parts[1].collect()} == {"hub"}


def test_a_large_level_moves_neither_edges_nor_rows_met_before(spark, all_large):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        parts = adjacency.index(model.outgoing(make_edges(spark, [(f"a{i}", f"a{i + 1}", "calls") for i in range(50)])))
        levels = adjacency.Levels(spark, "t", f"root string, id string, via string, rank long, trail array<struct<seq:{parts[0].schema['seq'].dataType.simpleString()},id:string>>", ["root", "id"])
        start = spark.createDataFrame([("a0", f"a{i}", "", i, []) for i in range(9)], levels.schema)
        levels.add(0, start, large=True)
        plan = traverse.next_level(parts, levels, 0, 9)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One exchange of the level and one of what it meets; scans of edges and of levels are in buckets.
    assert plan.count("Exchange hashpartitioning") == 2, plan
    assert plan.count("Bucketed: true") == 2, plan


def test_stored_indexes_serve_a_new_session(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(adjacency, "HUB", 3)
    nodes, edges = make_nodes(spark, NODES), make_edges(spark, EDGES)
    GraphStore(spark, str(tmp_path)).save("t", nodes, edges)
    for row in spark.catalog.listTables():
        if row.name.startswith("weft_"):
            spark.sql(f"DROP TABLE {row.name}")  # external: the files stay
    store = GraphStore(spark, str(tmp_path))
    forward, backward = store.indexes("t")
    root = ROOTS[0]
    for parts, run, ahead in ((forward, traverse.dependencies, True), (backward, traverse.impact, False)):
        key = {"forward": parts} if ahead else {"backward": parts}
        got = {r["id"]: (r["distance"], r["via"]) for r in run(nodes, edges, root, **key).collect()}
        assert got == walk(root, ahead, 0)
    key = lambda r: (r.from_id, r.to_id, r.kind)
    for side in store.load("t")[1:]:
        assert sorted(map(key, side.collect())) == sorted(EDGES)
