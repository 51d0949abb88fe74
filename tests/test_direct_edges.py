"""Searches that need no stored edges, and large levels that need no sort."""

import glob

import pytest

from tests.helpers import make_edges, make_nodes
from tests.test_traversal import EDGES, NODES, ROOTS, walk
from weftgraph.operators import adjacency, model, paths, traverse
from weftgraph.plans import registry
from weftgraph.session import scratch_root


def stored(spark) -> set[str]:
    root = scratch_root(spark).removeprefix("file:")
    return {p for label in ("edges", "index") for p in glob.glob(f"{root}/weftgraph/{label}-*")}


def test_a_neighbourhood_of_two_levels_stores_no_edges(spark):
    nodes, edges = make_nodes(spark, NODES), make_edges(spark, EDGES)
    before = stored(spark)
    members, inside = traverse.expand_subgraph(nodes, edges, [ROOTS[0]], depth=2)
    assert members.count() > 1 and inside.count() > 1
    assert stored(spark) == before


def test_a_long_search_stores_its_edges_once(spark):
    chain = [(f"a{i}", f"a{i + 1}", "calls") for i in range(6)]
    before = stored(spark)
    got = traverse.dependencies(make_nodes(spark, NODES), make_edges(spark, chain), "a0").collect()
    assert [(r.id, r.distance) for r in got] == [(f"a{i}", i) for i in range(1, 7)]
    assert len(stored(spark) - before) == 1


def test_edges_of_a_large_level_are_not_sorted(spark, monkeypatch):
    for module in (adjacency, traverse):
        monkeypatch.setattr(module, "LARGE", 1)
    monkeypatch.setattr(adjacency, "LOOKUP", 2)
    edges = model.outgoing(make_edges(spark, [(f"a{i}", f"a{i + 1}", "calls") for i in range(50)]))
    trail = f"array<struct<seq:{edges.schema['seq'].dataType.simpleString()},id:string>>"
    levels = adjacency.Levels(spark, "t", f"root string, id string, via string, rank long, trail {trail}", ["root", "id"])
    levels.add(0, spark.createDataFrame([("a0", f"a{i}", "", i, []) for i in range(9)], levels.schema), large=True)
    plan = traverse.next_level([edges], levels, 0, 9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan, plan


@pytest.mark.parametrize("root", ROOTS[:3])
def test_edges_by_tables_give_the_same_rows(spark, root, monkeypatch):
    monkeypatch.setattr(traverse, "WIDE", 1)
    for module in (adjacency, traverse):
        monkeypatch.setattr(module, "LARGE", 1)
    nodes, edges = make_nodes(spark, NODES), make_edges(spark, EDGES)
    tables = [model.incoming(edges.where("from_id < 'f'")), model.incoming(edges.where("from_id >= 'f'"))]
    got = {r["id"]: (r["distance"], r["via"]) for r in traverse.impact(nodes, edges, root, backward=tables).collect()}
    assert got == walk(root, False, 0)


@pytest.mark.parametrize("name", ["impact", "queue_order_via", "endpoints_reaching_each_brand"])
def test_queries_over_edge_tables_store_no_edges(spark, name):
    before = stored(spark)
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 1
    assert stored(spark) == before


def test_many_roots_of_paths_sort_no_edges(spark, monkeypatch):
    monkeypatch.setattr(adjacency, "LARGE", 1)
    plans, write = [], paths.write_counted
    monkeypatch.setattr(paths, "write_counted", lambda df, path: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, path))[1])
    edges = make_edges(spark, [(f"a{i}", f"a{i + 1}", "calls") for i in range(9)])
    assert paths.flow_paths(edges, [f"a{i}" for i in range(9)], max_depth=1).count() == 9
    assert "ShuffledHashJoin" in plans[1] and "SortMergeJoin" not in plans[1]


def star_tables(spark, folder):
    """Two orders, the first one urgent, of a customer and a part that three lines bought from one supplier."""
    rows = {
        "region": ("r_regionkey long, r_name string", [(0, "R")]),
        "nation": ("n_nationkey long, n_name string, n_regionkey long", [(0, "N", 0)]),
        "customer": ("c_custkey long, c_name string, c_mktsegment string, c_nationkey long", [(1, "C", "M", 0)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey long", [(1, "S", 0)]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int", [(1, "P", "B", "T", 1)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string", [(1, 1, "O", "1-URGENT"), (2, 1, "O", "5-LOW")]),
        "lineitem": ("l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long", [(1, 1, 1, 1), (2, 1, 1, 1), (2, 2, 1, 1)]),
    }
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("large, spread", [(1, 1), (1 << 18, 1), (1 << 18, 1 << 13)])
def test_flow_of_urgent_orders_goes_on_to_the_end(spark, tmp_path, monkeypatch, large, spread):
    monkeypatch.setattr(adjacency, "LARGE", large)
    monkeypatch.setattr(paths, "SPREAD", spread)
    got = [tuple(r) for r in registry.QUERIES["flow_of_every_urgent_order"](spark, star_tables(spark, tmp_path)).collect()]
    deep = ("order::1", 3, "order::1 > part::1 > supplier::1 > nation::0", ",calls,instantiates,implements")
    assert sorted(got) == [("order::1", 2, "order::1 > customer::1 > nation::0", ",calls,implements"), deep, deep, deep]
