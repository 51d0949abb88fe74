"""Traversals against a plain Python model on many small random graphs at once."""

import random
from collections import defaultdict, deque

import pytest

from tests.helpers import make_edges, make_nodes
from weftgraph.operators import coupling, paths, traverse

KINDS = ["calls", "imports", "implements", "defines", "instantiates"]


def random_graphs(n_graphs, seed):
    """(nodes, edges, roots): cycles, self-loops, parallel edges and dangling ids."""
    rng = random.Random(seed)
    nodes, edges, roots = [], [], []
    for g in range(n_graphs):
        ids = [f"g{g}:{c}" for c in "abcdef"[: rng.randint(3, 6)]]
        nodes += [(i, "endpoint" if rng.random() < 0.4 else "class", i[-1]) for i in ids if rng.random() < 0.85]
        edges += [(rng.choice(ids), rng.choice(ids), rng.choice(KINDS)) for _ in range(rng.randint(2, 9))]
        roots.append(ids[0])
    return nodes, edges, roots


NODES, EDGES, ROOTS = random_graphs(60, 7)


def walk(root, forward, max_depth):
    """Expected {id: (distance, via)} from a queue over edges in insertion order."""
    seen, queue = {root: (0, "")}, deque([root])
    while queue:
        here = queue.popleft()
        d = seen[here][0]
        if max_depth and d == max_depth:
            continue
        for a, b, kind in EDGES:
            if kind == "defines":
                continue
            src, dst = (a, b) if forward else (b, a)
            if src == here and dst not in seen:
                seen[dst] = (d + 1, kind)
                queue.append(dst)
    del seen[root]
    return seen


@pytest.fixture(scope="module")
def graph(spark):
    return make_nodes(spark, NODES).cache(), make_edges(spark, EDGES).cache()


def roots_frame(spark):
    return spark.createDataFrame([(r,) for r in ROOTS], "root string")


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("depth", [0, 1, 2])
def test_reachable_matches_queue(spark, graph, forward, depth):
    run = traverse.dependencies if forward else traverse.impact
    rows = run(*graph, roots_frame(spark), depth).collect()
    got = {(r["root"], r["id"]): (r["distance"], r["via"]) for r in rows}
    want = {(root, i): v for root in ROOTS for i, v in walk(root, forward, depth).items()}
    assert got == want
    names = dict((n[0], n[2]) for n in NODES)
    assert all(r["name"] == names.get(r["id"], r["id"]) for r in rows)


def test_order_of_one_result(spark, graph):
    rows = traverse.impact(*graph, ROOTS[0]).collect()
    assert [(r["distance"], r["id"]) for r in rows] == sorted((r["distance"], r["id"]) for r in rows)


def test_long_chain_keeps_queue_order(spark):
    """Positions are renumbered at every level."""
    n = 20
    rows = [(f"a{i}", f"a{i+1}", "calls") for i in range(n)] + [(f"a{i}", f"b{i+1}", "imports") for i in range(n)]
    # Both chains reach the same nodes; the a side comes first in the queue.
    rows += [(f"b{i}", f"x{i}", "implements") for i in range(1, n)] + [(f"a{i}", f"x{i}", "calls") for i in range(1, n)]
    edges = make_edges(spark, rows)
    got = {r["id"]: (r["distance"], r["via"]) for r in traverse.dependencies(make_nodes(spark, [("a0", "class", "a0")]), edges, "a0").collect()}
    assert got[f"a{n}"] == (n, "calls")
    assert all(got[f"x{i}"] == (i + 1, "calls") for i in range(1, n))


def simple_paths(root, max_depth):
    """Expected maximal simple paths, depth first."""
    out = []

    def go(path, depth):
        nexts = [(b, k) for a, b, k in EDGES if a == path[-1][0] and b not in [p[0] for p in path]]
        if depth == max_depth or not nexts:
            out.append(path)
            return
        for b, k in nexts:
            go(path + [(b, k)], depth + 1)

    go([(root, "")], 0)
    return out


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_flow_paths(spark, graph, depth):
    got = defaultdict(list)
    for r in paths.flow_paths(graph[1], roots_frame(spark), depth).orderBy(*paths.path_order()).collect():
        got[r["root"]].append([(s["id"], s["via"]) for s in r["steps"]])
    assert dict(got) == {root: simple_paths(root, depth) for root in ROOTS}


def test_flow_depth_defaults_to_five(spark):
    edges = make_edges(spark, [(f"n{i}", f"n{i+1}", "calls") for i in range(9)])
    for depth in (0, -1):
        (row,) = paths.flow_paths(edges, "n0", depth).collect()
        assert row["n_hops"] == 5
    (alone,) = paths.flow_paths(edges, "nowhere").collect()
    assert [s["id"] for s in alone["steps"]] == ["nowhere"]


def expanded(seeds, depth):
    seen, queue, nodes, edges = {s: 0 for s in seeds}, deque(seeds), [], []
    known = {n[0] for n in NODES}
    while queue:
        here = queue.popleft()
        if here in known:
            nodes.append(here)
        if seen[here] == depth:
            continue
        out = [e for e in EDGES if e[0] == here] + [e for e in EDGES if e[1] == here]
        for e in out:
            edges.append(e)
            other = e[0] if e[1] == here else e[1]
            if other not in seen:
                seen[other] = seen[here] + 1
                queue.append(other)
    return sorted(nodes), edges


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_expand_subgraph(spark, graph, depth):
    seeds = [ROOTS[3], ROOTS[5], ROOTS[3].replace("a", "b")]
    members, inside = traverse.expand_subgraph(*graph, seeds, depth)
    want_nodes, want_edges = expanded(seeds, depth)
    assert sorted(r["id"] for r in members.collect()) == want_nodes
    got = [(r["from_id"], r["to_id"], r["kind"]) for r in inside.orderBy("place").collect()]
    assert got == want_edges


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_endpoints_reaching(spark, graph, depth):
    def reaches(start):
        seen, queue = {start: 0}, deque([start])
        known = {n[0]: n for n in NODES}
        while queue:
            here = queue.popleft()
            if here in known and known[here][2] == "c":
                return True
            if depth and seen[here] == depth:
                continue
            for a, b, _ in EDGES:
                if a == here and b not in seen:
                    seen[b] = seen[here] + 1
                    queue.append(b)
        return False

    got = [r["id"] for r in traverse.endpoints_reaching(*graph, graph[0]["name"] == "c", depth).collect()]
    assert got == sorted(i for i, kind, _ in NODES if kind == "endpoint" and reaches(i))
    by_function = traverse.endpoints_reaching(*graph, lambda nodes: nodes.filter("name = 'c'"), depth)
    assert [r["id"] for r in by_function.collect()] == got


def test_coupling(spark, graph):
    real = [e for e in EDGES if e[2] != "defines"]
    want = []
    for i, _, _ in NODES:
        fan_in, fan_out = len({a for a, b, _ in real if b == i}), len({b for a, b, _ in real if a == i})
        if fan_in + fan_out:
            want.append((i, fan_in, fan_out, fan_in + fan_out))
    want.sort(key=lambda r: (-r[3], r[0]))
    rows = coupling.top_coupled(*graph, limit=0).select("id", "fan_in", "fan_out", "total").collect()
    assert [tuple(r) for r in rows] == want
    assert [r["id"] for r in coupling.top_coupled(*graph, limit=4).collect()] == [r[0] for r in want[:4]]
    fan_in = {r["id"]: r["fan_in"] for r in coupling.fan_in(graph[1]).collect()}
    assert all(fan_in.get(i, 0) == f for i, f, _, _ in want)


def test_small_service_graph(spark):
    nodes = make_nodes(spark, [("ep", "endpoint", "POST /x"), ("ctl", "class", "Ctl"), ("svc", "class", "Svc"), ("repo", "class", "Repo"), ("db", "type", "Db"), ("idn", "class", "Idn")])
    edges = make_edges(spark, [("ep", "ctl", "calls"), ("ctl", "svc", "calls"), ("svc", "repo", "calls"), ("repo", "db", "calls"), ("svc", "idn", "calls"), ("f", "idn", "defines")])
    rows = traverse.impact(nodes, edges, "repo").collect()
    assert [(r["id"], r["distance"]) for r in rows] == [("svc", 1), ("ctl", 2), ("ep", 3)]
    assert traverse.dependencies(nodes, edges, "svc", 1).count() == 2
    top = coupling.top_coupled(nodes, edges, 1).first()
    assert (top["id"], top["fan_in"], top["fan_out"], top["total"]) == ("svc", 1, 2, 3)
    assert traverse.impact(nodes, make_edges(spark, [("f", "fn", "defines")]), "fn").count() == 0


def test_same_results_without_broadcasts(spark, graph):
    """What a large frontier or index does: shuffled joins."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = traverse.impact(*graph, roots_frame(spark)).collect()
        got = {(r["root"], r["id"]): (r["distance"], r["via"]) for r in rows}
        found = paths.flow_paths(graph[1], ROOTS[0], 3).orderBy(*paths.path_order()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(root, i): v for root in ROOTS for i, v in walk(root, False, 0).items()}
    assert [[(s["id"], s["via"]) for s in r["steps"]] for r in found] == simple_paths(ROOTS[0], 3)


def test_hub_with_a_third_of_all_edges(spark):
    """One node that most others call: every caller is found once, in one level."""
    n = 30_000
    ids = spark.range(n).selectExpr("concat('m', id) AS from_id", "id")
    seq = "named_struct('phase', 3, 'file_key', '', 'sym_ord', id, 'line', 0L, 'is_create', 0, 'ord', {})"
    hub = ids.selectExpr("from_id", "'hub' AS to_id", "'calls' AS kind", seq.format("0L") + " AS seq")
    ring = ids.selectExpr("from_id", f"concat('m', (id + 1) % {n}) AS to_id", "'imports' AS kind", seq.format("1L") + " AS seq")
    edges = hub.unionByName(hub).unionByName(ring)
    nodes = ids.selectExpr("from_id AS id", "'method' AS kind", "from_id AS name", "'' AS qualified", "'' AS file")
    hits = traverse.impact(nodes, edges, "hub")
    assert [tuple(r) for r in hits.groupBy("distance", "via").count().collect()] == [(1, "calls", n)]
    top = coupling.top_coupled(nodes.unionByName(spark.createDataFrame([("hub", "class", "hub", "", "")], nodes.schema)), edges, 1).first()
    assert (top["id"], top["fan_in"], top["fan_out"]) == ("hub", n, 0)


def test_impact_of_each_root_is_neither_sorted_nor_joined_with_nodes(spark):
    roots = spark.createDataFrame([(r,) for r in ROOTS], "root string")
    found = traverse.impact_of_each(make_edges(spark, EDGES), roots)
    want = {(root, i): hit for root in ROOTS for i, hit in walk(root, False, 0).items() if i != root}
    assert {(r.root, r.id): (r.distance, r.via) for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and "Join" not in plan
