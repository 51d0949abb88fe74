"""Breadth-first traversals as loops of joins.

Every round joins the newest level with an index of the edges and drops what
earlier levels hold.  A small level is broadcast or looked up by value; a large
one is dealt by the edges' buckets, and neither the edges nor the rows met
before are moved for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.adjacency import LARGE, Edges, Levels
from weftgraph.operators.model import exclude_defines, incoming, node_or_stub, outgoing
from weftgraph.session import materialize


def as_roots(spark: SparkSession, roots: str | Iterable[str] | DataFrame) -> DataFrame:
    """Root ids as one ``root`` column; a DataFrame may hold any number of them."""
    if isinstance(roots, DataFrame):
        return roots.select(F.col(roots.columns[0]).alias("root"))
    ids = [roots] if isinstance(roots, str) else list(roots)
    return spark.createDataFrame([(i,) for i in ids], "root string")


#: Steps that a rank may list before its level is numbered: of a small level, of a large one.
TRAIL, WIDE = 8, 2
#: Rows of a level that may share an id where a level is hashed by it.
SHARED = 16


def bfs(adjacency: DataFrame | list[DataFrame], roots: DataFrame, max_depth: int = 0) -> DataFrame:
    """Nodes reached from each root: (root, id, distance, via, rank).

    ``adjacency`` is (src, dst, kind, seq), or the parts of an index of them.  A
    DataFrame is read as it is for the first levels, so what is dear to derive
    should be stored before.
    ``roots`` has a root column and may have id and rank: the nodes each search
    starts from and their order.  ``max_depth`` <= 0 has no bound.  ``via`` is
    the kind of the edge a queue would have met first: earliest parent in the
    queue, then earliest edge.

    Within a distance, rank sorts in queue order.  It is a number and the edges
    taken since, and before a level meets its edges it is sorted (in ranges) and
    numbered anew if the list has ``TRAIL`` edges, or ``WIDE`` in a large level.  So
    ranks stay narrow at any depth, small levels need no sort and no large level
    meets in one task.
    """
    start = roots if "id" in roots.columns else roots.withColumn("id", F.col("root")).withColumn("rank", F.lit(0))
    start = start.groupBy("root", "id").agg(F.min(F.col("rank").cast("long")).alias("rank"))
    edges = Edges(adjacency)
    spark, trail = edges.sparkSession, f"array<struct<seq:{edges.schema['seq'].dataType.simpleString()},id:string>>"
    levels = Levels(spark, "bfs", f"root string, id string, via string, rank long, trail {trail}", ["root", "id"])
    fresh = start.select("root", "id", F.lit("").alias("via"), "rank", F.array().cast(trail).alias("trail"))
    depth, before, listed = 0, 0, 0
    while True:
        # A level that follows a large one goes straight into the buckets it is partitioned by.
        found = levels.add(depth, fresh, large=before >= LARGE)
        if not found or 0 < max_depth <= depth:
            break
        if depth == 0:
            # There are no more roots than starts, and a level has an id once for each root.
            edges.repeats = found > SHARED
        number = listed >= (min(WIDE, TRAIL) if found >= LARGE else TRAIL)
        fresh = next_level(edges, levels, depth, found, number)
        depth, before, listed = depth + 1, found, 1 if number else listed + 1
    return levels.rows().select("root", "id", "distance", "via", F.struct("rank", "trail").alias("rank"))


def next_level(edges: Edges | list[DataFrame], levels: Levels, depth: int, n: int, number: bool = False) -> DataFrame:
    """(root, id, via, rank, trail) of what the ``n`` rows at ``depth``, which may be numbered, meet for the first time."""
    edges = edges if isinstance(edges, Edges) else Edges(edges)
    here = levels.numbered(depth) if number else levels.level(depth)
    steps = edges.met(here.select("root", "id", "rank", "trail"), n).withColumnRenamed("dst", "id")
    first = steps.groupBy("root", "id").agg(F.min(F.struct("rank", "trail", "seq", "kind")).alias("f"))
    trail = F.concat("f.trail", F.array(F.struct("f.seq", "id")))
    return levels.unseen(first.select("root", "id", F.col("f.kind").alias("via"), "f.rank", trail.alias("trail")))


def _reachable(
    nodes: DataFrame, adjacency: DataFrame | list[DataFrame], roots: str | Iterable[str] | DataFrame, max_depth: int
) -> DataFrame:
    hits = bfs(adjacency, as_roots(nodes.sparkSession, roots), max_depth).filter("distance > 0")
    hits = hits.select("root", "id", "distance", "via")
    columns = [c for c in nodes.columns if c != "id"]
    return node_or_stub(hits, nodes, columns).orderBy("root", "distance", "id")


def impact(
    nodes: DataFrame, edges: DataFrame, roots: str | Iterable[str] | DataFrame, max_depth: int = 0, backward: list[DataFrame] | None = None
) -> DataFrame:
    """Everything that transitively depends on the roots; ``backward`` is an index of the edges by target."""
    return _reachable(nodes, _kept(backward) or incoming(exclude_defines(edges)), roots, max_depth)


def impact_of_each(edges: DataFrame, roots: DataFrame, max_depth: int = 0, backward: list[DataFrame] | None = None) -> DataFrame:
    """(root, id, distance, via) of everything that transitively depends on each root.

    The rows of ``impact`` for many roots, which may be billions: neither sorted as a
    whole nor joined with the nodes.
    """
    adjacency, starts = _kept(backward) or incoming(exclude_defines(edges)), as_roots(edges.sparkSession, roots)
    parts = adjacency if isinstance(adjacency, list) else [adjacency]
    links = materialize(reduce(DataFrame.unionByName, [p.select("src", "dst", "kind") for p in parts]).distinct(), "links")
    kinds = links.groupBy("dst").agg(F.min("kind").alias("first"), F.max("kind").alias("last"))
    if kinds.where("first <> last").isEmpty():
        hits = _reached_by_each(links, starts, max_depth)
    else:
        hits = bfs(adjacency, starts, max_depth)
    return hits.filter("distance > 0").select("root", "id", "distance", "via")


def _reached_by_each(links: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(root, id, via, distance) over different links (src, dst, kind) of which all that lead to a node have one kind.

    Then ``via`` is the same whatever edge is met first, so rows carry no ranks; it is a
    number on the way, because the least text of a group is found by a sort.
    """
    # As many as kinds of edges.
    names = F.array(*[F.lit(r.kind) for r in links.select("kind").distinct().collect()] or [F.lit("")])
    links = links.withColumn("kind", F.array_position(names, F.col("kind")).cast("int"))
    levels = Levels(links.sparkSession, "each", "root string, id string, via int", ["root", "id"])
    fresh, before, depth = roots.distinct().select("root", F.col("root").alias("id"), F.lit(0).alias("via")), 0, 0
    while True:
        found = levels.add(depth, fresh, large=before >= LARGE)
        if not found or 0 < max_depth <= depth:
            break
        here, near = levels.level(depth).select("root", "id"), links
        if found >= LARGE:
            # Many rows share an id, and a level that has no links is not moved to learn that.
            near = materialize(links.join(here.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(*links.columns), "near")
            if near.isEmpty():
                break
        steps = near.join(here, near["src"] == here["id"]).select("root", F.col("dst").alias("id"), F.col("kind").alias("via"))
        fresh, before, depth = levels.unseen(steps.groupBy("root", "id").agg(F.min("via").alias("via"))), found, depth + 1
    return levels.rows().withColumn("via", F.when(F.col("via") > 0, F.element_at(names, F.col("via"))).otherwise(""))


def dependencies(
    nodes: DataFrame, edges: DataFrame, roots: str | Iterable[str] | DataFrame, max_depth: int = 0, forward: list[DataFrame] | None = None
) -> DataFrame:
    """Everything the roots transitively rely on; ``forward`` is an index of the edges by start."""
    return _reachable(nodes, _kept(forward) or outgoing(exclude_defines(edges)), roots, max_depth)


def _kept(parts: list[DataFrame] | None) -> list[DataFrame] | None:
    return parts and [p.filter(F.col("kind") != "defines") for p in parts]


def reaching(
    nodes: DataFrame,
    edges: DataFrame,
    matcher: Column | Callable[[DataFrame], DataFrame],
    max_depth: int = 0,
    backward: list[DataFrame] | None = None,
) -> DataFrame:
    """Ids from which a matched node can be reached along any edge kind.

    One backward search from all matched nodes replaces a forward search per
    candidate.  ``matcher`` is a condition on node columns, or a function that
    filters the node table.
    """
    matched = matcher(nodes) if callable(matcher) and not isinstance(matcher, Column) else nodes.filter(matcher)
    return _distances(backward or incoming(edges), matched.select("id"), max_depth)


def _distances(adjacency: DataFrame | list[DataFrame], start: DataFrame, max_depth: int) -> DataFrame:
    """(id, distance): how far every id is from the nearest start row.

    Without edge order a level is a plain distinct, which needs no sort.
    """
    edges = Edges(adjacency)
    levels = Levels(edges.sparkSession, "reach", "id string", ["id"])
    fresh, before, depth = start.select("id").distinct(), 0, 0
    while True:
        found = levels.add(depth, fresh, large=before >= LARGE)
        if not found or 0 < max_depth <= depth:
            return levels.rows()
        steps = edges.met(levels.level(depth), found).select(F.col("dst").alias("id")).distinct()
        fresh, before, depth = levels.unseen(steps), found, depth + 1


def nearest(edges: DataFrame, sources: DataFrame, max_depth: int = 0) -> DataFrame:
    """(id, distance) of everything that depends on one of ``sources`` (id), by the nearest of them; they are at 0."""
    return _distances(incoming(exclude_defines(edges)), sources, max_depth)


def endpoints_reaching(
    nodes: DataFrame,
    edges: DataFrame,
    matcher: Column | Callable[[DataFrame], DataFrame],
    max_depth: int = 0,
    backward: list[DataFrame] | None = None,
) -> DataFrame:
    """Endpoints whose flow meets a matched node, themselves included, by id."""
    hits = reaching(nodes, edges, matcher, max_depth, backward)
    return nodes.filter(F.col("kind") == "endpoint").join(hits.select("id"), "id", "left_semi").orderBy("id")


def expand_subgraph(
    nodes: DataFrame,
    edges: DataFrame,
    seeds: Iterable[str] | DataFrame,
    depth: int = 2,
    edges_by_target: DataFrame | None = None,
    forward: list[DataFrame] | None = None,
    backward: list[DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The neighbourhood of the seeds over all edges, both ways: (nodes, edges).

    ``edges_by_target`` are the same edges as stored for backward steps;
    ``forward`` and ``backward`` are indexes of them by either end.

    An edge is listed once for each of its ends that was expanded, so an edge
    inside the neighbourhood appears twice and one between two outermost nodes
    not at all.  A depth of zero gives the seed nodes and no edges.  Seeds are
    expanded in the order of a list, or of the rank column of a DataFrame, and
    edges carry ``place``, which sorts them the way they were met.
    """
    spark = nodes.sparkSession
    if isinstance(seeds, DataFrame):
        start = seeds if "rank" in seeds.columns else seeds.withColumn("rank", F.lit(0))
        start = start.select(F.lit("").alias("root"), F.col(seeds.columns[0]).alias("id"), "rank")
    else:
        start = spark.createDataFrame([("", s, i) for i, s in enumerate(seeds)], "root string, id string, rank long")

    def sided(links: DataFrame, side: int) -> DataFrame:
        return links.withColumn("seq", F.struct(F.lit(side).alias("side"), "seq"))

    by_target = edges if edges_by_target is None else edges_by_target
    if forward and backward:
        around = [sided(p, 0) for p in forward] + [sided(p, 1) for p in backward]
    else:
        around = sided(outgoing(edges), 0).unionByName(sided(incoming(by_target), 1))
    if depth > 0:
        dist = bfs(around, start, depth).drop("root", "via")
    else:
        dist = start.select("id").distinct().withColumn("distance", F.lit(0))
    members = nodes.join(dist.select("id", "distance"), "id")
    if depth <= 0:
        return members, edges.filter(F.lit(False)).withColumn("place", F.lit(None).cast("string"))
    inner = dist.filter(F.col("distance") < depth)

    def touched(edges: DataFrame, end: str, side: int) -> DataFrame:
        place = F.struct("distance", "rank", F.lit(side).alias("side"), "seq")
        return edges.join(inner, edges[end] == inner["id"]).select("from_id", "to_id", "kind", "seq", place.alias("place"))

    return members, touched(edges, "from_id", 0).unionByName(touched(by_target, "to_id", 1))
