"""Bounded enumeration of simple paths."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.operators import adjacency as adjacency_rules
from weftgraph.operators.model import node_or_stub, outgoing
from weftgraph.operators.traverse import as_roots
from weftgraph.session import materialize, scratch_path, write_counted

DEFAULT_DEPTH = 5
#: Paths of a level from which the edges that they meet are dealt to all tasks.
SPREAD = 1 << 13


class PathLevels:
    """Simple paths by their number of hops, each level a table under the shared scratch folder.

    A row (root, pid, parent, tail, steps) is one path; ``parent`` is the row number of
    the path one hop shorter, and ``steps`` holds (id, via, seq).
    """

    def __init__(self, spark: SparkSession, seq_type: T.DataType):
        step = T.StructType().add("id", "string").add("via", "string").add("seq", seq_type)
        self.schema = T.StructType().add("root", "string").add("pid", "long").add("parent", "long").add("tail", "string").add("steps", T.ArrayType(step))
        self.seq_type, self._spark, self._base, self.depth = seq_type, spark, scratch_path(spark, "paths"), -1

    def add(self, rows: DataFrame) -> int:
        """Write the next level under fresh row numbers and return its size."""
        self.depth += 1
        return write_counted(rows, f"{self._base}/hops={self.depth}")

    def level(self, depth: int) -> DataFrame:
        return self._spark.read.schema(self.schema).parquet(f"{self._base}/hops={depth}")

    def maximal(self) -> DataFrame:
        """(root, n_hops, steps) of the paths that were not extended."""
        parts = []
        for d in range(self.depth + 1):
            rows = self.level(d)
            if d < self.depth:
                rows = rows.join(self.level(d + 1).select(F.col("parent").alias("pid")), "pid", "left_anti")
            parts.append(rows.select("root", F.lit(d).alias("n_hops"), "steps"))
        return reduce(DataFrame.unionByName, parts)

    def last_steps(self) -> DataFrame:
        """The last step of every path: (root, order_key, pos, id, prev, via); ``order_key`` sorts depth first."""
        trail = F.expr("transform(slice(steps, 2, size(steps)), s -> struct(s.seq AS seq, s.id AS id, s.via AS via))")
        last = F.element_at("steps", -1)
        parts = [
            self.level(d).select(
                "root",
                trail.alias("order_key"),
                F.lit(d).alias("pos"),
                F.col("tail").alias("id"),
                (F.element_at("steps", -2)["id"] if d else F.lit(None).cast("string")).alias("prev"),
                last["via"].alias("via"),
            )
            for d in range(self.depth + 1)
        ]
        return reduce(DataFrame.unionByName, parts)


def flow_levels(edges: DataFrame, roots: str | Iterable[str] | DataFrame, max_depth: int = DEFAULT_DEPTH) -> PathLevels:
    """Simple paths from each root, level by level.

    All edge kinds count.  A path ends at the depth bound, at a node without
    outgoing edges, or where every neighbour is already on it; parallel edges
    give separate paths.
    """
    depth_bound = max_depth if max_depth > 0 else DEFAULT_DEPTH
    spark = edges.sparkSession
    adjacency = outgoing(edges)
    seq_type = edges.schema["seq"].dataType
    levels = PathLevels(spark, seq_type)
    start = F.struct(F.col("root").alias("id"), F.lit("").alias("via"), F.lit(None).cast(seq_type).alias("seq"))
    number = F.monotonically_increasing_id().alias("pid")
    first = as_roots(spark, roots).distinct()
    found = levels.add(first.select("root", number, F.lit(-1).cast("long").alias("parent"), F.col("root").alias("tail"), F.array(start).alias("steps")))
    while found and levels.depth < depth_bound:
        here, near = levels.level(levels.depth), adjacency
        if levels.depth and found >= adjacency_rules.LARGE:
            # Many paths end at one node.  Its edges are found once, so that few of them meet the paths where those
            # lie, and no path moves if there are none.
            tails = here.select(F.col("tail").alias("src")).distinct()
            near = materialize(adjacency.join(tails, "src", "left_semi").select(*adjacency.columns), "steps")
        elif levels.depth and found >= SPREAD:
            # Such a level may be broadcast: then the tasks that read the edges write the next one, which may be large.
            near = adjacency.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        if levels.depth == 0 and adjacency_rules.LARGE <= found <= adjacency_rules.task_rows(spark):
            # Roots differ, so they are hashed evenly and the edges need no sort; later tails may repeat.
            here = here.hint("shuffle_hash")
        longer = near.join(here, near["src"] == here["tail"]).filter(~F.exists("steps", lambda s: s["id"] == F.col("dst")))
        step = F.struct(F.col("dst").alias("id"), F.col("kind").alias("via"), "seq")
        found = levels.add(
            longer.select("root", number, F.col("pid").alias("parent"), F.col("dst").alias("tail"), F.concat("steps", F.array(step)).alias("steps"))
        )
    return levels


def flow_paths(edges: DataFrame, roots: str | Iterable[str] | DataFrame, max_depth: int = DEFAULT_DEPTH) -> DataFrame:
    """Maximal simple paths from each root: (root, n_hops, steps), see ``flow_levels``; ``path_order`` sorts them depth first."""
    return flow_levels(edges, roots, max_depth).maximal()


def path_order() -> list:
    """Sort keys that give depth-first order within a root."""
    return [
        F.col("root"),
        F.expr("transform(slice(steps, 2, size(steps)), s -> s.seq)"),
        F.expr("transform(steps, s -> s.id)"),
    ]


def path_steps(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per step with its node: (root, order_key, pos, id, via, name, ...).

    ``order_key`` lists the edges taken so far, so it sorts steps depth first
    and is the same for all paths that share a prefix.
    """
    trail = F.expr("transform(slice(steps, 2, size(steps)), s -> struct(s.seq AS seq, s.id AS id, s.via AS via))")
    flat = paths.withColumn("trail", trail).select("root", "trail", F.posexplode("steps").alias("pos", "step"))
    flat = flat.select(
        "root",
        F.col("trail").alias("path_key"),
        F.expr("slice(trail, 1, pos)").alias("order_key"),
        "pos",
        F.col("step.id").alias("id"),
        F.col("step.via").alias("via"),
    )
    return node_or_stub(flat, nodes, ["name", "qualified", "kind", "file"])
