"""Connected components of an undirected edge list, by alternating stars.

Each round points every larger neighbour of a node at the least node around it,
then does the same among the smaller neighbours; edges never grow in number and
a path of n nodes needs about log n rounds.  A hub's edges are joined to one
small row per node, which adaptive execution splits when the hub is skewed.
Every star is written to the shared scratch folder, so a lost executor costs
one re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.session import materialize, scratch_path


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct edges on disk, and what tells one edge set from another."""
    spark, path, seen = edges.sparkSession, scratch_path(edges.sparkSession, "components"), Observation()
    mark = F.xxhash64("u", "v")
    edges = edges.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(mark).alias("x"), F.sum(mark.bitwiseAND(0xFFFFFFFF)).alias("s"))
    edges.write.parquet(path)
    got = seen.get
    return spark.read.schema(edges.schema).parquet(path), (got["n"], got["x"], got["s"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    met = both.join(least, "u")
    if large:
        return met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    hung = met.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.where(F.col("u") != F.col("m")).select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of all nodes that have an edge to another; the component is its least node.

    Loops, nulls and repeated edges are allowed and change nothing.  No edges: no rows.
    """
    start = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    current, mark = _written(start)
    while mark[0]:
        # All edges lead from a larger node to a smaller one.
        # Either star is written by a plan of its own: the driver makes a plan anew at each of its stages.
        pointed = materialize(_star(current, large=True), "stars")
        following, new = _written(_star(pointed, large=False))
        current, same, mark = following, new == mark, new
        if same:
            break
    heads = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads)
