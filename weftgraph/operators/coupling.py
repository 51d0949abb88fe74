"""Fan-in, fan-out and the coupling ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.model import exclude_defines


def _distinct_pairs(edges: DataFrame) -> DataFrame:
    return exclude_defines(edges).select("from_id", "to_id").distinct()


def fan_in(edges: DataFrame) -> DataFrame:
    """Distinct nodes that depend on each id."""
    return _distinct_pairs(edges).groupBy(F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))


def fan_out(edges: DataFrame) -> DataFrame:
    """Distinct nodes each id depends on."""
    return _distinct_pairs(edges).groupBy(F.col("from_id").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))


def coupling_scores(edges: DataFrame) -> DataFrame:
    """Both degrees of every id that takes part in an edge.

    The edge bag is scanned once and made distinct on the whole pair, which
    spreads a hub's edges over all reducers; every pair then adds one to each
    end, summed on the map side before the second shuffle.
    """
    ends = _distinct_pairs(edges).select(
        F.explode(
            F.array(
                F.struct(F.col("to_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
                F.struct(F.col("from_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
            )
        ).alias("e")
    )
    return (
        ends.groupBy(F.col("e.id").alias("id"))
        .agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
        .withColumn("total", F.col("fan_in") + F.col("fan_out"))
    )


def top_coupled(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """Nodes by total coupling, ties by id.  ``limit`` <= 0 keeps all.

    Dangling endpoints count as neighbours but are not ranked themselves.  With
    a limit only the ids of the nodes take part in the ranking; the other
    columns are fetched for the rows that remain.
    """
    scores = coupling_scores(edges)
    if limit > 0:
        known = scores.join(nodes.select("id"), "id", "left_semi")
        scores = known.orderBy(F.desc("total"), "id").limit(limit)
    return scores.join(nodes, "id").orderBy(F.desc("total"), "id")
