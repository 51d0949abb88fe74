"""Editor line entries: one per source line that holds ranked symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lens_eligible() -> Column:
    return (F.col("file") != "") & (F.col("kind") != "file") & (F.col("start_line") != 0)


def line_entries(scores: DataFrame) -> DataFrame:
    """(file, line, fan_in, fan_out, impact_target_id, flow_target_id).

    ``scores`` is the unlimited coupling ranking.  An endpoint shares its line
    with its handler: the handler supplies the numbers and the impact target,
    the endpoint the flow target.  Any other group shows its best-ranked symbol.
    Everything is a minimum per group, so map-side combining bounds each group.
    """
    rank = F.struct(
        (-F.col("total")).alias("neg_total"), F.col("id").alias("id"), F.col("fan_in").alias("fan_in"), F.col("fan_out").alias("fan_out")
    )
    is_endpoint = F.col("kind") == "endpoint"
    groups = (
        scores.filter(lens_eligible())
        .groupBy("file", F.col("start_line").alias("line"))
        .agg(
            F.min(rank).alias("best"),
            F.min(F.when(is_endpoint, rank)).alias("endpoint"),
            F.min(F.when(~is_endpoint, rank)).alias("handler"),
        )
    )
    paired = F.col("endpoint").isNotNull() & F.col("handler").isNotNull()
    stats = F.when(paired, F.col("handler")).otherwise(F.col("best"))
    return groups.select(
        "file",
        "line",
        stats["fan_in"].alias("fan_in"),
        stats["fan_out"].alias("fan_out"),
        stats["id"].alias("impact_target_id"),
        F.when(paired, F.col("endpoint.id")).otherwise(F.col("best.id")).alias("flow_target_id"),
    )
