"""Row-level rules of the property graph."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_write_wins(rows: DataFrame, order: Column, key: str = "id") -> DataFrame:
    """One row per non-empty ``key``: the one with the greatest ``order``.

    ``max_by`` combines on the map side, so a key that holds a large share of
    the rows still sends one row per map task to its reducer.
    """
    others = [c for c in rows.columns if c != key]
    picked = (
        rows.filter(F.col(key).isNotNull() & (F.col(key) != ""))
        .groupBy(key)
        .agg(F.max_by(F.struct(*others), order).alias("_row"))
    )
    return picked.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def valid_edges(edges: DataFrame) -> DataFrame:
    """Edges keep duplicates; only those with an empty endpoint are dropped."""
    return edges.filter((F.col("from_id") != "") & (F.col("to_id") != ""))


def filter_edges(edges: DataFrame, kinds: Iterable[str] = ()) -> DataFrame:
    """Edges of the given kinds; no kinds means all of them."""
    kinds = list(kinds)
    return edges.filter(F.col("kind").isin(kinds)) if kinds else edges


def exclude_defines(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("kind") != "defines")


def outgoing(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "kind", "seq")


def incoming(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), "kind", "seq")


def node_or_stub(ids: DataFrame, nodes: DataFrame, columns: Iterable[str], key: str = "id") -> DataFrame:
    """Attach node columns; an id that is no node gets its id as name and "" elsewhere."""
    columns = list(columns)
    looked_up = nodes.select(F.col("id").alias("_node_id"), *[F.col(c).alias(f"_node_{c}") for c in columns])
    joined = ids.join(looked_up, F.col(key) == F.col("_node_id"), "left")
    for c in columns:
        stub = F.col(key) if c == "name" else F.lit(0 if c.endswith("_line") else "")
        joined = joined.withColumn(c, F.coalesce(F.col(f"_node_{c}"), stub))
    return joined.drop("_node_id", *[f"_node_{c}" for c in columns])


def neighbor(edge_from: Column, edge_to: Column, current: Column) -> Column:
    """The end of an edge that is not ``current``."""
    return F.when(edge_to == current, edge_from).otherwise(edge_to)


def counts_by_language(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("n_files"))
