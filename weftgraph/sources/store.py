"""Saved graphs: one folder per analysed target, one sub-folder per save.

    <warehouse>/<slug>/<version>/nodes
    <warehouse>/<slug>/<version>/{edges,edges_by_target}/{buckets,hubs}
    <warehouse>/<slug>/{log,meta}      small append-only tables
    <warehouse>/last                   the target analysed last

A save writes a complete new version and then appends one row to the log, so a
reader sees the old graph or the new one, never a mix.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.adjacency import stored, write_index
from weftgraph.operators.model import incoming, outgoing
from weftgraph.schema import ADJACENCY, EDGES, NODES


class GraphNotFound(LookupError):
    pass


def slug(target: str) -> str:
    """First twelve hex digits of the hash of the target as given."""
    return hashlib.sha1(target.encode()).hexdigest()[:12]


class GraphStore:
    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.warehouse = spark, warehouse.rstrip("/")

    def path(self, target: str) -> str:
        return f"{self.warehouse}/{slug(target)}"

    def _append(self, path: str, key: str, value: str) -> None:
        row = [(time.time_ns(), key, value)]
        self.spark.createDataFrame(row, "at long, key string, value string").coalesce(1).write.mode("append").parquet(path)

    def _latest(self, path: str, key: str) -> str | None:
        try:
            log = self.spark.read.schema("at long, key string, value string").parquet(path)
        except AnalysisException:
            return None
        return log.filter(F.col("key") == key).agg(F.max_by("value", "at").alias("v")).first()["v"]

    def save(self, target: str, nodes: DataFrame, edges: DataFrame) -> str:
        """Write a full new version of the target's graph.

        Edges are stored as two indexes, by either end: a traversal of few ids reads
        their buckets only, and one of many joins without moving the edges.
        """
        version = uuid.uuid4().hex
        base = f"{self.path(target)}/{version}"
        nodes.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{base}/nodes")
        kept = edges.select("from_id", "to_id", "kind", "seq")
        layouts = write_index(outgoing(kept), f"{base}/edges"), write_index(incoming(kept), f"{base}/edges_by_target")
        self._append(f"{self.path(target)}/log", "version", "/".join((version, *layouts)))
        return version

    def load(self, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(nodes, edges, edges by target) of the latest version.

        A version written before nodes had a qualified name reads as "".
        """
        base, layouts = self._version(target)
        nodes = self.spark.read.schema(NODES).parquet(f"{base}/nodes").fillna("", subset=["qualified", "signature", "doc_comment"])
        if not layouts:  # a version from before there were indexes
            edges = self.spark.read.schema(EDGES)
            return nodes, edges.parquet(f"{base}/edges"), edges.parquet(f"{base}/edges_by_target")
        forward, backward = self.indexes(target)
        ends = [F.col("src").alias("from_id"), F.col("dst").alias("to_id")], [F.col("dst").alias("from_id"), F.col("src").alias("to_id")]
        return nodes, *(reduce(DataFrame.unionByName, (p.select(*end, "kind", "seq") for p in parts)) for parts, end in zip((forward, backward), ends))

    def indexes(self, target: str) -> tuple[list[DataFrame], list[DataFrame]] | tuple[None, None]:
        """Indexes of the latest version's edges by start and by target; none in an older store."""
        base, layouts = self._version(target)
        if not layouts:
            return None, None
        return tuple(stored(self.spark, f"{base}/{name}", layout, ADJACENCY) for name, layout in zip(("edges", "edges_by_target"), layouts))

    def _version(self, target: str) -> tuple[str, list[str]]:
        version = self._latest(f"{self.path(target)}/log", "version")
        if version is None:
            raise GraphNotFound(f"no graph found for {target!r} — run analyze on it first")
        version, *layouts = version.split("/")
        return f"{self.path(target)}/{version}", layouts

    def set_meta(self, target: str, key: str, value: str) -> None:
        self._append(f"{self.path(target)}/meta", key, value)

    def get_meta(self, target: str, key: str) -> str:
        """The value set last, "" if there is none."""
        return self._latest(f"{self.path(target)}/meta", key) or ""

    def set_last_target(self, target: str) -> None:
        self._append(f"{self.warehouse}/last", "target", target)

    def resolve_target(self, target: str = "") -> str:
        """The given target, or the one analysed last."""
        found = target or self._latest(f"{self.warehouse}/last", "target")
        if not found:
            raise GraphNotFound("no target given and nothing analysed yet — pass one or run analyze first")
        return found
