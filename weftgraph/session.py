"""Scratch tables for iterative jobs.

A loop of joins needs its lineage cut once per round.  Each round is written as
a Parquet table under the cluster's shared checkpoint folder, so a lost
executor costs a re-read, never a restart, and the next round plans its joins
from real file sizes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session that has none gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftgraph-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/weftgraph/{label}-{uuid.uuid4().hex}"


def write_counted(df: DataFrame, path: str) -> int:
    """Write ``df`` as Parquet and return its row count, in one job."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return seen.get["n"]


def materialize(df: DataFrame, label: str, *folders: str) -> DataFrame:
    """Write ``df`` once and read it back; ``folders`` are columns to prune by."""
    path = scratch_path(df.sparkSession, label)
    df.write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _name(path: str) -> str:
    return f"weft_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"


def bucketed(df: DataFrame, path: str, buckets: int, keys: list[str], order: list[str], by: list[str] | None = None) -> DataFrame:
    """Add ``df`` to the bucketed table at ``path``; joins and groups on ``keys`` then need no exchange of it."""
    spark, name = df.sparkSession, _name(path)
    writer = df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys)
    if order:
        writer = writer.sortBy(*order)
    if by:
        writer = writer.partitionBy(*by)
    if not spark.catalog.tableExists(name):
        writer = writer.option("path", path)
    writer.mode("append").saveAsTable(name)
    return spark.table(name)


def registered(spark: SparkSession, path: str, schema: T.StructType, buckets: int, keys: list[str], order: list[str]) -> DataFrame:
    """The bucketed table at ``path``, which another session may have written."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        place = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)
