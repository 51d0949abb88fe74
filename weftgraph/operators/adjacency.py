"""Edges stored for traversals, and levels stored for anti joins.

An index holds the edges of one direction by their start: a table bucketed by
``src``, so a large level is joined without an exchange of the edges and a small
one reads only the buckets of its ids; and the edges of hubs, the few starts
that hold more than a bucket's share, in plain files that are joined by
broadcast or split by adaptive execution.  An index that is saved is sorted as
well, for lookups; one of a single search is made only if the search goes on
beyond its first levels.

Levels of a traversal are kept by size: small ones as partitions of one folder,
which are broadcast; large ones in a table bucketed by their key, so "not seen
before" is an anti join in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.session import bucketed, materialize, registered, scratch_path, write_counted

#: Rows from which a level is kept in buckets; starts that are looked up by value.
LARGE, LOOKUP = 1 << 18, 200
#: Edges of a bucket, edges that a hub has at least, edges from which an index is worth its shuffle.
BUCKET_EDGES, HUB, INDEXED = 1 << 23, 1 << 16, 1 << 22
#: Levels of a search that read the edges as they are given; later ones store them first.
DIRECT = 2
#: Classes of starts that are counted to find hubs; rows of one bucket that a task may hold in a hash table.
CLASSES, HASHED = 1 << 16, 1 << 19


def _buckets(spark: SparkSession, n: int = 0) -> int:
    # Fewer buckets than shuffle partitions would make Spark shuffle both sides.
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET_EDGES))


class Edges:
    """The edges of one search: an index, or a DataFrame that is stored once the search has read it ``DIRECT`` times.

    A search of few levels thus stores nothing.  ``repeats`` tells that many rows of
    a level may share an id, so a level is no table to be hashed.
    """

    def __init__(self, given: DataFrame | list[DataFrame]):
        self._parts, self._stored = (given, True) if isinstance(given, list) else ([given], False)
        self._read, self.repeats = 0, False
        self.sparkSession, self.schema = self._parts[0].sparkSession, self._parts[0].schema

    def met(self, frontier: DataFrame, n: int) -> DataFrame:
        """``met`` of the parts that suit the next level."""
        if not self._stored and self._read >= DIRECT:
            self._parts, self._stored = stored_once(self._parts[0], ordered=self.repeats), True
        self._read += 1
        return met(self._parts, frontier, n, hashed=not self.repeats)


def task_rows(spark: SparkSession) -> int:
    """Rows that differ in their key and may be hashed by all tasks of a shuffle together."""
    return _buckets(spark) * HASHED


def stored_once(adjacency: DataFrame, ordered: bool = True) -> list[DataFrame]:
    """The edges written once: as an index if they are many."""
    spark = adjacency.sparkSession
    edges, classes = _counted(adjacency)
    if edges >= INDEXED:
        path = scratch_path(spark, "index")
        return stored(spark, path, _write_index(adjacency, path, edges, classes, ordered), adjacency.schema)
    path = scratch_path(spark, "edges")
    adjacency.write.parquet(path)
    return [spark.read.schema(adjacency.schema).parquet(path)]


def index(adjacency: DataFrame) -> list[DataFrame]:
    """(src, dst, kind, seq) as an index in the scratch folder; its parts are joined one by one."""
    path = scratch_path(adjacency.sparkSession, "index")
    return stored(adjacency.sparkSession, path, write_index(adjacency, path), adjacency.schema)


def write_index(adjacency: DataFrame, path: str) -> str:
    """Write the index to ``path`` and return its layout, which a reader has to know."""
    return _write_index(adjacency, path, *_counted(adjacency), ordered=True)


def _class() -> Column:
    return F.pmod(F.xxhash64("src"), F.lit(CLASSES)).cast("int")


def _counted(adjacency: DataFrame) -> tuple[int, dict[int, int]]:
    """How many edges there are, in all and by classes of starts; at most ``CLASSES`` numbers."""
    classes = {r.c: r.n for r in adjacency.groupBy(_class().alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return sum(classes.values()), classes


def _write_index(adjacency: DataFrame, path: str, edges: int, classes: dict[int, int], ordered: bool) -> str:
    spark, columns = adjacency.sparkSession, ["src", "dst", "kind", "seq"]
    buckets = _buckets(spark, edges)
    # A hub holds more than a bucket's share, so there are fewer hubs than buckets, and its class holds no less.
    share = max(edges // buckets, HUB)
    full = [c for c, n in classes.items() if n > share]
    hubs = []
    if full:
        degrees = adjacency.where(_class().isin(full)).groupBy("src").agg(F.count(F.lit(1)).alias("n"))
        hubs = [(r.src,) for r in degrees.where(F.col("n") > share).select("src").collect()]
    rest = adjacency
    if hubs:
        named = F.broadcast(spark.createDataFrame(hubs, "src string"))
        adjacency.join(named, "src", "left_semi").select(columns).write.parquet(f"{path}/hubs")
        rest = adjacency.join(named, "src", "left_anti")
    bucketed(rest.select(columns), f"{path}/buckets", buckets, ["src"], ["src", "dst"] if ordered else [])
    return f"{buckets} with hubs" if hubs else str(buckets)


def stored(spark: SparkSession, path: str, layout: str, schema: T.StructType) -> list[DataFrame]:
    """The parts of the index at ``path``."""
    buckets, _, hubs = layout.partition(" ")
    parts = [registered(spark, f"{path}/buckets", schema, int(buckets), ["src"], ["src", "dst"])]
    return [*parts, spark.read.schema(schema).parquet(f"{path}/hubs")] if hubs else parts


def met(parts: list[DataFrame], frontier: DataFrame, n: int, hashed: bool = False) -> DataFrame:
    """Edges that start in one of the ``n`` rows of ``frontier`` (id, ...), with its columns.

    ``hashed`` tells that few rows share an id: then a large level lies evenly in the
    buckets and is hashed there if a task can hold its share, so edges need no sort.
    """
    ids = [r.id for r in frontier.select("id").distinct().collect()] if n <= LOOKUP else None  # at most LOOKUP values
    out, buckets = None, _buckets(parts[0].sparkSession)
    if hashed and LARGE <= n <= buckets * HASHED:
        frontier = frontier.hint("shuffle_hash")
    for part in parts:
        part = part if ids is None else part.where(F.col("src").isin(ids))
        joined = part.join(frontier, F.col("src") == F.col("id")).drop("id")
        out = joined if out is None else out.unionByName(joined)
    return out


class Levels:
    """Rows of a traversal by distance, with what tells whether a key was met before."""

    def __init__(self, spark: SparkSession, label: str, schema: str, keys: list[str]):
        self.spark, self.keys, self.buckets = spark, keys, _buckets(spark)
        self.schema = spark.createDataFrame([], schema).schema
        self.whole = T.StructType(self.schema.fields + [T.StructField("distance", T.IntegerType())])
        self.base = scratch_path(spark, label)
        self.small: set[int] = set()
        self.stored = 0
        self.table: DataFrame | None = None

    def add(self, distance: int, rows: DataFrame, large: bool) -> int:
        """Keep the rows of a distance and return how many there are."""
        rows = rows.select(*self.schema.fieldNames())
        if large:
            rows = rows.withColumn("distance", F.lit(distance))
            self.table = bucketed(rows, f"{self.base}/large", self.buckets, self.keys, [], by=["distance"])
            found = self.level(distance).count()
            self.stored += found
            return found
        self.small.add(distance)
        return write_counted(rows, f"{self.base}/small/distance={distance}")

    def numbered(self, distance: int) -> DataFrame:
        """A level whose place by rank, trail and id is its rank.

        Ranks count within a root, so numbers may be compared before roots.
        """
        rows = self.level(distance).sort("rank", "trail", "root", "id")
        rows = rows.withColumn("rank", F.monotonically_increasing_id()).withColumn("trail", F.array().cast(self.schema["trail"].dataType))
        return materialize(rows, "numbered")

    def level(self, distance: int) -> DataFrame:
        if distance in self.small:
            return self.spark.read.schema(self.schema).parquet(f"{self.base}/small/distance={distance}")
        return self.table.where(F.col("distance") == distance).drop("distance")

    def unseen(self, rows: DataFrame) -> DataFrame:
        for part in self._parts():
            seen = part.select(*self.keys)
            # Keys are met once, so they lie evenly in the buckets.
            if part is self.table and LARGE <= self.stored <= self.buckets * HASHED:
                seen = seen.hint("shuffle_hash")
            rows = rows.join(seen, self.keys, "left_anti")
        return rows

    def rows(self) -> DataFrame:
        first, *rest = self._parts()
        for part in rest:
            first = first.unionByName(part.select(*first.columns))
        return first

    def _parts(self) -> list[DataFrame]:
        small = [self.spark.read.schema(self.whole).parquet(f"{self.base}/small")] if self.small else []
        return small + ([self.table] if self.table is not None else [])
