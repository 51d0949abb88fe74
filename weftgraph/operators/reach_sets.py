"""Reachability of many sets of nodes in one backward pass.

Every node carries the set of matchers that it can reach, as words of bits: one
row per node and word that is not empty.  A round moves only bits that are new
to a node, and bits of all matchers together, so a node is visited once per
change and not once per matcher; a cycle settles as soon as nothing is new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.model import incoming
from weftgraph.operators.adjacency import stored_once
from weftgraph.session import materialize, scratch_path, write_counted

#: Bits of a word; the sign bit stays free.
BITS = 63
#: Levels that are summed up in place before they are merged into one table.
LEVELS = 8


def reaching_each(edges: DataFrame, matched: DataFrame, max_depth: int = 0, backward: list[DataFrame] | None = None) -> DataFrame:
    """(matcher, id): ids from which a row of ``matched`` (matcher, id) can be reached along any edge kind.

    A matched id reaches itself.  ``max_depth`` <= 0 has no bound; matchers are any
    strings or numbers, in any number.
    """
    spark = edges.sparkSession
    names = materialize(matched.select("matcher").where("matcher IS NOT NULL").distinct(), "matchers")
    # Ranges of names number the matchers without one task that holds them all.
    numbered = materialize(_numbered(names), "numbered")
    bit = F.expr(f"shiftleft(CAST(1 AS BIGINT), CAST(number % {BITS} AS INT))")
    start = matched.join(numbered, "matcher").groupBy("id", F.floor(F.col("number") / BITS).alias("word")).agg(F.bit_or(bit).alias("bits"))
    parts = backward or stored_once(incoming(edges))
    base, merged, first = scratch_path(spark, "reach-sets"), None, 0
    found, depth = write_counted(start, f"{base}/0"), 0
    while found and (max_depth <= 0 or depth < max_depth):
        newest = spark.read.schema(start.schema).parquet(f"{base}/{depth}")
        met = None
        for part in parts:
            joined = part.select("src", "dst").join(newest, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), "word", "bits")
            met = joined if met is None else met.union(joined)
        met = met.groupBy("id", "word").agg(F.bit_or("bits").alias("met"))
        known = _known(spark, base, start.schema, merged, first, depth)
        fresh = met.join(known, ["id", "word"], "left").select("id", "word", F.col("met").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("bigint")))).alias("bits"))
        depth += 1
        found = write_counted(fresh.where("bits <> 0"), f"{base}/{depth}")
        if depth - first >= LEVELS:
            merged, first = materialize(_known(spark, base, start.schema, merged, first, depth), "reached"), depth + 1
    known = _known(spark, base, start.schema, merged, first, depth)
    held = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit(F.col("bits"), i) == 1)
    flat = known.select("id", F.explode(held).alias("place"), "word")
    return flat.select("id", (F.col("word") * BITS + F.col("place")).alias("number")).join(numbered, "number").select("matcher", "id")


def _known(spark, base, schema, merged: DataFrame | None, first: int, last: int) -> DataFrame:
    """Bits met up to level ``last``: what is merged and the levels since."""
    parts = [] if first > last else [spark.read.schema(schema).parquet(*[f"{base}/{d}" for d in range(first, last + 1)])]
    parts += [merged] if merged is not None else []
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))


def _numbered(names: DataFrame) -> DataFrame:
    """Numbers without gaps: how many names lie in earlier ranges, and the place within the range."""
    sorted_names = materialize(names.repartitionByRange("matcher").sortWithinPartitions("matcher").withColumn("at", F.monotonically_increasing_id()), "sorted-matchers")
    block = F.shiftright("at", 33)
    counts = sorted_names.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    earlier = counts.alias("a").join(counts.alias("b"), F.col("b.block") < F.col("a.block"), "left").groupBy("a.block", "a.first").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return sorted_names.withColumn("block", block).join(earlier, "block").select("matcher", (F.col("before") + F.col("at") - F.col("first")).alias("number"))
