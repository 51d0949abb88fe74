"""Mixing sources to target weights by systematic sampling.

Targets: all words of the corpus are shared among the sources by weight; a
source's target stops at ``most`` times its own words, and what it cannot take
is shared again among the others by weight, until none is above.

Sampling: every document of a source is expected ``target / words`` times.  The
expectations are summed up along the source and shifted by one offset per
source; a document is taken once for every whole number that its own step
crosses.  The order is by size, so documents of every size are taken in
proportion and a source's taken words miss its target by about one document.

Places along a source come from a range sort: row numbers inside each range and
a table with one row per range and source for what lies before.  No source is
in one task, however large.  The table of sources has one row per source.

Defined cases: null text or a text without words has size 0 and takes 0 words;
null is a source of its own, sorted last; repeated rows are sampled like any
others; an empty table gives an empty result.  Sums are exact, ties are broken
by id and offsets come from the source's name, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import row_key
from weftgraph.session import materialize

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size, target of each (source, source_size)."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(every) - 1) % len(weights)
    weighted = sources.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1).alias("w"))
    # Sources fill up in the order of (limit / weight); before each, what is left is shared by the weights that are left.
    full = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    ahead = full.rowsBetween(Window.unboundedPreceding, -1)
    rest = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    limited = weighted.withColumns({"limit": F.col("source_size") * most, "ratio": F.col("source_size") * most / F.col("w")})
    seen = limited.withColumns(
        {
            "before": F.coalesce(F.sum("limit").over(ahead), F.lit(0)),
            "weight": F.sum("w").over(rest),
            "total": F.sum("source_size").over(Window.partitionBy(F.lit(1))),
        }
    )
    level = seen.withColumn("level", (F.col("total") - F.col("before")) / F.col("weight"))
    # The first source that its share does not fill fixes the level for itself and all after it.
    open_level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(Window.partitionBy(F.lit(1)))["level"]
    share = F.col("w") * open_level
    return level.select("source", "source_size", F.when(F.col("limit") <= share, F.col("limit").cast("double")).otherwise(share).alias("target"))


def sampled(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3, seed: int = 7) -> DataFrame:
    """Row key, doc_id, source, size, source_size, target, copies and taken of every row."""
    count = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select("doc_id", "source", count.alias("size"), *row_key(docs))
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id"), F.col("k_hash")]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    rows = materialize(spread, "mixing")
    ranges = rows.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    ranges = materialize(ranges, "mixing-ranges")
    wanted = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranges.select("source", "part", F.coalesce(before, F.lit(0)).alias("before"))
    plan = offsets.join(wanted.withColumnRenamed("source", "w_source"), F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
    plan = plan.withColumnRenamed("source", "p_source").withColumnRenamed("part", "p_part")
    inside = F.row_number().over(Window.partitionBy("part", "source").orderBy("size", F.xxhash64("doc_id", F.lit(seed)), "doc_id", "k_hash"))
    placed = rows.withColumn("inside", inside)
    placed = placed.join(plan, (placed["part"] == plan["p_part"]) & placed["source"].eqNullSafe(plan["p_source"]))
    place = (F.col("before") + F.col("inside")).cast("double")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    crossed = F.floor(place * F.col("e") + offset) - F.floor((place - 1) * F.col("e") + offset)
    # Rounding can't take a document more or less often than its step allows.
    copies = F.least(F.greatest(crossed, F.floor("e")), F.ceil("e")).cast("long")
    placed = placed.withColumn("e", expected).withColumn("copies", copies)
    return placed.select("k_id", "k_hash", "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3, seed: int = 7) -> DataFrame:
    """``docs`` with every row as often as it is taken.  Rows that agree in id, text, language and source are one row."""
    times = sampled(docs, weights, most, seed).groupBy("k_id", "k_hash").agg(F.sum("copies").alias("times"))
    times = times.where(F.col("times") > 0).select(F.col("k_id").alias("t_id"), F.col("k_hash").alias("t_hash"), "times")
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *row_key(docs))
    met = keyed.join(times, (keyed["k_hash"] == times["t_hash"]) & keyed["k_id"].eqNullSafe(times["t_id"]))
    once = met.dropDuplicates(["k_id", "k_hash"])
    return once.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
