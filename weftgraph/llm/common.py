"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space between words: blank and the five ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text; a null or blank text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+", -1), "")


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality of columns in which null equals null."""
    met = F.lit(True)
    for n in names:
        met = met & left[n].eqNullSafe(right[n])
    return met


def row_key(df: DataFrame) -> list[Column]:
    """What identifies a document row for a verdict: its id and a hash of what the verdict depends on."""
    return [F.col("doc_id").alias("k_id"), F.xxhash64("text", "lang", "source").alias("k_hash")]


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``dropped`` (k_id, k_hash)."""
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *row_key(docs))
    bad = dropped.select(F.col("k_id").alias("b_id"), F.col("k_hash").alias("b_hash"))
    kept = keyed.join(bad, (keyed["k_hash"] == bad["b_hash"]) & keyed["k_id"].eqNullSafe(bad["b_id"]), "left_anti")
    return kept.select("row.*")


def binary_of(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast(T.BinaryType())
