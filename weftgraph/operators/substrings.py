"""Containment between two sets of strings by an inverted index of n-grams.

A pattern can be in a text only if its rarest gram is.  Grams have three
characters, or all of a shorter pattern, so nothing is missed: texts are listed
under the grams of each length that patterns have, every pattern asks for the
one gram of its own with the fewest texts, and the candidates are verified.
There is no nested loop, and a common gram is asked for only by patterns that
have no rarer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.session import materialize

GRAM = 3


def _grams(text: Column, n: Column | int) -> Column:
    """Different runs of ``n`` characters."""
    n = F.lit(n) if isinstance(n, int) else n
    starts = F.when(F.char_length(text) >= n, F.sequence(F.lit(1), F.char_length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n)))


def contained(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern, text) for all different strings of which the first is part of the second.

    Both inputs have one string column.  An empty pattern is part of every text;
    nulls are part of nothing.
    """
    p = patterns.select(F.col(patterns.columns[0]).alias("pattern")).where("pattern IS NOT NULL").distinct()
    t = texts.select(F.col(texts.columns[0]).alias("text")).where("text IS NOT NULL").distinct()
    asked = materialize(p.select("pattern", F.least(F.char_length("pattern"), F.lit(GRAM)).alias("n")), "patterns")
    sizes = sorted(r.n for r in asked.select("n").distinct().collect())  # at most GRAM + 1 values
    # The empty gram lists every text once, which is what an empty pattern asks for.
    lists = F.flatten(F.array(*[F.array(F.lit("")) if n == 0 else _grams(F.col("text"), n) for n in sizes])) if sizes else F.array().cast("array<string>")
    postings = materialize(t.select("text", F.explode(lists).alias("gram")), "postings")
    known = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    own = asked.select("pattern", F.explode(F.when(F.col("n") == 0, F.array(F.lit(""))).otherwise(_grams(F.col("pattern"), F.col("n")))).alias("gram"))
    weighed = own.join(known, "gram", "left").select("pattern", "gram", F.coalesce("texts", F.lit(0)).alias("texts"))
    rarest = weighed.groupBy("pattern").agg(F.min(F.struct("texts", "gram")).alias("r")).where("r.texts > 0")
    candidates = rarest.select("pattern", F.col("r.gram").alias("gram")).join(postings, "gram")
    return candidates.where(F.contains("text", "pattern")).select("pattern", "text")
