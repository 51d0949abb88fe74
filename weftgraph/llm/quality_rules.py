"""Quality rules: robust multivariate outliers among document statistics.

Every document gets a vector of transformed statistics.  For each (language,
source) the minimum-covariance-determinant estimate of centre and scatter is
found by concentration steps: start from medians and absolute deviations, keep
the fraction ``SUPPORT`` of rows with the smallest distances, take their mean
and covariance, repeat.  Rows whose squared Mahalanobis distance from the final
estimate exceeds ``CUTOFF`` are rejected.

A group with too few rows for an estimate is judged one level up: by the
estimate of its language over all sources, or, if that has too few rows as well,
by that of the whole corpus.  Both come from the same steps.

Everything is DataFrame functions.  A text is read once and reduced to one
narrow row, which is written to the scratch folder; the steps scan only that.
A group's quantile is written before rows are joined to it: its size is known
then, so rows need no shuffle for a small table, and plans stay small, which
the driver makes, compiles and logs anew at each of their stages.
Quantiles come from counts per value on a grid, so they are exact on the grid,
need no sort of a group in one task, and repeat from run to run.  Estimates are
a table with a row per group; nothing is collected.

Defined cases: null text counts as empty; null language or source is a group of
its own; groups with fewer than ``MIN_ROWS`` rows that passed the base rules
have no distance of their own but a ``wider_distance``; only if the whole table
has fewer such rows is there nothing to compare with, and what passed the base
rules is kept; equal rows get equal verdicts;
an empty table gives an empty result.  Only ``doc_id``, ``text``, ``lang`` and
``source`` are read, so further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import SPACE, row_key, without, words
from weftgraph.session import materialize

#: Fraction of a group's rows that the estimate rests on.
SUPPORT = 0.75
#: Concentration steps after the starting estimate.
STEPS = 4
#: Squared distance beyond which a row is an outlier (in units where the median row has the chi-square median).
CUTOFF = 180.0
#: Groups with fewer rows have no estimate of their own.
MIN_ROWS = 24
#: Least standard deviation of each transformed statistic: variation below it is never unusual.
FLOORS = {
    "v_words": 0.5,
    "v_length": 0.1,
    "v_symbols": 0.02,
    "v_lines": 0.05,
    "v_repeats": 0.05,
    "v_upper": 0.03,
}
VECTOR = list(FLOORS)
#: Median of the chi-square distribution with len(VECTOR) degrees of freedom, by Wilson and Hilferty's formula.
MEDIAN = len(VECTOR) * (1 - 2 / (9 * len(VECTOR))) ** 3
GRID = 256.0


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the row key, counts of the base rules, base_failed and the transformed vector."""
    text = F.coalesce(F.col("text"), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lines = F.filter(F.split(F.col("t"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select("doc_id", "lang", "source", *row_key(docs), text.alias("t"))
    d = d.withColumns(
        {
            "w": words(F.col("t")),
            "lines": lines,
            "word_chars": F.char_length(F.regexp_replace("t", SPACE + "+", "")).cast("long"),
            "n_symbols": (F.char_length("t") - F.char_length(F.translate("t", "#*$%&|<>", ""))).cast("long"),
            "n_upper": (F.char_length("t") - F.char_length(F.translate("t", upper, ""))).cast("long"),
        }
    )
    d = d.withColumns(
        {
            "n_words": F.size("w").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "grams": F.when(
                F.size("w") >= 3,
                F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    ).drop("w", "lines", "t")
    # Windows found twice: neighbours in the sorted list of (hash, place).
    twice = F.size(F.array_distinct("grams")) < F.size("grams")
    placed = F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    d = d.withColumn("by_hash", F.when(twice, F.array_sort(placed)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("grams")
    d = d.withColumn(
        "starts",
        F.array_sort(
            F.transform(
                F.filter("by_hash", lambda x, i: F.coalesce(F.get("by_hash", i + 1)["h"] == x["h"], F.lit(False)) | ((i > 0) & F.coalesce(F.get("by_hash", i - 1)["h"] == x["h"], F.lit(False)))),
                lambda x: x["i"],
            )
        ),
    ).drop("by_hash")
    covered = F.transform("starts", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("starts", i + 1) - p, F.lit(3))))
    d = d.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0), lambda a, b: a + b).cast("long")).drop("starts")
    n = F.greatest(F.col("n_words"), F.lit(1))
    return d.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "v_words": F.log1p("n_words"),
            "v_length": F.log1p(F.col("word_chars") / n),
            "v_symbols": F.log1p(F.col("n_symbols") / n),
            "v_lines": F.log1p(F.col("n_dup_lines").cast("double")) / F.lit(4.0),
            "v_repeats": F.sqrt(F.col("n_repeat_words") / n),
            "v_upper": F.sqrt(F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))),
        }
    )


def _grouped(left: DataFrame, right: DataFrame, few: bool = False) -> DataFrame:
    """Rows with their group's estimate; groups are few beside rows, so Spark may broadcast them if they are small.

    ``few``: groups are languages or one, so a shuffle would gather all rows in as many tasks.
    """
    r = (F.broadcast(right) if few else right).withColumnRenamed("lang", "g_lang").withColumnRenamed("source", "g_source")
    return left.join(r, left["lang"].eqNullSafe(r["g_lang"]) & left["source"].eqNullSafe(r["g_source"])).drop("g_lang", "g_source")


def _quantile(rows: DataFrame, keys: list[str], value: Column, q: float, name: str) -> DataFrame:
    """The least grid value that a fraction ``q`` of a group does not exceed."""
    counts = rows.groupBy(*keys, F.ceil(value * GRID).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    # A group's values on the grid are few, however many rows it has.
    lists = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("l"), F.sum("n").alias("total"))
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("b"))
    found = F.aggregate(
        "l",
        start,
        lambda a, x: F.struct(
            (a["seen"] + x["n"]).alias("seen"),
            F.when(a["b"].isNull() & (a["seen"] + x["n"] >= F.col("total") * q), x["b"]).otherwise(a["b"]).alias("b"),
        ),
    )
    return lists.select(*keys, (found["b"] / GRID).alias(name), "total")


def _lower(i: int, j: int) -> str:
    return f"l_{i}_{j}"


def _distance(rows: DataFrame) -> DataFrame:
    """Squared distance by forward substitution in the triangular factor, two rows of it in a projection."""
    for start in range(0, len(VECTOR), 2):
        made: dict[int, Column] = {}
        for i in range(start, min(start + 2, len(VECTOR))):
            rest = F.col(VECTOR[i]) - F.col(f"m_{i}")
            for j in range(i):
                rest = rest - F.col(_lower(i, j)) * made.get(j, F.col(f"z_{j}"))
            made[i] = rest / F.col(_lower(i, i))
        rows = rows.withColumns({f"z_{i}": z for i, z in made.items()})
    return rows.withColumn("d2", sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(len(VECTOR))), F.lit(0.0)))


def _factor(estimate: DataFrame) -> DataFrame:
    """Cholesky factor of each group's scatter; the least deviations are added to its diagonal.

    A projection makes what is below the diagonal in one column, and the diagonal of the next.
    """
    made: dict[str, Column] = {}

    def entry(i: int, j: int) -> Column:
        at = lambda a, b: made.get(_lower(a, b), F.col(_lower(a, b)))
        rest = F.col(f"c_{i}_{j}")
        if i == j:
            rest = rest + F.lit(FLOORS[VECTOR[i]] ** 2)
        for k in range(j):
            rest = rest - at(i, k) * at(j, k)
        return F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / at(j, j)

    estimate = estimate.withColumn(_lower(0, 0), entry(0, 0))
    for j in range(len(VECTOR) - 1):
        made = {}
        for i in range(j + 1, len(VECTOR)):
            made[_lower(i, j)] = entry(i, j)
        made[_lower(j + 1, j + 1)] = entry(j + 1, j + 1)
        estimate = estimate.withColumns(made)
    return estimate


def _columns() -> list[str]:
    p = range(len(VECTOR))
    return ["lang", "source", *[f"m_{i}" for i in p], *[_lower(i, j) for i in p for j in range(i + 1)]]


def _start(rows: DataFrame, few: bool) -> DataFrame:
    """Medians and absolute deviations of each statistic alone."""
    long = rows.select("lang", "source", F.posexplode(F.array(*VECTOR)).alias("v", "x"))
    middle = materialize(_quantile(long, ["lang", "source", "v"], F.col("x"), 0.5, "m"), "quality-middle")
    middle = middle.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.col("v").alias("g_v"), "m", "total")
    middle = F.broadcast(middle) if few else middle
    off = long.join(middle, long["lang"].eqNullSafe(middle["g_lang"]) & long["source"].eqNullSafe(middle["g_source"]) & (long["v"] == middle["g_v"]))
    spread = _quantile(off.withColumn("r", F.abs(F.col("x") - F.col("m"))), ["lang", "source", "v", "m"], F.col("r"), 0.5, "s")
    p = range(len(VECTOR))
    wide = spread.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("v") == i, F.col("m"))).alias(f"m_{i}") for i in p],
        *[F.max(F.when(F.col("v") == i, F.col("s") * 1.4826)).alias(f"s_{i}") for i in p],
        F.max("total").alias("rows"),
    )
    wide = wide.where(F.col("rows") >= MIN_ROWS)
    for i in p:
        for j in range(i + 1):
            value = F.sqrt(F.col(f"s_{i}") * F.col(f"s_{i}") + FLOORS[VECTOR[i]] ** 2) if i == j else F.lit(0.0)
            wide = wide.withColumn(_lower(i, j), value)
    return wide.select(*_columns())


def _concentrate(rows: DataFrame, estimate: DataFrame, few: bool) -> DataFrame:
    """Mean and covariance of the rows nearest to the last estimate."""
    near = _distance(_grouped(rows, estimate, few)).select("lang", "source", *VECTOR, F.sqrt("d2").alias("d"))
    bound = materialize(_quantile(near, ["lang", "source"], F.col("d"), SUPPORT, "bound").drop("total"), "quality-bound")
    core = _grouped(near, bound, few).where(F.ceil(F.col("d") * GRID) <= F.col("bound") * GRID)
    p = range(len(VECTOR))
    fit = core.groupBy("lang", "source").agg(
        *[F.avg(v).alias(f"m_{i}") for i, v in enumerate(VECTOR)],
        *[F.covar_pop(VECTOR[i], VECTOR[j]).alias(f"c_{i}_{j}") for i in p for j in range(i + 1)],
    )
    return _factor(fit).select(*_columns())


def _estimates(good: DataFrame, few: bool = False) -> DataFrame:
    """Centre, factor and scale of every (lang, source) with at least ``MIN_ROWS`` rows."""
    estimate = materialize(_start(good, few), "quality-start")
    for _ in range(STEPS):
        estimate = materialize(_concentrate(good, estimate, few), "quality-step")
    # Scale: the median row of a group has the median distance of a normal sample.
    near = _distance(_grouped(good, estimate, few)).select("lang", "source", F.sqrt("d2").alias("d"))
    middle = materialize(_quantile(near, ["lang", "source"], F.col("d"), 0.5, "mid").drop("total"), "quality-scale")
    # A spread below the floors is no reason to magnify distances.
    scale = F.greatest(F.col("mid") * F.col("mid") / MEDIAN, F.lit(1.0)).alias("scale")
    return _grouped(estimate, middle.select("lang", "source", scale), few).select(*_columns(), "scale")


def _wider(good: DataFrame) -> DataFrame:
    """Estimates for the groups that have too few rows for their own: lang, source and the columns of an estimate."""
    none = F.lit(None).cast("string")
    counts = materialize(good.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), "quality-groups")
    small = counts.where(F.col("n") < MIN_ROWS).select("lang", "source")
    over = counts.groupBy(F.col("lang").alias("o_lang")).agg(F.sum("n").alias("o_n"))
    small = materialize(small.join(over, small["lang"].eqNullSafe(over["o_lang"])).select("lang", "source", "o_n"), "quality-small")
    by_lang, by_all = small.where(F.col("o_n") >= MIN_ROWS), small.where(F.col("o_n") < MIN_ROWS)
    found = []
    if not by_lang.isEmpty():
        langs = by_lang.select(F.col("lang").alias("o_lang")).distinct()
        rows = good.join(F.broadcast(langs), good["lang"].eqNullSafe(langs["o_lang"]), "left_semi")
        up = _estimates(materialize(rows.withColumn("source", none), "quality-languages"), few=True)
        found.append((by_lang, up.drop("source").withColumnRenamed("lang", "u_lang")))
    if not by_all.isEmpty():
        up = _estimates(materialize(good.withColumns({"lang": none, "source": none}), "quality-corpus"), few=True)
        found.append((by_all, up.drop("lang", "source").withColumn("u_lang", none)))
    out = None
    for groups, up in found:
        met = groups["lang"].eqNullSafe(up["u_lang"]) if groups is by_lang else F.lit(True)
        part = groups.join(F.broadcast(up), met).select(*_columns(), "scale")
        out = part if out is None else out.unionByName(part)
    return out


def judged(docs: DataFrame) -> DataFrame:
    """A row per document: key, counts, base_failed, distance, wider_distance and kept.

    ``distance`` is from the estimate of the document's own group, ``wider_distance`` from the one that stands in for it.
    """
    rows = materialize(statistics(docs), "quality")
    good = rows.where(~F.col("base_failed")).select("lang", "source", *VECTOR)
    scaled = _estimates(good).withColumn("own", F.lit(True))
    wider = _wider(good)
    if wider is not None:
        scaled = scaled.unionByName(wider.withColumn("own", F.lit(False)))
    scaled = materialize(scaled, "quality-scaled")
    scaled = scaled.withColumnRenamed("lang", "g_lang").withColumnRenamed("source", "g_source")
    out = rows.join(scaled, rows["lang"].eqNullSafe(scaled["g_lang"]) & rows["source"].eqNullSafe(scaled["g_source"]), "left")
    out = _distance(out).withColumn("any_distance", F.col("d2") / F.col("scale"))
    out = out.withColumns({"distance": F.when(F.col("own"), F.col("any_distance")), "wider_distance": F.when(~F.col("own"), F.col("any_distance"))})
    kept = ~F.col("base_failed") & F.coalesce(F.col("any_distance") <= CUTOFF, F.lit(True))
    return out.select("doc_id", "k_id", "k_hash", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *VECTOR, "distance", "wider_distance", kept.alias("kept"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows; all columns stay."""
    bad = judged(docs).where(~F.col("kept")).select("k_id", "k_hash").distinct()
    return without(docs, bad)
