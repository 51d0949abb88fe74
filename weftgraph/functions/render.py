"""Text renderings, as tables of ordered lines.

Each function returns rows (..., order keys, line); sorting them gives the text.
Nothing is assembled on the driver until a caller prints the lines one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.text import display_name, edge_label, mermaid_id, quoted
from weftgraph.operators.model import node_or_stub
from weftgraph.operators.paths import PathLevels
from weftgraph.session import materialize

# What is shown instead of an empty result.
NOTHING_DEPENDS = "Nothing depends on this — safe to change in isolation (no known dependents in the graph)."
NO_DEPENDENCIES = "This doesn't depend on anything else in the graph (no known dependencies)."


def reachable_lines(hits: DataFrame) -> DataFrame:
    """(root, distance, pos, id, line): a heading per distance, then its nodes by id."""
    item = F.concat(
        F.lit("  - "), display_name(), F.lit(" ("), "kind", F.lit(") via "), "via", F.lit(" ["), "file", F.lit("]")
    )
    items = hits.select("root", "distance", F.lit(1).alias("pos"), "id", item.alias("line"))
    heads = (
        hits.select("root", "distance")
        .distinct()
        .select(
            "root",
            "distance",
            F.lit(0).alias("pos"),
            F.lit("").alias("id"),
            F.concat(F.lit("depth "), F.col("distance").cast("string"), F.lit(":")).alias("line"),
        )
    )
    return heads.unionByName(items)


def flow_tree(levels: PathLevels, nodes: DataFrame) -> DataFrame:
    """Paths merged into a tree: one row per different (via, id) prefix.

    Columns: root, depth, place (sorts depth first), label, is_last (no later sibling),
    line.  A level of the tree is made from one level of paths and its parents' row
    numbers.  Of the paths that share a prefix one stands for all, since they go on
    alike; it hands down its place and the stem that lines below it begin with.
    Levels are written once, since each is read for its lines and for the next.
    """
    key = T.StructType().add("seq", levels.seq_type).add("id", "string").add("via", "string")
    empty = F.array().cast(T.ArrayType(key))
    above = levels.level(0).select(
        "root", "pid", "tail", F.lit("").alias("via"), empty.alias("place"), F.lit(True).alias("is_last"), F.lit("").alias("start"), F.lit("").alias("below")
    )
    made = [above]
    for d in range(1, levels.depth + 1):
        step = F.element_at("steps", -1)
        paths = levels.level(d).select("parent", "pid", "tail", step["via"].alias("via"), step["seq"].alias("seq"))
        # One row per child of a node that stands for its prefix.
        kids = paths.groupBy("parent", "via", "tail").agg(F.min(F.struct("seq", "pid")).alias("first"))
        kids = kids.select("parent", F.col("first.pid").alias("pid"), F.struct(F.col("first.seq").alias("seq"), F.col("tail").alias("id"), "via").alias("key"))
        last = kids.groupBy("parent").agg(F.max("key").alias("last"))
        up = above.select("root", F.col("pid").alias("parent"), F.col("place").alias("up"), F.col("below").alias("stem"))
        last_one = F.col("key").eqNullSafe(F.col("last"))
        here = kids.join(last, "parent").join(up, "parent").select(
            "root",
            "pid",
            F.col("key.id").alias("tail"),
            F.col("key.via").alias("via"),
            F.concat("up", F.array("key")).alias("place"),
            last_one.alias("is_last"),
            F.concat("stem", F.when(last_one, "└─► ").otherwise("├─► ")).alias("start"),
            F.concat("stem", F.when(last_one, "     ").otherwise("│    ")).alias("below"),
        )
        above = materialize(here, "tree")
        made.append(above)
    named = node_or_stub(reduce(DataFrame.unionByName, made).withColumnRenamed("tail", "id"), nodes, ["name", "qualified"])
    depth = F.size("place")
    label = F.when(depth == 0, display_name()).otherwise(edge_label(F.col("via"), display_name()))
    return named.select("root", depth.alias("depth"), "place", label.alias("label"), "is_last", F.concat("start", label).alias("line"))


def flow_lines(levels: PathLevels, nodes: DataFrame) -> DataFrame:
    """(root, place, line): the call tree with box-drawing connectors."""
    return flow_tree(levels, nodes).select("root", "place", "line")


def mermaid_lines(levels: PathLevels, nodes: DataFrame) -> DataFrame:
    """(root, place, pos, part, line): a flowchart, each node and edge once, at first sight.

    The last steps of all paths are all sights; walked depth first, the first one
    of a node or edge is the least place.
    """
    sights = levels.last_steps().withColumnRenamed("order_key", "place")
    ids = node_or_stub(sights.groupBy("root", "id").agg(F.min("place").alias("place")), nodes, ["name", "qualified"])
    ids = ids.select("root", "place", mermaid_id(F.col("id")).alias("mid"), display_name().alias("label"))
    boxes = ids.groupBy("root", "mid").agg(F.min("place").alias("place"), F.min_by("label", "place").alias("label"))
    links = (
        sights.filter("pos > 0")
        .groupBy("root", mermaid_id(F.col("prev")).alias("prev"), mermaid_id(F.col("id")).alias("mid"))
        .agg(F.min("place").alias("place"), F.min_by("via", "place").alias("via"))
    )
    box = F.concat(F.lit("    "), "mid", F.lit("["), quoted(F.col("label")), F.lit("]"))
    link = F.concat(F.lit("    "), "prev", F.lit(" -->|"), "via", F.lit("| "), "mid")
    place_type = sights.schema["place"].dataType
    title = levels.level(0).select("root", F.lit(None).cast(place_type).alias("place"), F.lit(-1).alias("pos"), F.lit(0).alias("part"), F.lit("flowchart TD").alias("line"))
    rows = [title]
    for part, (found, line) in enumerate([(boxes, box), (links, link)]):
        rows.append(found.select("root", "place", F.size("place").alias("pos"), F.lit(part).alias("part"), line.alias("line")))
    return reduce(DataFrame.unionByName, rows)


def printed(lines: DataFrame, *order: str) -> Iterator[str]:
    """The lines in order, one partition at a time."""
    for row in lines.orderBy(*order).select("line").toLocalIterator():
        yield row["line"]
