"""Line dedup by site-relative frequency.

A page's markup is cut into lines of text.  For every host, the pages that hold
a line are divided by the host's pages; lines above ``RATIO`` on at least
``LEAST`` pages are boilerplate of that site and are dropped from its pages.

The markup is read once and its lines are written to the scratch folder.  Lines
are counted by a 128-bit hash with map-side sums, so neither a large site nor a
very common line gathers in one task.  What comes back to a page are the places
of its own dropped lines, in order; the lines between them are cut out as
slices, so a page costs in proportion to its lines.

Defined cases: null or empty html has no lines and counts as a page; a null url
or one without ``://`` belongs to the empty host; a line that a page repeats
counts once for it and is dropped in all places; repeated rows are pages of
their own; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.url_filter import host
from weftgraph.session import materialize

RATIO, LEAST = 0.2, 2
#: What has no text, what ends a line, and what else is markup.
NO_TEXT = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
BREAK = r"(?is)</?(?:p|div|h[1-6]|li|ul|ol|br|hr|tr|td|th|table|article|section|nav|header|footer|main|title|body|head|html|form|blockquote|pre)\b[^>]*>"
MARKUP = r"(?s)<[^>]*>"
BLANK = r"[ \t\r\f]+"

SQL = f"""
WITH rows AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{NO_TEXT}', ' ', 'g'), '{BREAK}', chr(10), 'g'), '{MARKUP}', '', 'g'), '{BLANK}', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines,
  row_number() OVER () AS r FROM rows),
each AS (SELECT DISTINCT r, host, unnest(lines) AS line FROM cut),
total AS (SELECT host, count(*) AS pages FROM cut GROUP BY host),
bad AS (SELECT host, line FROM each JOIN total USING (host) GROUP BY host, line, pages HAVING count(*) >= {LEAST} AND count(*) > {RATIO} * pages),
gone AS (SELECT r, list(line) AS dropped FROM each JOIN bad USING (host, line) GROUP BY r)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(kept) AS BIGINT) AS n_kept, array_to_string(kept, chr(10)) AS text FROM (
  SELECT page_id, host, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(dropped, x), false)) AS kept FROM cut LEFT JOIN gone USING (r))
"""


def lines(html: Column) -> Column:
    text = F.regexp_replace(F.coalesce(html, F.lit("")), NO_TEXT, " ")
    text = F.regexp_replace(F.regexp_replace(text, BREAK, "\n"), MARKUP, "")
    text = F.regexp_replace(text, BLANK, " ")
    return F.array_remove(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), "")


def _hash(line: Column) -> Column:
    # As a string, which array_distinct keeps in a hash set.
    return F.concat(F.hex(F.xxhash64(line)), F.lit("-"), F.hex(F.xxhash64(F.lit(7), line)))


def _between(lines: Column, places: Column) -> Column:
    """The lines without those at ``places``, which ascend from zero."""

    def part(j: Column) -> Column:
        first = F.when(j == 0, 1).otherwise(F.get(places, j - 1) + 2)
        end = F.when(j == F.size(places), F.size(lines)).otherwise(F.get(places, j))
        return F.slice(lines, first, end - first + 1)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), part))


def deduped(pages: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """page_id, host, n_lines, n_kept and text (the kept lines) of every row."""
    cut = pages.select("page_id", F.xxhash64("url", "html").alias("k_hash"), host(F.col("url")).alias("host"), lines(F.col("html")).alias("lines"))
    cut = materialize(cut, "lines")
    each = cut.select("host", F.explode(F.array_distinct(F.transform("lines", _hash))).alias("h"))
    total = cut.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = each.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    bad = counts.join(total, "host").where(F.col("n") > ratio * F.col("pages")).select("host", "h")
    places = cut.select(F.col("page_id").alias("g_id"), F.col("k_hash").alias("g_hash"), "host", F.posexplode(F.transform("lines", _hash)).alias("at", "h"))
    hit = places.join(bad, ["host", "h"], "left_semi")
    gone = hit.groupBy("g_id", "g_hash").agg(F.array_sort(F.collect_set("at")).alias("dropped"))
    out = cut.join(gone, (cut["k_hash"] == gone["g_hash"]) & cut["page_id"].eqNullSafe(gone["g_id"]), "left")
    out = out.withColumn("kept", F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(_between(F.col("lines"), F.col("dropped"))))
    return out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), F.size("kept").cast("long").alias("n_kept"), F.array_join("kept", "\n").alias("text"))
