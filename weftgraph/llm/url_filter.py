"""URL filter with redirect equivalence.

Rules name a host and a path prefix and allow or block; a rule fits its host
and all subdomains, and the longest that fits an url decides about it.  Pages
tell which urls mean the same: a ``<link rel="canonical">`` and an immediate
``<meta http-equiv="refresh">`` are edges, and a table of redirects may add
more.  Connected components over these edges carry a block to all aliases of a
blocked url; an url that a rule allows stays allowed whatever its aliases are.

Urls are compared without fragment, with A-Z of scheme and host lowered and
one trailing slash of an otherwise empty path; relative targets are resolved
against the page.  Links are read by JVM expressions in the scan; only urls
with an edge take part in the iteration, whose rounds are written to the shared
scratch folder.  Rules fit by the host's parent domains, so the number of rules
does not multiply the work per url.

Defined cases: a null url, or one without ``://``, has empty host and path,
fits no rule, has no aliases and is allowed; null html has no links; repeated
rows get equal verdicts; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.components import components
from weftgraph.session import materialize

#: (verdict, host, path prefix)
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lowered."""
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _ruled() -> Column:
    """The longest fitting rule as a struct (rule, verdict); null if none fits."""
    return F.coalesce(
        *[
            F.when(
                ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p),
                F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
            )
            for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
        ]
    )


def node(url: Column) -> Column:
    """The form in which urls are compared; null without ``://``."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    start = _lower(F.regexp_extract(bare, r"(?s)^(.*?://[^/?]*)", 1))
    rest = F.regexp_extract(bare, r"(?s)^.*?://[^/?]*(.*)$", 1)
    return F.when(start != "", F.concat(start, F.when(rest == "", F.lit("/")).otherwise(rest)))


def _resolved(base: Column, target: Column) -> Column:
    """``target`` as seen from the page ``base``."""
    t = F.trim(F.regexp_replace(target, "&amp;", "&"))
    scheme = F.regexp_extract(base, r"(?s)^(.*?):", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#/]*)*/)", 1)
    return (
        F.when(t == "", F.lit(None))
        .when(t.contains("://"), t)
        .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
        .when(t.startswith("/"), F.concat(site, t))
        .otherwise(F.concat(F.when(folder == "", F.concat(site, F.lit("/"))).otherwise(folder), t))
    )


def links(pages: DataFrame) -> DataFrame:
    """(a, b) of the urls that a page declares the same as its own."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    # Most pages have no such tag: those leave the plan before any tag is read.
    with_tags = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", F.explode(tags).alias("tag"))
    value = lambda name: F.regexp_extract("tag", rf"""(?is)\b{name}\s*=\s*["']?([^"'>]*)""", 1)
    href = F.regexp_extract("tag", r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'[^']*'|[^\s>"']+)""", 1)
    quoted = F.regexp_extract("tag", r"""(?is)\bhref\s*=\s*'([^']*)'""", 1)
    plain = F.regexp_extract("tag", r"""(?is)\bhref\s*=\s*([^\s>"']+)""", 1)
    canonical = F.when(F.lower(value("rel")).rlike(r"(^|\s)canonical(\s|$)"), F.coalesce(F.nullif(href, F.lit("")), F.nullif(quoted, F.lit("")), plain))
    refresh = F.when(F.lower(F.trim(value("http-equiv"))) == "refresh", F.regexp_extract("tag", r"""(?is)\burl\s*=\s*['"]?([^"'>\s]+)""", 1))
    found = with_tags.select("url", F.coalesce(canonical, refresh).alias("target")).where(F.col("target").isNotNull())
    return found.select(node(F.col("url")).alias("a"), node(_resolved(F.col("url"), F.col("target"))).alias("b"))


def judged(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and alias (true where an alias decided) of every page.

    ``redirects`` has columns ``from_url`` and ``to_url``.
    """
    edges = links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(node(F.col("from_url")), node(F.col("to_url"))))
    edges = materialize(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct(), "links")
    # The url's own rule, and the component of those that have aliases.
    own = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    own = own.withColumn("own", _ruled()).withColumn("node", node(F.col("url")))
    if not edges.take(1):
        blocked = own.select("node").where(F.lit(False))
    else:
        joined = materialize(components(edges, "a", "b"), "aliases")
        parts = joined.select("component", host(F.col("node")).alias("host"), path(F.col("node")).alias("path")).withColumn("own", _ruled())
        bad = parts.where(F.col("own.verdict") == "block").select("component").distinct()
        blocked = joined.join(bad, "component", "left_semi").select("node")
    hit = blocked.select(F.col("node").alias("b_node")).distinct().withColumn("blocked", F.lit(True))
    out = own.join(hit, own["node"] == hit["b_node"], "left")
    by_alias = F.col("own").isNull() & F.coalesce("blocked", F.lit(False))
    verdict = F.coalesce(F.col("own.verdict"), F.when(by_alias, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), by_alias.alias("alias"))


def _sql() -> str:
    """The same judgement of a ``pages`` table in SQL."""

    def low(x: str) -> str:
        return f"translate({x}, '{_UPPER}', '{_LOWER}')"

    def host_of(x: str) -> str:
        return low(f"regexp_extract(coalesce({x}, ''), '(?s)^.*?://([^/?#]*)', 1)")

    def path_of(x: str) -> str:
        return f"regexp_extract(coalesce({x}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"

    def node_of(x: str) -> str:
        bare = f"regexp_replace(trim({x}), '(?s)#.*$', '')"
        start, rest = low(f"regexp_extract({bare}, '(?s)^(.*?://[^/?]*)', 1)"), f"regexp_extract({bare}, '(?s)^.*?://[^/?]*(.*)$', 1)"
        return f"CASE WHEN {start} <> '' THEN {start} || CASE WHEN {rest} = '' THEN '/' ELSE {rest} END END"

    def value(name: str) -> str:
        return f"""regexp_extract(tag, '(?is)\\b{name}\\s*=\\s*["'']?([^"''>]*)', 1)"""

    def ruled(what: str) -> str:
        cases = [
            f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if what == 'rule' else v}'"
            for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
        ]
        return f"CASE {' '.join(cases)} END"

    href = "coalesce(" + ", ".join(f"""nullif(regexp_extract(tag, '(?is)\\bhref\\s*=\\s*{q}', 1), '')""" for q in ('"([^"]*)"', "''([^'']*)''", """([^\\s>"'']+)""")) + ")"
    site, folder = "regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1)", "regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:/[^?#/]*)*/)', 1)"
    return f"""
WITH RECURSIVE tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages WHERE regexp_matches(html, '(?i)canonical|http-equiv')),
found AS (SELECT url, trim(replace(CASE WHEN regexp_matches(lower({value("rel")}), '(^|\\s)canonical(\\s|$)') THEN {href}
  WHEN lower(trim({value("http-equiv")})) = 'refresh' THEN regexp_extract(tag, '(?is)\\burl\\s*=\\s*[''"]?([^"''>\\s]+)', 1) END, '&amp;', '&')) AS t FROM tags),
seen AS (SELECT url, CASE WHEN t = '' THEN NULL WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(url, '(?s)^(.*?):', 1) || ':' || t
  WHEN starts_with(t, '/') THEN {site} || t ELSE CASE WHEN {folder} = '' THEN {site} || '/' ELSE {folder} END || t END AS target FROM found WHERE t IS NOT NULL),
one AS (SELECT {node_of("url")} AS a, {node_of("target")} AS b FROM seen),
edges AS (SELECT a, b FROM one WHERE a <> b UNION SELECT b, a FROM one WHERE a <> b),
ends AS (SELECT DISTINCT a AS node, {host_of("a")} AS host, {path_of("a")} AS path FROM edges),
walk AS (SELECT node FROM ends WHERE {ruled("verdict")} = 'block' UNION SELECT e.b FROM walk w JOIN edges e ON e.a = w.node),
own AS (SELECT page_id, {host_of("url")} AS host, {path_of("url")} AS path, {node_of("url")} AS node FROM pages),
fit AS (SELECT *, {ruled("rule")} AS rule, {ruled("verdict")} AS verdict, coalesce(node IN (SELECT node FROM walk), false) AS hit FROM own)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN hit THEN 'block' ELSE 'allow' END) AS verdict, rule IS NULL AND hit AS alias FROM fit"""


SQL = _sql()
