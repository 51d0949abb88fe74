from weftgraph.llm import url_filter

PAGES = [
    (1, "https://a.example.net/en/x", None),
    (2, "http://B.net/x?q#f", ""),
    (3, "http://shop.example.com/de/1", "<p>no links</p>"),
    (4, "http://other.example.com/fr/1", '<link rel="canonical" href="http://shop.example.com/de/1#top">'),
    (5, "http://far.test/a/b", '<META HTTP-EQUIV="Refresh" CONTENT="0; URL=http://other.example.com/fr/1">'),
    (6, "http://x.org/fr/1", "<link href='//other.example.com/fr/1' rel='canonical'>"),
    (7, "no scheme", '<link rel=canonical href="http://shop.example.com/de/1">'),
    (8, None, '<link rel=canonical href="http://shop.example.com/de/1">'),
    (9, "http://free.test/", '<link rel="canonical" href="/start">'),
    (10, "http://example.net.test/en/", None),
    (11, "http://mynet/", None),
    (2, "http://B.net/x?q#f", ""),
    (12, "http://far.test/a/c", '<link rel="canonical" href="b">'),
]


def judged(spark, rows, redirects=None):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r.page_id: r for r in url_filter.judged(pages.selectExpr("*", "1 AS host", "2 AS own", "3 AS node"), redirects).collect()}


def test_rules_and_aliases(spark):
    got = judged(spark, PAGES)
    assert {k: (r.host, r.path, r.rule, r.verdict) for k, r in got.items()} == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"),
        2: ("b.net", "/x", "net/", "block"),
        3: ("shop.example.com", "/de/1", "example.com/de/", "block"),
        4: ("other.example.com", "/fr/1", None, "block"),
        5: ("far.test", "/a/b", None, "block"),
        6: ("x.org", "/fr/1", "org/fr/", "allow"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("free.test", "/", None, "allow"),
        10: ("example.net.test", "/en/", None, "allow"),
        11: ("mynet", "/", None, "allow"),
        12: ("far.test", "/a/c", None, "block"),
    }
    assert got[4].alias and not got[3].alias


def test_redirect_table_and_empty(spark):
    table = spark.createDataFrame([("http://free.test/", "http://b.net/"), (None, "http://b.net/")], "from_url string, to_url string")
    assert judged(spark, PAGES, table)[9].verdict == "block"
    assert judged(spark, []) == {}


def test_sql_agrees(spark):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("pages", pd.DataFrame(PAGES, columns=["page_id", "url", "html"]))
    want = {r[0]: r[1:] for r in con.execute(url_filter.SQL).fetchall()}
    assert {k: (r.host, r.path, r.rule, r.verdict, r.alias) for k, r in judged(spark, PAGES).items()} == want
