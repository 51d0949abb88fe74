"""Lines of many pages and of very long ones."""

import time

from weftgraph.llm import line_dedup

SCHEMA = "page_id bigint, url string, html string"


def kept(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("lines", "h", "n", "host", "dropped", "at"):
        df = df.withColumn(name, line_dedup.F.lit(1))
    return [(r.page_id, r.n_lines, r.text) for r in line_dedup.deduped(df, **kw).orderBy("page_id").collect()]


def test_half_of_four_pages_is_above_a_fifth(spark):
    page = lambda *lines: "<p>" + "</p><p>".join(lines) + "</p>"
    rows = [(1, "http://a.b/1", page("menu", "one", "menu", "two")), (2, "http://A.b/2", page("menu", "three")), (3, "http://a.b/3", page("four")), (4, "http://a.b/4", None)]
    assert kept(spark, rows) == [(1, 4, "one\ntwo"), (2, 2, "three"), (3, 1, "four"), (4, 0, "")]
    alone = [(9, "http://alone/", page("menu", "menu", "x"))]
    assert kept(spark, alone) == [(9, 3, "menu\nmenu\nx")]
    assert kept(spark, alone, least=1) == [(9, 3, "")]
    twice = rows[:2] + rows[:2]  # repeated rows are pages of their own
    assert kept(spark, twice) == [(1, 4, "")] * 2 + [(2, 2, "")] * 2


def test_pages_of_many_lines_cost_in_proportion(spark):
    lines = [f"line {i}" for i in range(20_000)]
    html = "<p>" + "</p><p>".join(lines) + "</p>"
    rows = [(i, f"http://s/{i}", html.replace("line 7<", f"own {i}<")) for i in range(4)]
    start = time.time()
    assert kept(spark, rows) == [(i, 20_000, f"own {i}") for i in range(4)]
    assert time.time() - start < 60  # over a minute on an idle machine when it was quadratic
