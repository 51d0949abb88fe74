import pytest
from pyspark.sql import functions as F

from tests.helpers import make_edges, make_nodes
from weftgraph import ask
from weftgraph.functions import answers, render, text
from weftgraph.operators import lenses, model, paths, search, traverse
from weftgraph.streaming import deltas


def apply(spark, fn, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r["o"] for r in df.select(fn(F.col("v")).alias("o")).collect()]


@pytest.fixture(scope="module")
def symbols(spark):
    return make_nodes(spark, [("s1", "class", "UserService"), ("s2", "class", "UserRepo"), ("s3", "method", "save"), ("s4", "method", "save"), ("s5", "class", "Order")])


def test_find_symbol(symbols):
    assert search.find_symbol(symbols, "s3") == "s3"
    assert search.find_symbol(symbols, "Order") == "s5"
    assert search.find_symbol(symbols, "userser") == "s1"
    with pytest.raises(search.AmbiguousSymbol, match="s3, s4"):
        search.find_symbol(symbols, "save")
    with pytest.raises(search.AmbiguousSymbol, match="s1, s2"):
        search.find_symbol(symbols, "USER")
    with pytest.raises(search.SymbolNotFound):
        search.find_symbol(symbols, "nothing")


def test_lexical_match(symbols):
    # "is" is too short, "save" counts twice, "userservices" contains a name.
    got = search.lexical_match(symbols, "is save SAVE in userservices").collect()
    assert [(r["id"], r["score"]) for r in got] == [("s3", 2), ("s4", 2), ("s1", 1)]
    assert search.lexical_match(symbols, "a b").count() == 0
    assert search.question_words("é éé ab abc") == ["éé", "abc"]


def test_line_entries(spark):
    rows = [
        ("ep", "endpoint", "a.py", 3, 0, 1), ("fn", "function", "a.py", 3, 4, 2), ("solo", "class", "a.py", 9, 1, 1),
        ("x", "class", "b.py", 5, 1, 1), ("y", "class", "b.py", 5, 2, 2), ("file", "file", "b.py", 1, 1, 1), ("z", "class", "b.py", 0, 9, 9),
    ]
    scores = spark.createDataFrame([(*r, r[4] + r[5]) for r in rows], "id string, kind string, file string, start_line int, fan_in long, fan_out long, total long")
    got = {tuple(r) for r in lenses.line_entries(scores).collect()}
    assert got == {("a.py", 3, 4, 2, "fn", "ep"), ("a.py", 9, 1, 1, "solo", "solo"), ("b.py", 5, 2, 2, "y", "y")}


def test_last_write_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("", 9, "no"), (None, 9, "no"), ("b", 1, "b")], "id string, seq int, v string")
    assert {(r["id"], r["v"]) for r in model.last_write_wins(df, F.col("seq")).collect()} == {("a", "z"), ("b", "b")}
    edges = make_edges(spark, [("a", "", "calls"), ("", "b", "calls"), ("a", "b", "calls"), ("a", "b", "defines")])
    assert model.valid_edges(edges).count() == 2
    assert model.filter_edges(edges, ["defines"]).count() == 1 and model.filter_edges(edges).count() == 4


def test_scalars(spark):
    assert apply(spark, text.mermaid_id, "symbol::a/b.go::POST /x-y") == ["n_symbol__a_b_go__POST__x_y"]
    assert apply(spark, text.symbol_label, "symbol::f::A.b", "plain") == ["A.b", "plain"]
    hidden = "a\u00a0b\u200bc\u0085\U000e0001\ue000 \U0001f642日\u0301\x7f"
    assert apply(spark, text.quoted, hidden, "") == ['"a\\u00a0b\\u200bc\\u0085\\U000e0001\\ue000 \U0001f642日\u0301\\x7f"', '""']
    assert apply(spark, text.quoted, 'a"b\\c\n\t\x01é') == ['"a\\"b\\\\c\\n\\t\\x01é"']
    assert apply(spark, lambda c: text.truncated(c, 5), "abcde", "abcdef", "éééé") == ["abcde", "abcd…", "éé…"]
    assert apply(spark, lambda c: text.signature(c, "{"), "func  a(\n b) {x}") == ["func a( b)"]
    assert apply(spark, lambda c: text.signature(c, ":", 4), "abcdef: x") == ["abcd"]
    assert apply(spark, text.commit_suffix, "", "0123456789") == ["", " (commit 01234567)"]
    assert apply(spark, text.normalized_type, "List<Foo>", "Foo?", "Bar[]", " A.B ", "X[]?") == ["List", "Foo", "Bar", "A.B", "X"]
    assert apply(spark, lambda c: text.impact_label(F.lit(3), c), "x") == ["    ↳ x"]
    row = apply(spark, lambda c: text.coupling_line(c, F.lit("class"), F.lit(1), F.lit(22), F.lit(23)), "Name")
    assert row == ["Name" + " " * 36 + " class             1       22       23"]


def test_structured_answer(spark):
    fence = "```"
    full = f"1. EXPLANATION: It works.\n2. MERMAID:\n{fence}mermaid\nflowchart TD\n{fence}\n3. ASCII:\n{fence}\na\n└─► b\n{fence}"
    df = spark.createDataFrame([(1, full), (2, "  only text "), (3, f"EXPLANATION\nx {fence}mermaid\nA{fence}")], "n int, raw string")
    got = {r["n"]: tuple(r["a"]) for r in df.select("n", answers.structured_answer(F.col("raw")).alias("a")).collect()}
    assert got[1] == ("It works.\n2.", "flowchart TD", "a\n└─► b")
    assert got[2] == ("only text", "", "")
    assert got[3] == ("x", "A", "")


def test_mermaid_parts(spark):
    fence = "```"
    raw = f"a {fence}mermaid\nX\n{fence} b {fence}mermaid\nY{fence}{fence}mermaid\nopen"
    df = spark.createDataFrame([(raw,)], "raw string")
    (row,) = df.select(answers.mermaid_parts(F.col("raw")).alias("p")).collect()
    assert [tuple(p) for p in row["p"]] == [("md", "a "), ("mermaid", "X\n"), ("md", " b "), ("mermaid", "Y"), ("md", f"{fence}mermaid\nopen")]


def test_token_streams(spark):
    block = 'data: {"type":"content_block_delta","delta":{"type":"text_delta","text":"%s"}}'
    lines = ["event: x", block % "Hel", "data: {broken", 'data: {"type":"ping"}', "data:", block % "lo"]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(lines)], "stream_id string, line_no int, line string")
    assert deltas.full_text(deltas.content_block_deltas(deltas.sse_data(df))).first()["text"] == "Hello"
    chunk = 'data: {"choices":[{"delta":{"content":"%s"}}]}'
    lines = [chunk % "a", chunk % "", 'data: {"choices":[]}', "data: [DONE]", chunk % "late"]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(lines)], "stream_id string, line_no int, line string")
    assert [r["chunk"] for r in deltas.choice_deltas(deltas.until_done(deltas.sse_data(df))).collect()] == ["a"]
    lines = ['{"message":{"content":"x"}}', "oops", "", '{"error":"no model"}', '{"message":{"content":""}}']
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(lines)], "stream_id string, line_no int, line string")
    assert [(r["chunk"], r["error"]) for r in deltas.ndjson_deltas(df).orderBy("line_no").collect()] == [("x", ""), ("", "no model")]


def test_deltas_on_a_live_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('data: {"type":"content_block_delta","delta":{"type":"text_delta","text":"hi"}}\nevent: y\n')
    lines = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "line")
    chunks = deltas.content_block_deltas(deltas.sse_data(lines))
    query = chunks.writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        assert [r["chunk"] for r in spark.table("chunks").collect()] == ["hi"]
    finally:
        query.stop()


@pytest.fixture(scope="module")
def diamond(spark):
    nodes = make_nodes(spark, [("r", "endpoint", "POST /x"), ("a", "method", 'say "hi"'), ("b", "method", "B"), ("c", "type", "C")])
    edges = make_edges(spark, [("r", "a", "calls"), ("r", "b", "instantiates"), ("a", "c", "calls"), ("b", "c", "calls"), ("r", "a", "calls"), ("c", "gone", "calls")])
    return nodes, edges


def test_flow_renderings(diamond):
    nodes, edges = diamond
    levels = paths.flow_levels(edges, "r")
    assert list(render.printed(render.flow_lines(levels, nodes), "root", "place")) == [
        "POST /x",
        '├─► say "hi"',
        "│    └─► C",
        "│         └─► gone",
        "└─► [instantiates] B",
        "     └─► C",
        "          └─► gone",
    ]
    assert list(render.printed(render.mermaid_lines(levels, nodes), "root", "place", "pos", "part")) == [
        "flowchart TD",
        '    n_r["POST /x"]',
        '    n_a["say \\"hi\\""]',
        "    n_r -->|calls| n_a",
        '    n_c["C"]',
        "    n_a -->|calls| n_c",
        '    n_gone["gone"]',
        "    n_c -->|calls| n_gone",
        '    n_b["B"]',
        "    n_r -->|instantiates| n_b",
        "    n_b -->|calls| n_c",
    ]


def test_flow_tree_of_many_roots_and_parallel_edges(spark):
    """Against a plain recursion: alike prefixes are one branch, whatever edges they run over."""
    import random

    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(7)}", f"n{rng.randrange(7)}", rng.choice(["calls", "creates"])) for _ in range(26)]
    edges, nodes = make_edges(spark, pairs), make_nodes(spark, [(f"n{i}", "type", f"N{i}") for i in range(6)])
    levels = paths.flow_levels(edges, ["n1", "n4", "alone"], 4)

    def drawn(node, trail, stem):
        kids = []
        for to, kind in ((b, k) for a, b, k in pairs if a == node and b not in trail):
            kids += [] if (to, kind) in kids or len(trail) > 4 else [(to, kind)]
        for i, (to, kind) in enumerate(kids):
            last = i == len(kids) - 1
            name = to.upper() if to != "n6" else to
            yield stem + ("└─► " if last else "├─► ") + ("" if kind == "calls" else f"[{kind}] ") + name
            yield from drawn(to, [*trail, to], stem + ("     " if last else "│    "))

    want = ["alone"]
    for root in ("n1", "n4"):
        want += [root.upper(), *drawn(root, [root], "")]
    assert list(render.printed(render.flow_lines(levels, nodes), "root", "place")) == want
    chart = list(render.printed(render.mermaid_lines(levels, nodes).filter("root = 'n1'"), "place", "pos", "part"))
    steps = paths.path_steps(levels.maximal().filter("root = 'n1'"), nodes).orderBy("path_key", "pos").select("path_key", "pos", "id", "via").collect()
    seen, prev = ["flowchart TD"], None
    for s in steps:
        name = s["id"].upper() if s["id"] != "n6" else "n6"
        seen.append(f'    n_{s["id"]}["{name}"]')
        if s["pos"] and not any(x.startswith(f"    n_{prev} -->") and x.endswith(f" n_{s['id']}") for x in seen):
            seen.append(f"    n_{prev} -->|{s['via']}| n_{s['id']}")
        prev = s["id"]
    assert chart == list(dict.fromkeys(seen))


def test_reachable_lines(diamond):
    nodes, edges = diamond
    lines = render.reachable_lines(traverse.dependencies(nodes, edges, "r"))
    assert list(render.printed(lines, "root", "distance", "pos", "id")) == [
        "depth 1:",
        '  - say "hi" (method) via calls []',
        "  - B (method) via instantiates []",
        "depth 2:",
        "  - C (type) via calls []",
        "depth 3:",
        "  - gone () via calls []",
    ]


def test_context_text(diamond):
    nodes, edges = diamond
    context = ask.context_text(ask.context_lines(*traverse.expand_subgraph(nodes, edges, ["b"], 1)))
    assert context == "\n".join(
        ["NODES:", "- [method] B () :: B", "- [type] C () :: C", "- [endpoint] POST /x () :: POST /x", "", "EDGES:", "- b --calls--> c", "- r --instantiates--> b", ""]
    )


def test_provider_config():
    assert ask.provider_config({"OPENAI_API_KEY": "k", "OLLAMA_HOST": "h"}).provider == "openai"
    assert ask.provider_config({"WEFTGRAPH_PROVIDER": " Ollama "}).host == "http://localhost:11434"
    with pytest.raises(LookupError, match="ANTHROPIC_API_KEY"):
        ask.provider_config({"WEFTGRAPH_PROVIDER": "anthropic"})
    with pytest.raises(LookupError):
        ask.provider_config({})


def test_json_items_are_indented(capsys):
    from weftgraph.__main__ import _print_array

    _print_array(['{"a":"é","b":{"c":1,"d":[]}}', "2"], "  ")
    _print_array([])
    assert capsys.readouterr().out == '  [\n    {\n      "a": "é",\n      "b": {\n        "c": 1,\n        "d": []\n      }\n    },\n    2\n  ][]'
