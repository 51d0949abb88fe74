"""Command line: python -m weftgraph analyze|impact|dependencies|coupling|flow|ask ..."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import ask
from weftgraph.extract.analyze import LANGUAGES, by_extension
from weftgraph.functions import render, text
from weftgraph.graph import CodeGraph, analyze_and_save, flow_document
from weftgraph.operators import paths
from weftgraph.operators.search import AmbiguousSymbol, SymbolNotFound
from weftgraph.schema import NODE_COLUMNS
from weftgraph.sources.source_tree import list_sources, open_local
from weftgraph.sources.store import GraphNotFound, GraphStore


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="weftgraph")
    parser.add_argument("--warehouse", default=os.environ.get("WEFTGRAPH_HOME", os.path.expanduser("~/.weftgraph")))
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("analyze").add_argument("path")

    def query(name: str, *positional: str, as_json: bool = True) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for p in positional:
            sub.add_argument(p)
        sub.add_argument("--repo", default="")
        if as_json:
            sub.add_argument("--json", action="store_true")
        return sub

    query("impact", "symbol").add_argument("--depth", type=int, default=0)
    query("dependencies", "symbol").add_argument("--depth", type=int, default=0)
    query("coupling").add_argument("--top", type=int, default=10)
    flow = query("flow", "symbol")
    flow.add_argument("--depth", type=int, default=paths.DEFAULT_DEPTH)
    flow.add_argument("--mermaid", action="store_true")
    asking = query("ask", "question", as_json=False)
    asking.add_argument("--root", default="")
    asking.add_argument("--stream", action="store_true")
    asking.add_argument("--provider", help="module:attribute of a provider object; without one the prompt is printed")
    return parser


def json_rows(rows: DataFrame, *order: F.Column) -> Iterable[str]:
    """Rows as JSON objects, fetched one partition at a time."""
    ordered = rows.select(F.to_json(F.struct(*rows.columns)).alias("j"), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    for row in ordered.orderBy(*[f"_o{i}" for i in range(len(order))]).select("j").toLocalIterator():
        yield row["j"]


def _print_array(items: Iterable[str], indent: str = "") -> None:
    """A JSON array, indented by two blanks a level and written item by item."""
    print(indent + "[", end="")
    first = True
    for item in items:
        item = json.dumps(json.loads(item), ensure_ascii=False, indent=2).replace("\n", "\n" + indent + "  ")
        print(("\n" if first else ",\n") + indent + "  " + item, end="")
        first = False
    print("]" if first else "\n" + indent + "]", end="")


def _node() -> F.Column:
    """A node for JSON; an empty signature or comment is left out."""
    optional = ("signature", "doc_comment")
    return F.struct(*[F.nullif(c, F.lit("")).alias(c) if c in optional else F.col(c) for c in NODE_COLUMNS]).alias("node")


def _stub() -> F.Column:
    """What stands for an id that is no node."""
    values = {"id": F.col("id"), "name": F.col("id"), "start_line": F.lit(0), "end_line": F.lit(0)}
    empty = {"signature": F.lit(None).cast("string"), "doc_comment": F.lit(None).cast("string")}
    return F.struct(*[{**values, **empty}.get(c, F.lit("")).alias(c) for c in NODE_COLUMNS])


def _reach(args, graph: CodeGraph) -> None:
    forward = args.command == "dependencies"
    root = graph.find(args.symbol)
    hits = (graph.dependencies_of if forward else graph.impact_of)(root, args.depth)
    if args.json:
        rows = hits.select(_node(), "distance", "via")
        print('{\n  "root": ' + _quoted(root) + ',\n  "impacted":', end=" ")
        _print_array(json_rows(rows, F.col("distance"), F.col("node.id")), "  ")
        print("\n}")
        return
    lines = render.printed(render.reachable_lines(hits), "distance", "pos", "id")
    first = next(lines, None)
    if first is None:
        print(render.NO_DEPENDENCIES if forward else render.NOTHING_DEPENDS)
        return
    print(("Dependencies of" if forward else "Impact analysis for") + f" {root}:\n\n{first}")
    for line in lines:
        print(line)


def _quoted(value: str) -> str:
    return json.dumps(value, ensure_ascii=False)


def _coupling(args, graph: CodeGraph) -> None:
    scores = graph.coupling(args.top)
    if args.json:
        _print_array(json_rows(scores.select(_node(), "fan_in", "fan_out", "total"), -F.col("total"), F.col("node.id")))
        print()
        return
    cells = [F.col(c) for c in ("kind", "fan_in", "fan_out", "total")]
    lines = scores.select("total", "id", text.coupling_line(text.display_name(), *cells).alias("line"))
    shown = lines.orderBy(F.desc("total"), "id").select("line").toLocalIterator()
    first = next(shown, None)
    if first is None:
        print("(no coupling data — the graph has no calls or imports)")
        return
    print(text.coupling_header())
    print(first["line"])
    for row in shown:
        print(row["line"])


def _flow(args, graph: CodeGraph) -> None:
    root = graph.find(args.symbol)
    steps, tree, chart = flow_document(graph, root, args.depth)
    if args.json:
        nodes = graph.nodes.select(F.col("id"), _node())
        step = steps.select("path_key", "pos", "via", "id").join(nodes, "id", "left")
        node = F.coalesce("node", _stub())
        listed = step.groupBy("path_key").agg(F.sort_array(F.collect_list(F.struct("pos", node.alias("node"), "via"))).alias("s"))
        rows = listed.select(F.transform("s", lambda s: F.struct(s["node"].alias("node"), s["via"].alias("via"))).alias("steps"), "path_key")
        print('{\n  "root": ' + _quoted(root) + ',\n  "paths":', end=" ")
        ordered = rows.orderBy("path_key").select(F.to_json("steps").alias("j")).toLocalIterator()
        _print_array((r["j"] for r in ordered), "  ")
        ascii_text = "".join(line + "\n" for line in render.printed(tree, "place"))
        mermaid = "".join(line + "\n" for line in render.printed(chart, "place", "pos", "part"))
        print(f',\n  "ascii": {_quoted(ascii_text)},\n  "mermaid": {_quoted(mermaid)}\n}}')
        return
    for line in render.printed(tree, "place"):
        print(line)
    print()
    if args.mermaid:
        print("\n```mermaid")
        for line in render.printed(chart, "place", "pos", "part"):
            print(line)
        print("```")


def _ask(args, graph: CodeGraph) -> None:
    if not args.provider:
        context = graph.ask_context(args.question, args.root)
        print(ask.NO_MATCH if context is None else ask.Request(args.question, context).prompt)
        return
    module, _, attribute = args.provider.partition(":")
    provider = getattr(importlib.import_module(module), attribute)
    if args.stream:
        answer = graph.ask_stream(args.question, provider, lambda chunk: print(chunk, end="", flush=True), args.root)
    else:
        answer = graph.ask(args.question, provider, args.root)
    if answer is None:
        print(ask.NO_MATCH)
    elif not args.stream:
        print(answer.explanation)
        if answer.mermaid:
            print(f"\n```mermaid\n{answer.mermaid}\n```")
        if answer.ascii:
            print("\n" + answer.ascii)


def _analyze(args, spark: SparkSession, store: GraphStore) -> None:
    open_local(args.path)
    print(f"Found {list_sources(spark, args.path, by_extension(LANGUAGES)).count()} source files")
    graph, analysis = analyze_and_save(spark, args.path, store)
    commit = store.get_meta(args.path, "commit")
    print(f"→ Analyzed {args.path}" + (f" (commit {commit[:8]})" if commit else ""))
    for row in analysis.errors.toLocalIterator():
        print(f"  skip {row['path']}: {row['error']}", file=sys.stderr)
    for row in analysis.language_counts().orderBy("language").collect():
        print(f"  {row['language']}: {row['n_files']} files")
    print(f"  {graph.nodes.count()} nodes, {graph.edges.count()} edges")


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("weftgraph").getOrCreate()
    store = GraphStore(spark, args.warehouse)
    try:
        if args.command == "analyze":
            _analyze(args, spark, store)
        else:
            graph = CodeGraph.load(store, args.repo)
            {"impact": _reach, "dependencies": _reach, "coupling": _coupling, "flow": _flow, "ask": _ask}[args.command](args, graph)
    except (GraphNotFound, SymbolNotFound, AmbiguousSymbol, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
