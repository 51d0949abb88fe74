"""The public face of the engine: analyse a code base, ask its graph."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import ask
from weftgraph.extract.analyze import LANGUAGES, Analysis, Language, analyze_files, by_extension
from weftgraph.functions import render
from weftgraph.operators import coupling, lenses, paths, search, traverse
from weftgraph.sources.source_tree import list_sources, open_local, read_sources
from weftgraph.sources.store import GraphStore


class CodeGraph:
    """Nodes and edges with the queries over them; every result is a DataFrame."""

    def __init__(
        self,
        nodes: DataFrame,
        edges: DataFrame,
        edges_by_target: DataFrame | None = None,
        indexes: tuple[list[DataFrame] | None, list[DataFrame] | None] = (None, None),
    ):
        self.nodes, self.edges = nodes, edges
        # Stored indexes by start and by target; without them a traversal makes its own.
        self.forward, self.backward = indexes
        # The same edges, stored in the order that suits backward searches.
        self.edges_by_target = edges if edges_by_target is None else edges_by_target

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @classmethod
    def load(cls, store: GraphStore, target: str = "") -> CodeGraph:
        target = store.resolve_target(target)
        return cls(*store.load(target), store.indexes(target))

    def find(self, symbol: str) -> str:
        return search.find_symbol(self.nodes, symbol)

    def impact(self, symbol: str, depth: int = 0) -> DataFrame:
        return self.impact_of(self.find(symbol), depth)

    def dependencies(self, symbol: str, depth: int = 0) -> DataFrame:
        return self.dependencies_of(self.find(symbol), depth)

    def impact_of(self, roots: str | Iterable[str] | DataFrame, depth: int = 0) -> DataFrame:
        """Impact of known ids, any number at once."""
        return traverse.impact(self.nodes, self.edges_by_target, roots, depth, self.backward)

    def dependencies_of(self, roots: str | Iterable[str] | DataFrame, depth: int = 0) -> DataFrame:
        return traverse.dependencies(self.nodes, self.edges, roots, depth, self.forward)

    def coupling(self, top: int = 10) -> DataFrame:
        return coupling.top_coupled(self.nodes, self.edges, top)

    def line_entries(self) -> DataFrame:
        return lenses.line_entries(self.coupling(top=0))

    def flow(self, symbol: str, depth: int = paths.DEFAULT_DEPTH) -> DataFrame:
        return self.flow_of(self.find(symbol), depth)

    def flow_of(self, roots: str | Iterable[str] | DataFrame, depth: int = paths.DEFAULT_DEPTH) -> DataFrame:
        return paths.flow_paths(self.edges, roots, depth)

    def flow_steps(self, flow: DataFrame) -> DataFrame:
        return paths.path_steps(flow, self.nodes)

    def endpoints_reaching(self, matcher: Column | Callable[[DataFrame], DataFrame], depth: int = 0) -> DataFrame:
        return traverse.endpoints_reaching(self.nodes, self.edges_by_target, matcher, depth, self.backward)

    def expand(self, seeds: Iterable[str] | DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
        return traverse.expand_subgraph(self.nodes, self.edges, seeds, depth, self.edges_by_target, self.forward, self.backward)

    def seeds(self, question: str, root: str | None = None) -> list[str]:
        """The given root, or the few best lexical matches, best first."""
        if root is not None and root != "":
            if self.nodes.filter(F.col("id") == root).isEmpty():
                raise search.SymbolNotFound(f"root {root!r} is not a symbol of this graph")
            return [root]
        return [r["id"] for r in search.lexical_match(self.nodes, question).collect()]

    def ask_context(self, question: str, root: str | None = None) -> str | None:
        """Prompt text for a question, None if nothing matches it."""
        found = self.seeds(question, root)
        if not found:
            return None
        return ask.context_text(ask.context_lines(*self.expand(found)))

    def ask(self, question: str, provider: ask.Provider, root: str | None = None) -> ask.Answer | None:
        context = self.ask_context(question, root)
        if context is None:
            return None
        return ask.parsed(self.spark, provider.ask(ask.Request(question, context)))

    def ask_stream(
        self, question: str, provider: ask.Provider, on_chunk: Callable[[str], None], root: str | None = None
    ) -> ask.Answer | None:
        context = self.ask_context(question, root)
        if context is None:
            return None
        return ask.parsed(self.spark, provider.ask_stream(ask.Request(question, context), on_chunk))


def analyze(spark: SparkSession, path: str, languages: tuple[Language, ...] = LANGUAGES) -> Analysis:
    """Read a source folder and build its graph; nothing is saved."""
    open_local(path)
    listing = list_sources(spark, path, by_extension(languages))
    return analyze_files(read_sources(listing), languages)


def analyze_and_save(
    spark: SparkSession, path: str, store: GraphStore, languages: tuple[Language, ...] = LANGUAGES
) -> tuple[CodeGraph, Analysis]:
    """Analyse a folder, save its graph with target and commit, and make it the default target."""
    commit = open_local(path)
    analysis = analyze(spark, path, languages)
    store.save(path, analysis.nodes, analysis.edges)
    store.set_meta(path, "target", path)
    store.set_meta(path, "commit", commit)
    store.set_last_target(path)
    return CodeGraph.load(store, path), analysis


def flow_document(graph: CodeGraph, root: str, depth: int = paths.DEFAULT_DEPTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three renderings of the flow of a known id: steps, tree lines and flowchart lines."""
    levels = paths.flow_levels(graph.edges, root, depth)
    return graph.flow_steps(levels.maximal()), render.flow_lines(levels, graph.nodes), render.mermaid_lines(levels, graph.nodes)
