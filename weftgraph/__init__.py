"""Code-graph analytics on Spark."""

from weftgraph.graph import CodeGraph, analyze, analyze_and_save

__all__ = ["CodeGraph", "analyze", "analyze_and_save"]
