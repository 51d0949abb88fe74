"""Questions about a graph, answered by a language model of the caller's choice.

The engine selects the relevant neighbourhood and writes the prompt; the model
is any object that meets ``Provider``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import answers, render
from weftgraph.functions.answers import structured_answer

# The headings that structured_answer() looks for.
HEADINGS = ("EXPLANATION", "MERMAID", "ASCII")

SYSTEM_PROMPT = """A reader asks about source code. Below the question stand lines of a table: nodes as
"- [kind] name (file) :: signature" and edges as "- source --kind--> target". They are all you know.

Reply in numbered parts:
"""
SYSTEM_PROMPT += "\n".join(
    f"{i}. {heading}: {what}"
    for i, (heading, what) in enumerate(
        zip(HEADINGS, ("prose that answers the question.", "one fenced mermaid block drawn from the edges.", "one fenced block with those edges as indented text.")),
        1,
    )
)

NO_MATCH = "No symbol of the graph matches that question. Name a function, class or endpoint."


@dataclass(frozen=True)
class Request:
    question: str
    context: str

    @property
    def prompt(self) -> str:
        return f"QUESTION: {self.question}\n\nSUBGRAPH:\n{self.context}"


@dataclass(frozen=True)
class Answer:
    explanation: str
    mermaid: str
    ascii: str


class Provider(Protocol):
    def name(self) -> str: ...

    def ask(self, request: Request) -> str:
        """The whole raw answer."""

    def ask_stream(self, request: Request, on_chunk: Callable[[str], None]) -> str:
        """The same, handing each piece of text to ``on_chunk`` as it arrives."""


@dataclass(frozen=True)
class ProviderConfig:
    provider: str
    api_key: str = ""
    model: str = ""
    host: str = ""


def provider_config(env: Mapping[str, str]) -> ProviderConfig:
    """Settings from the environment: the named provider, else the first with a key."""
    chosen = env.get("WEFTGRAPH_PROVIDER", "").strip().lower()
    keys = {"anthropic": "ANTHROPIC_API_KEY", "openai": "OPENAI_API_KEY", "ollama": "OLLAMA_HOST"}
    if not chosen:
        chosen = next((name for name, key in keys.items() if env.get(key)), "")
    if chosen not in keys:
        raise LookupError(f"no model provider configured: set WEFTGRAPH_PROVIDER or one of {', '.join(keys.values())}")
    value, model = env.get(keys[chosen], ""), env.get("WEFTGRAPH_MODEL", "")
    if chosen == "ollama":
        return ProviderConfig(chosen, model=model, host=value or "http://localhost:11434")
    if not value:
        raise LookupError(f"provider {chosen} needs {keys[chosen]}")
    return ProviderConfig(chosen, api_key=value, model=model)


def context_lines(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, place, id, line): the neighbourhood as prompt text, nodes by id, edges as met."""
    place_type = edges.schema["place"].dataType
    heads = members.sparkSession.createDataFrame([(0, "NODES:"), (2, ""), (3, "EDGES:")], "section int, line string")
    no_place = F.lit(None).cast(place_type).alias("place")
    titles = heads.select("section", no_place, F.lit("").alias("id"), "line")
    node_rows = members.select(F.lit(1).alias("section"), no_place, "id", answers.node_line().alias("line"))
    edge_rows = edges.select(F.lit(4).alias("section"), "place", F.lit("").alias("id"), answers.edge_line().alias("line"))
    return titles.unionByName(node_rows).unionByName(edge_rows)


def context_text(lines: DataFrame) -> str:
    """The prompt text; a request to a model is one string by nature."""
    return "".join(line + "\n" for line in render.printed(lines, "section", "place", "id"))


def parsed(spark: SparkSession, raw: str) -> Answer:
    row = spark.createDataFrame([(raw,)], "raw string").select(structured_answer(F.col("raw")).alias("a")).first()["a"]
    return Answer(row["explanation"], row["mermaid"], row["ascii"])
