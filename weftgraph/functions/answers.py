"""Prompts for a language model and the parts of its answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = r"(?s)```mermaid\s*(.*?)```"
_BLANK = r"^\s+|\s+$"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, _BLANK, "")


def _after(text: Column, marker: str) -> Column:
    """What follows the first ``marker``, without leading colons, newlines and blanks."""
    at = F.instr(text, marker)
    tail = F.substring(text, at + len(marker), F.length(text))
    return F.when(at > 0, F.regexp_replace(tail, r"^[:\n ]+", ""))


def structured_answer(raw: Column) -> Column:
    """Struct of explanation, mermaid and ascii; an unmarked answer is all explanation."""
    mermaid = _strip(F.regexp_extract(raw, _FENCE, 1))
    told = F.coalesce(_after(raw, "EXPLANATION"), raw)
    told = F.when(F.contains(told, F.lit("MERMAID")), F.substring_index(told, "MERMAID", 1)).otherwise(
        F.substring_index(told, "```mermaid", 1)
    )
    told = _strip(told)
    drawn = _strip(F.coalesce(_after(raw, "ASCII"), F.lit("")))
    drawn = _strip(F.regexp_replace(drawn, r"^```", ""))
    drawn = _strip(F.regexp_replace(drawn, r"```$", ""))
    return F.struct(
        F.when(told == "", _strip(raw)).otherwise(told).alias("explanation"),
        mermaid.alias("mermaid"),
        drawn.alias("ascii"),
    )


def mermaid_parts(raw: Column) -> Column:
    """Array of (type, content): the text around each closed mermaid fence, and its body.

    Splitting on whole fences leaves the texts between them; an unclosed fence
    stays part of the last text.
    """
    fence = r"(?s)```mermaid\n(.*?)```"
    bodies = F.regexp_extract_all(raw, F.lit(fence), F.lit(1))
    texts = F.split(raw, fence, -1)
    pairs = F.transform(
        texts,
        lambda text, i: F.array(
            F.struct(F.lit("md").alias("type"), text.alias("content")),
            F.struct(F.lit("mermaid").alias("type"), F.get(bodies, i).alias("content")),
        ),
    )
    return F.filter(F.flatten(pairs), lambda p: p["content"].isNotNull())


def user_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("QUESTION: "), question, F.lit("\n\nSUBGRAPH:\n"), context)


def node_line() -> Column:
    """A node as one line of prompt context."""
    shown = F.coalesce(F.nullif(F.col("signature"), F.lit("")), F.col("name"))
    return F.concat(F.lit("- ["), "kind", F.lit("] "), "name", F.lit(" ("), "file", F.lit(") :: "), shown)


def edge_line() -> Column:
    return F.concat(F.lit("- "), "from_id", F.lit(" --"), "kind", F.lit("--> "), "to_id")
