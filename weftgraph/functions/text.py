"""Scalar string functions of the engine, all as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_name(prefix: str = "") -> Column:
    """The qualified name, or the name where that is empty."""
    return F.coalesce(F.nullif(F.col(f"{prefix}qualified"), F.lit("")), F.col(f"{prefix}name"))


def symbol_label(node_id: Column) -> Column:
    """Last ``::`` segment of an id."""
    return F.element_at(F.split(node_id, "::"), -1)


def impact_label(distance: Column, name: Column) -> Column:
    return F.concat(F.repeat(F.lit("  "), distance - 1), F.lit("↳ "), name)


def mermaid_id(node_id: Column) -> Column:
    return F.concat(F.lit("n_"), F.translate(node_id, ":./ -", "_____"))


def edge_label(via: Column, name: Column) -> Column:
    """The name, prefixed with the relation unless that is a call."""
    return F.when(via.isin("", "calls"), name).otherwise(F.concat(F.lit("["), via, F.lit("] "), name))


def quoted(text: Column) -> Column:
    """A double-quoted literal with backslash escapes for what does not print: all but letters, marks, numbers, punctuation, symbols and blanks."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    # The control characters that have a letter escape.
    letters = {"\a": "a", "\b": "b", "\f": "f", "\n": "n", "\r": "r", "\t": "t", "\v": "v"}
    for char, letter in letters.items():
        escaped = F.replace(escaped, F.lit(char), F.lit("\\" + letter))
    for code in [*range(0x20), 0x7F]:
        if chr(code) not in letters:
            escaped = F.replace(escaped, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    hidden = r"[^\p{L}\p{M}\p{N}\p{P}\p{S} ]"

    def shown(c: Column) -> Column:
        code = F.ascii(c)
        by_code = F.when(code < 0x10000, F.format_string(r"\u%04x", code)).otherwise(F.format_string(r"\U%08x", code))
        return F.when(F.rlike(c, F.lit(hidden)), by_code).otherwise(c)

    each = F.array_join(F.transform(F.regexp_extract_all(escaped, F.lit("(?s)."), F.lit(0)), shown), "")
    return F.concat(F.lit('"'), F.when(F.rlike(escaped, F.lit(hidden)), each).otherwise(escaped), F.lit('"'))


def first_bytes(text: Column, size: int) -> Column:
    """The first ``size`` bytes; a character cut in two is left out."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, size)
    whole = F.octet_length(text) <= size
    # Decoding a split character gives replacement marks at the end only.
    partial = F.regexp_replace(F.decode(cut, "UTF-8"), "�+$", "")
    return F.when(whole, text).otherwise(partial)


def truncated(text: Column, size: int) -> Column:
    """At most ``size`` bytes; a longer text ends in an ellipsis."""
    return F.when(F.octet_length(text) <= size, text).otherwise(F.concat(first_bytes(text, size - 1), F.lit("…")))


def signature(text: Column, stop: str, cap: int | None = None) -> Column:
    """The text before the first ``stop`` with runs of whitespace as one blank."""
    line = F.trim(F.regexp_replace(F.substring_index(text, stop, 1), r"\s+", " "))
    return first_bytes(line, cap) if cap else line


def repo_slug(target: Column) -> Column:
    return F.substring(F.sha1(target), 1, 12)


def commit_suffix(commit: Column) -> Column:
    return F.when(commit == "", F.lit("")).otherwise(F.concat(F.lit(" (commit "), F.substring(commit, 1, 8), F.lit(")")))


def coupling_line(name: Column, kind: Column, fan_in: Column, fan_out: Column, total: Column) -> Column:
    """One fixed-width row of the coupling table."""
    return F.format_string("%-40s %-10s %8d %8d %8d", truncated(name, 40), kind, fan_in, fan_out, total)


def coupling_header() -> str:
    return "%-40s %-10s %8s %8s %8s" % ("SYMBOL", "KIND", "FAN-IN", "FAN-OUT", "TOTAL")


def normalized_type(text: Column) -> Column:
    """A declared type without generic arguments, one ``?`` and one ``[]``."""
    bare = F.substring_index(F.trim(text), "<", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\?$", ""), r"\[\]$", ""))
