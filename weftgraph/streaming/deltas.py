"""Token streams of language-model providers as line tables.

A stream is a table of lines (stream_id, line_no, line).  The functions are
projections and filters, so they serve a batch read and ``readStream.text``
alike; only ``until_done`` and ``full_text``, which need a stream's end, are for
complete streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DONE = "[DONE]"
_TRIM = r"^\s+|\s+$"


def sse_data(lines: DataFrame) -> DataFrame:
    """Payloads of the ``data:`` lines of a server-sent-event stream, blank ones dropped."""
    payload = F.regexp_replace(F.substring("line", 6, 2**31 - 1), _TRIM, "")
    return (
        lines.filter(F.startswith(F.col("line"), F.lit("data:")))
        .withColumn("data", payload)
        .filter("data <> ''")
        .drop("line")
    )


def until_done(payloads: DataFrame) -> DataFrame:
    """Drop everything from the first end marker of each stream on."""
    ends = payloads.filter(F.col("data") == DONE).groupBy("stream_id").agg(F.min("line_no").alias("_end"))
    return payloads.join(ends, "stream_id", "left").filter("_end IS NULL OR line_no < _end").drop("_end")


def content_block_deltas(payloads: DataFrame) -> DataFrame:
    """Text of ``content_block_delta`` events; malformed and other events are skipped."""
    event = F.from_json("data", "type string, delta struct<type: string, text: string>")
    rows = payloads.withColumn("_e", event)
    rows = rows.filter("_e.type = 'content_block_delta' AND _e.delta.type = 'text_delta'")
    return rows.withColumn("chunk", F.coalesce("_e.delta.text", F.lit(""))).drop("_e", "data")


def choice_deltas(payloads: DataFrame) -> DataFrame:
    """Non-empty text of the first choice of chat-completion chunks."""
    event = F.from_json("data", "choices array<struct<delta: struct<content: string>>>")
    rows = payloads.withColumn("chunk", F.get(event["choices"], 0)["delta"]["content"])
    return rows.filter("chunk <> ''").drop("data")


def ndjson_deltas(lines: DataFrame) -> DataFrame:
    """Text and error of newline-delimited chat chunks; lines that are no JSON are skipped."""
    event = F.from_json("line", "message struct<content: string>, error string")
    rows = lines.filter("line <> ''").withColumn("_e", event)
    rows = rows.withColumn("chunk", F.coalesce("_e.message.content", F.lit("")))
    rows = rows.withColumn("error", F.coalesce("_e.error", F.lit("")))
    return rows.filter("chunk <> '' OR error <> ''").drop("_e", "line")


def full_text(chunks: DataFrame) -> DataFrame:
    """The whole answer of each stream: one model reply, bounded by its output limit."""
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "chunk")))
    return chunks.groupBy("stream_id").agg(
        F.array_join(F.transform(ordered, lambda c: c["chunk"]), "").alias("text")
    )
