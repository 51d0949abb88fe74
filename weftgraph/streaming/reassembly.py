"""Network fragments of provider streams put together into lines, with state.

A stream arrives as numbered byte fragments that are cut anywhere: inside a
line, between a carriage return and its line feed, or inside a character.  One
state per stream keeps the number of the next fragment, the bytes of the line
that is still open and fragments that came early; lines are given out as soon
as they are whole.  The end marker closes a stream: what follows is dropped and
its state goes down to one flag.

The same function serves ``readStream``, where the state lives in the query's
checkpoint, and a batch table, where every stream is complete.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftgraph.streaming.deltas import DONE

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

LINES = "stream_id string, line_no bigint, line string"


def split_lines(rest: bytes, data: bytes) -> tuple[list[bytes], bytes]:
    """(whole lines, bytes of the open one); a line feed ends a line, with or without a carriage return."""
    *whole, rest = (rest + data).split(b"\n")
    return [line.removesuffix(b"\r") for line in whole], rest


def is_end(line: bytes) -> bool:
    """A data line that holds the end marker."""
    return line.startswith(b"data:") and line[5:].strip() == DONE.encode()


class Reassembler(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "next_fragment bigint, next_line bigint, rest binary, done boolean")
        self.early = handle.getMapState("early", "fragment_no bigint", "data binary, last boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fragment, line_no, rest, done = self.place.get() if self.place.exists() else (0, 0, b"", False)
        if done:
            return
        came = {r.fragment_no: (bytes(r.data or b""), bool(r.last)) for r in rows if r.fragment_no >= fragment}
        parts = []  # fragments in order, joined once
        closed = False
        while not closed:
            if fragment in came:
                data, closed = came.pop(fragment)
            elif self.early.containsKey((fragment,)):
                data, closed = self.early.getValue((fragment,))
                self.early.removeKey((fragment,))
            else:
                break
            parts.append(bytes(data))
            fragment += 1
        lines, rest = split_lines(bytes(rest), b"".join(parts))
        if closed and rest:
            lines.append(rest.removesuffix(b"\r"))
        for line in lines:
            if is_end(line):
                closed = True
                break
            yield Row(stream_id=key[0], line_no=line_no, line=line.decode("utf-8", "replace"))
            line_no += 1
        if closed:
            self.early.clear()
            self.place.update((0, 0, b"", True))
            return
        for number, (data, last) in came.items():
            self.early.updateValue((number,), (data, last))
        self.place.update((fragment, line_no, rest, False))

    def close(self) -> None:
        pass


def lines(fragments: DataFrame) -> DataFrame:
    """(stream_id, line_no, line) from ``fragments`` (stream_id, fragment_no from 0 on, data, last).

    ``last`` marks a stream's final fragment, which closes its open line; it may be
    null.  A fragment that is sent twice counts once, empty ones are allowed, and
    bytes that are no UTF-8 are replaced.
    """
    spark = fragments.sparkSession
    if spark.conf.get(_STORE, "") != _ROCKSDB:  # map states need it
        spark.conf.set(_STORE, _ROCKSDB)
    spark.streams.active  # noqa: B018 - brings up what state stores report to, which a batch query alone does not
    keyed = fragments.selectExpr("CAST(stream_id AS STRING) AS stream_id", "CAST(fragment_no AS BIGINT) AS fragment_no", "CAST(data AS BINARY) AS data", "last")
    return keyed.groupBy("stream_id").transformWithState(Reassembler(), LINES, outputMode="Append", timeMode="None")
