"""Cheapest repair of a conversation's structure, by secondary-sorted streaming.

A conversation is right if its roles are an optional system turn and then pairs
of user and assistant, or if it is empty.  Rows are dealt by conversation and
sorted by turn; one function over Arrow batches carries the state of a dynamic
programme from row to row and from batch to batch, so a conversation may span
any number of batches.

The programme runs from the last turn to the first: the cost to finish from
each of four states (nothing yet, after system, after user, after a pair).  A
row's decision is two bits per state, the ASCII-least of the cheapest edits, so
following the decisions from the first turn on gives the least of all cheapest
edit strings.  Costs are kept against their least, which leaves few different
steps; each is worked out once per worker.

Rows of a conversation are held until its first turn is met, up to ``HELD_ROWS``
and ``HELD_BYTES``.  A larger one is not held: its decisions, one byte per row,
go to the shared scratch table in chunks, and a second stream reads them and
the rows in order of turns, holding one chunk.  Its audit string is a value of
the result and needs a byte per edit.

Rows of a turn are taken in order of role and text, so equal rows are adjacent.
Whether a role and text were met before is a window on the same partitioning.

Defined cases: null role or text is one space; a null conversation is one of
its own; null turns come first and do not count as gaps; an empty text is
blank; a text of any length is held once; a role is judged by its first
character and may be empty; repeated rows are duplicates; a conversation
without rows left has zeros, an empty audit and the hash of the empty string;
an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.session import materialize

#: Rows and bytes of one conversation that are held, and decisions in a chunk of a larger one.
HELD_ROWS, HELD_BYTES, CHUNK = 4096, 8 << 20, 1 << 16
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5

_WHITE = " \t\n\x0b\x0c\r"
#: States: nothing yet, after system, after user, after a pair.  A user or assistant turn leads to _NEXT.
_NEXT = (2, 2, 3, 2)
#: A row that is kept, by the initial of its role: system, user, assistant, other.
_KEPT = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None,) * 4)
_ROLE = ("user", "user", "assistant", "user")
_LETTERS = "DIKR"
#: Cost to finish after the last row.
_END = (0, 2 * INSERT, INSERT, 0)


# --- the programme ---------------------------------------------------------------------------------------


def _step(after: tuple, kind: int, fault: int) -> tuple[tuple, int, int]:
    """(costs before the row against their least, that least, decisions) from the costs after it."""
    extra = TRUNCATED if fault == 3 else 0
    options = []
    for q in range(4):
        at = {0: DELETE + after[q]}
        if fault not in (1, 2):
            if _KEPT[kind][q] is not None:
                at[2] = extra + after[_KEPT[kind][q]]
            at[3] = REROLE + extra + after[_NEXT[q]]
        options.append(at)
    best = [min(at.values()) for at in options]
    for _ in range(2):  # two inserts in a row lead back to the same need
        best = [min(b, INSERT + best[_NEXT[q]]) for q, b in enumerate(best)]
    decisions = 0
    for q, at in enumerate(options):
        at[1] = INSERT + best[_NEXT[q]]
        decisions |= min(letter for letter, cost in at.items() if cost == best[q]) << 2 * q
    least = min(best)
    return tuple(b - least for b in best), least, decisions


_steps: dict[tuple, tuple[tuple, int, int]] = {}


class _Reader:
    """Follows decisions from the first turn on."""

    def __init__(self, keep: bool):
        self.state, self.letters, self.hash, self.first = 0, [], hashlib.sha256(), True
        self.messages: list[tuple[str, str]] | None = [] if keep else None

    def _say(self, role: str, text: str) -> None:
        self.hash.update((("" if self.first else "\n") + f"{role}:{text}").encode())
        self.first = False
        if self.messages is not None:
            self.messages.append((role, text))

    def _insert(self) -> None:
        self.letters.append("I")
        self._say(_ROLE[self.state], "")
        self.state = _NEXT[self.state]

    def row(self, decisions: int, kind: int, role: str, text: str) -> None:
        while (letter := decisions >> 2 * self.state & 3) == 1:
            self._insert()
        self.letters.append(_LETTERS[letter])
        if letter == 2:
            self._say(role, text)
            self.state = _KEPT[kind][self.state]
        elif letter == 3:
            self._say(_ROLE[self.state], text)
            self.state = _NEXT[self.state]

    def end(self) -> tuple[str, str]:
        while self.state in (1, 2):
            self._insert()
        return "".join(self.letters), self.hash.hexdigest()


class _Conversation:
    """What is carried from row to row, from the last turn to the first."""

    def __init__(self, name: str | None):
        self.name, self.costs, self.spent = name, _END, 0
        self.faults, self.illegal, self.later = [0, 0, 0, 0], 0, None
        self.greatest = self.least = self.turn = None
        self.turns = 0
        self.decisions, self.held, self.bytes, self.giant, self.back = bytearray(), [], 0, False, 0

    def row(self, turn, role, text, kind, fault, back, size) -> None:
        if turn is not None:
            self.greatest = turn if self.greatest is None else self.greatest
            self.turns += turn != self.least
            self.least = turn
        self.faults[fault] += 1
        initial = role[:1]
        self.illegal += self.later is not None and initial + self.later not in ("su", "ua", "au")
        self.later = initial
        key = (self.costs, kind, fault)
        if key not in _steps:
            _steps[key] = _step(*key)
        self.costs, least, decisions = _steps[key]
        self.spent += least
        self.decisions.append(decisions)
        self.back = back
        if not self.giant:
            self.held.append((kind, role, text))
            self.bytes += size
            if len(self.held) > HELD_ROWS or self.bytes > HELD_BYTES:
                self.giant, self.held = True, []

    def chunk(self) -> tuple:
        out = (self.name, *[None] * 8, None, self.back, bytes(self.decisions))
        self.decisions = bytearray()
        return out

    def end(self, keep: bool) -> Iterator[tuple]:
        gaps = 0 if self.greatest is None else self.greatest - self.least + 1 - self.turns
        found = (gaps, *self.faults[1:], self.illegal, self.spent + self.costs[0])
        if self.giant:
            if self.decisions:
                yield self.chunk()
            yield (self.name, *found, None, None, None, None, None)
            return
        reader = _Reader(keep)
        for (kind, role, text), decisions in zip(reversed(self.held), reversed(self.decisions)):
            reader.row(decisions, kind, role, text)
        yield (self.name, *found, *reader.end(), reader.messages, None, None)


# --- streams ----------------------------------------------------------------------------------------------

_MESSAGES = "array<struct<role:string,text:string>>"
_STREAM = f"conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string, messages {_MESSAGES}, back bigint, decisions binary"
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows dealt by conversation and sorted from the last turn to the first, with their faults and numbers."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    bare = rows.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), "absent").repartition("conv")
    met = Window.partitionBy("conv", "absent", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    last = F.rtrim(F.col("text"), F.lit(_WHITE))
    fault = F.when(last == "", 1).when(F.col("nth") > 1, 2).when(~F.right(last, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    first = F.substring("role", 1, 1)
    kind = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    marked = bare.withColumn("nth", F.row_number().over(met)).select("*", fault.alias("fault"), kind.alias("kind"))
    order = [F.col("absent"), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), F.col("nth").desc()]
    numbered = marked.withColumn("back", F.row_number().over(Window.partitionBy("conv").orderBy(*order)).cast("bigint"))
    # The optimizer may swap the two windows, so the order is asked for; it is free if it is there.
    return numbered.sortWithinPartitions("conv", *order).select("conv", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("known"), "role", "text", "kind", "fault", "absent", "back", F.octet_length("text").alias("size"))


def _programme(rows: DataFrame, keep: bool) -> DataFrame:
    names = [c.split()[0] for c in _STREAM.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: _Conversation | None = None
        for frame in frames:
            out = []
            for conv, turn, known, role, text, kind, fault, absent, back, size in zip(*(frame[c].tolist() for c in frame.columns)):
                conv = conv if isinstance(conv, str) else None
                if now is None or now.name != conv:
                    if now is not None:
                        out.extend(now.end(keep))
                    now = _Conversation(conv)
                if not absent:
                    now.row(turn if known else None, role, text, kind, fault, back, size)
                    if now.giant and len(now.decisions) >= CHUNK:
                        out.append(now.chunk())
            if out:
                yield pd.DataFrame(out, columns=names, dtype=object)
        if now is not None:
            yield pd.DataFrame(list(now.end(keep)), columns=names, dtype=object)

    return rows.mapInPandas(run, _STREAM)


def _followed(rows: DataFrame, chunks: DataFrame, keep: bool) -> DataFrame:
    """(conv, audit, repaired_sha256) of the conversations that have ``chunks``, or their messages row by row."""
    nothing = F.lit(None)
    some = rows.where(~F.col("absent")).select("conv", "back", F.lit(1).alias("after"), "kind", "role", "text", nothing.cast("binary").alias("decisions"))
    both = some.union(chunks.select("conv", "back", F.lit(0), F.lit(0), nothing, nothing, "decisions"))
    schema = "conv string, place bigint, role string, text string" if keep else "conv string, audit string, repaired_sha256 string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, reader, decisions, at, said = None, None, b"", 0, 0

        def told(done: bool) -> list[tuple]:
            nonlocal said
            if not keep:
                return [(name, *reader.end())] if done else []
            if done:
                reader.end()
            out = [(name, said + i, *m) for i, m in enumerate(reader.messages)]
            said += len(out)
            reader.messages = []
            return out

        for frame in frames:
            out = []
            for conv, _, after, kind, role, text, data in zip(*(frame[c].tolist() for c in frame.columns)):
                conv = conv if isinstance(conv, str) else None
                if reader is None or conv != name:
                    if reader is not None:
                        out += told(True)
                    name, reader, said = conv, _Reader(keep), 0
                if after:
                    at -= 1
                    reader.row(decisions[at], kind, role, text)
                else:
                    decisions, at = data, len(data)
            if reader is not None:
                out += told(False)
            if out:
                yield pd.DataFrame(out, columns=names, dtype=object)
        if reader is not None:
            yield pd.DataFrame(told(True), columns=names, dtype=object)

    return both.repartition("conv").sortWithinPartitions("conv", F.desc("back"), "after").mapInPandas(run, schema)


def _streams(rows: DataFrame, keep: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(finished conversations, counts of giant ones, what the second stream gives for those)."""
    rows = rows if "absent" in rows.columns else rows.withColumn("absent", F.lit(False))
    rows = rows.select("conv_id", "turn", "role", "text", "absent")
    stream = materialize(_programme(_sorted(rows), keep), "conversations")
    giant = stream.where(F.col("cost").isNotNull() & F.col("audit").isNull())
    finished = stream.where(F.col("audit").isNotNull())
    if giant.isEmpty():
        return finished, giant, None
    names = giant.select(F.col("conv").alias("name"))
    again = rows.join(names, F.col("conv_id").cast("string").eqNullSafe(F.col("name")), "left_semi")
    return finished, giant, _followed(_sorted(again), stream.where(F.col("back").isNotNull()), keep)


def judged(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    ``rows`` has conv_id, turn, role, text; a row with ``absent`` true only names its conversation.
    """
    finished, giant, followed = _streams(rows, keep=False)
    kind = rows.schema["conv_id"].dataType
    out = finished.select("conv", *_COUNTS, "audit", "repaired_sha256")
    if followed is not None:
        told = followed.withColumnRenamed("conv", "name")
        large = giant.drop("audit", "repaired_sha256").join(told, F.col("conv").eqNullSafe(F.col("name")))
        out = out.union(large.select("conv", *_COUNTS, "audit", "repaired_sha256"))
    return out.select(F.col("conv").cast(kind).alias("conv_id"), *_COUNTS, "audit", "repaired_sha256")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place, role and text of the repaired conversations, row by row."""
    finished, _, followed = _streams(rows, keep=True)
    kind = rows.schema["conv_id"].dataType
    out = finished.select("conv", F.posexplode("messages").alias("place", "m")).select("conv", F.col("place").cast("bigint").alias("place"), "m.role", "m.text")
    out = out if followed is None else out.union(followed)
    return out.select(F.col("conv").cast(kind).alias("conv_id"), "place", "role", "text")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by a hash of conversation and turn; dropped rows stay as ``absent``."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(name.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.array_repeat(F.col("kind") == 0, F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("absent"))
