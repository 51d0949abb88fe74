"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a text with up to ``RATE`` of its characters edited.
With a budget of k edits the item is cut into k + 1 pieces: any occurrence
within the budget leaves one piece untouched.  An Aho-Corasick automaton finds
all exact piece hits in one pass over a text.  A hit is verified with Myers'
bit-parallel distance, from small to large: of the two halves of an occurrence
one keeps within its own share of the budget, so the pair of pieces around a
hit is tested first, then four, then eight, up to the whole item.  This drops
chance hits after a few characters and loses none.

Letters are compared in lower case and white space as single blanks.  An item
of fewer than ``SHORT`` characters has no room for edits: it is one piece, and
counts where it stands on word edges.

Items reach the executors in slices of at most ``SLICE`` characters, one pass
over the documents per slice, so what is broadcast is bounded whatever the
number of items.  Documents are never shuffled for the search.

Defined cases: null, empty and blank texts and items match nothing; an item that
occurs several times counts with its least distance; repeated rows give
repeated results; empty tables give an empty result.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import row_key, without
from weftgraph.session import materialize

#: Edits allowed, as a fraction of an item's characters.
RATE = 0.1
#: Items below this length are found exactly, on word edges.
SHORT = 25
#: Characters of items in one pass, and of items whose bit masks a worker holds at once.
SLICE, HELD = 2_000_000, 2_000_000
_SCHEMA = "doc_id bigint, k_id bigint, k_hash bigint, item_id bigint, distance int, item_chars int"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def least_distance(masks: dict[str, int], m: int, text: str, limit: int) -> int:
    """Least edit distance of a pattern of ``m`` characters to any part of ``text`` (Myers); ends early at 0."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    return 0
        ph = (ph << 1) & full
        pv = ((mh << 1) & full) | (full & ~(xv | ph))
        mv = ph & xv
    return best


class Items:
    """An automaton over the pieces of many items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, self.masks, self.held = items, {}, 0
        self.cuts: list[list[int]] = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for at, (_, text) in enumerate(items):
            k = int(len(text) * rate) if len(text) >= SHORT else 0
            cut = [len(text) * i // (k + 1) for i in range(k + 2)]
            self.cuts.append(cut)
            for i in range(k + 1):
                pieces.setdefault(text[cut[i] : cut[i + 1]], []).append((at, i))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def _masks(self, at: int, lo: int, hi: int) -> tuple[dict[str, int], int]:
        got = self.masks.get((at, lo, hi))
        if got is None:
            part = self.items[at][1][self.cuts[at][lo] : self.cuts[at][hi]]
            masks: dict[str, int] = {}
            for i, c in enumerate(part):
                masks[c] = masks.get(c, 0) | 1 << i
            self.held += len(part)
            if self.held > HELD:  # they are made again when needed
                self.masks, self.held = {}, len(part)
            got = self.masks[at, lo, hi] = (masks, len(part))
        return got

    def _around(self, text: str, end: int, size: int, at: int, piece: int) -> int | None:
        """Distance of the occurrence that a hit belongs to, or None if it is beyond the budget."""
        cut, n, width, distance = self.cuts[at], len(self.cuts[at]) - 1, 1, 0
        zero = end + 1 - size - cut[piece]  # where the item would begin without shifts
        while width < n:
            width *= 2
            lo = piece // width * width
            hi = min(lo + width, n)
            budget = hi - lo - 1
            masks, m = self._masks(at, lo, hi)
            window = text[max(0, zero + cut[lo] - budget) : zero + cut[hi] + budget]
            distance = least_distance(masks, m, window, budget)
            if distance > budget:
                return None
        return distance

    def _stands_alone(self, text: str, start: int, end: int) -> bool:
        """Whether a short item at this place begins and ends on word edges; longer ones may begin anywhere."""
        if end - start >= SHORT:
            return True
        before, after = text[start - 1 : start] if start else "", text[end : end + 1]
        return not (before.isalnum() and text[start].isalnum()) and not (after.isalnum() and text[end - 1].isalnum())

    def search(self, text: str) -> dict[int, int]:
        """item place -> least distance in ``text``."""
        found: dict[int, int] = {}
        if not len(self.automaton):
            return found
        for end, (size, where) in self.automaton.iter(text):
            for at, piece in where:
                if len(self.cuts[at]) == 2 and not self._stands_alone(text, end + 1 - size, end + 1):
                    continue
                if found.get(at, 1):
                    d = self._around(text, end, size, at, piece)
                    if d is not None and d < found.get(at, d + 1):
                        found[at] = d
        return found


_ready: dict[str, Items] = {}


def _slices(items: DataFrame) -> list[list[tuple[int, str]]]:
    """Items in bounded slices, from the driver's iterator: one slice after the other."""
    rows = items.select(F.col("item_id").cast("bigint"), "text").where("text is not null and item_id is not null").distinct()
    out, size = [[]], 0
    for item_id, text in rows.orderBy("item_id", "text").toLocalIterator():
        text = normal(text)
        if not text:
            continue
        if size + len(text) > SLICE:
            yield out.pop()
            out, size = [[]], 0
        out[-1].append((item_id, text))
        size += len(text)
    yield out.pop()


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, row key, item_id, distance, item_chars) of every document and item that occurs in it."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *row_key(docs), "text").where(F.col("text").isNotNull())
    rows = rows.withColumn("k_id", F.col("k_id").cast("bigint"))
    found = None
    for part in _slices(items):
        shared = spark.sparkContext.broadcast(part)

        def run(batches, shared=shared, name=f"{id(shared)}-{rate}"):
            if name not in _ready:
                _ready.clear()
                _ready[name] = Items(shared.value, rate)
            known = _ready[name]
            for b in batches:
                out = []
                for d, i, h, text in zip(*(b.column(c).to_pylist() for c in range(4))):
                    out += [(d, i, h, known.items[at][0], dist, len(known.items[at][1])) for at, dist in known.search(normal(text)).items()]
                columns = list(zip(*out)) or [[]] * 6
                kinds = [pa.int64()] * 4 + [pa.int32()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _SCHEMA.split(", ")])

        new = materialize(rows.mapInArrow(run, _SCHEMA), "leaks")
        found = new if found is None else found.unionByName(new)
        shared.unpersist()
    return found


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    return without(docs, matches(docs, items, rate).select("k_id", "k_hash").distinct())
