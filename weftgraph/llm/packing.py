"""Best-fit packing of documents into sequences by linear grouping.

A document's token ids, closed by an end id, are one piece of a sequence; only
a longer document is cut, into pieces of ``capacity`` tokens and a rest.

What fits where depends on lengths alone, and lengths are whole numbers up to
``capacity``.  So the packing is planned on the histogram of lengths, which has
at most ``capacity`` rows however many documents there are:

1. Large lengths, in descending order, are cut into groups of equal
   cardinality, and every length counts as the greatest of its group.
2. A linear programme over configurations (how many of each group a sequence
   holds) is solved by column generation; its whole parts are taken.
3. Actual documents replace the rounded ones.  A group gives its pieces to the
   configurations in order of length, so sequences that hold the same lengths
   are neighbours and are planned as one run with a count.
4. What is left of the large pieces and all small ones are put, the longest
   first, into the run with the least room that still takes them; equal
   lengths fill many sequences of a run in one step, exactly as one by one.

Several thresholds and group counts are planned and the one with the fewest
sequences is kept.  The plan has a few rows per length and run, not per
document.  A piece then finds its place by its length and its rank among the
pieces of that length, without meeting others: ranks are counted per task and
length while texts are encoded and moved up by what lies in earlier tasks.

Defined cases: null text counts as empty; an empty text is the end id alone;
rows that repeat an id, and null ids, are packed row by row; very long texts
are cut as above and need memory for themselves only; equal lengths are told
apart by task and place; extra columns are ignored; an empty table has no
pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import binary_of
from weftgraph.llm.encoding import encoder, text_blocks
from weftgraph.session import materialize

CAPACITY = 4096
#: Plans that are tried: a length is large above capacity / part; number of groups.
PLANS = ((2.5, 16), (4, 24), (2.5, 96), (4, 128))

_FIELDS = ("length", "first", "last", "sequence", "each", "offset")


# --- plan ----------------------------------------------------------------------------------------


def _knapsack(worth: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most worth that fits, and how many of each size give it."""
    best, layers = np.zeros(capacity + 1), []
    use = np.flatnonzero(worth > 1e-12)
    for _ in range(capacity // int(sizes.min())):
        now, took = best.copy(), np.full(capacity + 1, -1)
        for g in use.tolist():
            s = int(sizes[g])
            other = best[: capacity + 1 - s] + worth[g]
            better = other > now[s:] + 1e-12
            now[s:][better], took[s:][better] = other[better], g
        layers.append(took)
        if not (took >= 0).any():
            break
        best = now
    counts, room = np.zeros(len(sizes), dtype=np.int64), int(np.argmax(best))
    for took in reversed(layers):
        g = took[room]
        if g >= 0:
            counts[g] += 1
            room -= int(sizes[g])
    return float(best.max()), counts


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(how many of each size, how often): whole parts of the best fractional use of configurations."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(40 * k):
        duals = np.linalg.solve(basis.T, np.ones(k))
        gain, column = _knapsack(duals, sizes, capacity)
        if gain <= 1 + 1e-7:
            break
        amounts, step = np.linalg.solve(basis, need.astype(float)), np.linalg.solve(basis, column.astype(float))
        ratio = np.where(step > 1e-9, np.maximum(amounts, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    amounts = np.floor(np.linalg.solve(basis, need.astype(float)) + 1e-7).astype(np.int64).clip(0)
    left, out = need.copy(), []
    for column, n in zip(basis.T.round().astype(np.int64), amounts.tolist()):
        n = min([n, *(left[column > 0] // column[column > 0]).tolist()])
        if n > 0:
            left = left - n * column
            out.append((column, n))
    return out


class _Plan:
    """Runs of alike sequences by the room that is left in them, and the places given away so far."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences, self.places = capacity, 0, []
        self.rooms: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def put_back(self, room: int, first: int, n: int) -> None:
        if n and room:
            if room not in self.runs:
                insort(self.rooms, room)
                self.runs[room] = []
            self.runs[room].append((first, n))

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            del self.runs[room]
            self.rooms.pop(bisect_left(self.rooms, room))
        return run

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def best_fit(self, length: int, lo: int, hi: int) -> None:
        """Place the pieces of one length with ranks from ``lo`` up to ``hi``."""
        while lo < hi:
            at = bisect_left(self.rooms, length)
            if at < len(self.rooms):
                room = self.rooms[at]
                first, n = self.take(room)
            else:
                room, n = self.capacity, -(-(hi - lo) // (self.capacity // length))
                first = self.open(n)
            each = room // length
            took = min(hi - lo, each * n)
            full, rest = divmod(took, each)
            if full:
                self.places.append((length, lo, lo + full * each, first, each, self.capacity - room))
            if rest:
                self.places.append((length, lo + full * each, lo + took, first + full, rest, self.capacity - room))
            self.put_back(room - each * length, first, full)
            self.put_back(room - rest * length, first + full, int(rest > 0))
            self.put_back(room, first + full + (rest > 0), n - full - (rest > 0))
            lo += took


def _planned(counts: np.ndarray, capacity: int, above: int, groups: int) -> _Plan:
    plan = _Plan(capacity)
    lengths = np.flatnonzero(counts)[::-1]
    large = lengths[lengths > above]
    left = {int(s): (0, int(counts[s])) for s in lengths[lengths <= above]}
    if len(large):
        # Pieces in descending order of length have places 0 .. total; a length has a stretch of them.
        upto = np.cumsum(counts[large])
        total, begins = int(upto[-1]), upto - counts[large]
        edges = np.unique(np.linspace(0, total, min(groups, total) + 1).round().astype(np.int64))
        sizes = large[np.searchsorted(upto, edges[:-1], side="right")]
        # Groups of the same greatest length are one.
        first = np.concatenate(([True], sizes[1:] != sizes[:-1]))
        starts, sizes = edges[:-1][first], sizes[first]
        ends = np.append(starts[1:], total)
        cursor = starts.copy()
        for column, n in configurations(sizes, ends - starts, capacity):
            slots = []  # (place of the first sequence's piece)
            for g, times in enumerate(column.tolist()):
                for _ in range(times):
                    slots.append(int(cursor[g]))
                    cursor[g] += n
            cuts = {0, n}
            for s in slots:
                inner = upto[(upto > s) & (upto < s + n)] - s
                cuts.update(inner.tolist())
            base, cuts = plan.open(n), sorted(cuts)
            for a, b in zip(cuts, cuts[1:]):
                used = 0
                for s in slots:
                    k = int(np.searchsorted(upto, s + a, side="right"))
                    rank = s + a - int(begins[k])
                    plan.places.append((int(large[k]), rank, rank + b - a, base + a, 1, used))
                    used += int(large[k])
                plan.put_back(capacity - used, base + a, b - a)
        rest = []
        for a, z in zip(cursor.tolist(), ends.tolist()):
            for k in range(int(np.searchsorted(upto, a, side="right")), len(large)):
                lo, hi = max(a, int(begins[k])), min(z, int(upto[k]))
                if lo >= hi:
                    break
                rest.append((int(large[k]), lo - int(begins[k]), hi - int(begins[k])))
        for length, lo, hi in sorted(rest, key=lambda r: (-r[0], r[1])):
            plan.best_fit(length, lo, hi)
    for length, (lo, hi) in left.items():  # descending
        plan.best_fit(length, lo, hi)
    return plan


def planned(counts: np.ndarray, capacity: int = CAPACITY, plans=PLANS) -> tuple[np.ndarray, int]:
    """(places, number of sequences) for ``counts[n]`` pieces of n tokens.

    A place (length, first, last, sequence, each, offset) takes the pieces of that
    length with ranks first .. last - 1, ``each`` of them to a sequence, from ``offset`` on.
    """
    least, best = -(-int((np.arange(len(counts)) * counts).sum()) // capacity), None
    for part, groups in plans:
        tried = _planned(counts, capacity, int(capacity / part), groups)
        best = tried if best is None or tried.sequences < best.sequences else best
        if best.sequences == least:  # no plan can have fewer
            break
    places = np.array(best.places, dtype=np.int64).reshape(-1, len(_FIELDS))
    return places[np.lexsort((places[:, 1], places[:, 0]))], best.sequences


# --- pieces ----------------------------------------------------------------------------------------

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece; ``nth`` is its rank among the pieces of its length in its task ``part``."""

    def run(batches):
        from pyspark import TaskContext

        codes, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for a, b in text_blocks(batch.column(1)):
                ids, at = codes.ids(batch.column(1).slice(a, b - a))
                n = np.diff(at)
                times = -(-n // capacity)
                doc = np.repeat(np.arange(b - a), times)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(times) - times, times)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                begin = at[:-1][doc] + start
                order = np.argsort(length, kind="stable")
                heads = np.flatnonzero(np.diff(length[order], prepend=-1))
                nth = np.empty(len(doc), dtype=np.int64)
                nth[order] = np.arange(len(doc)) - np.repeat(heads, np.diff(np.append(heads, len(doc)))) + seen[length[order]]
                seen += np.bincount(length, minlength=capacity + 1)
                raw = ids.astype("<u4")
                spans = list(zip(begin.tolist(), (begin + length).tolist()))
                crc = pa.array([zlib.crc32(raw[x:y].data) for x, y in spans], pa.int64())
                columns = [batch.column(0).take(pa.array(doc + a)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), crc, pa.array(np.full(len(doc), part, dtype=np.int32)), pa.array(nth)]
                names = [c.split()[0] for c in _PIECES.split(", ")]
                if keep_ids:
                    columns, names = [*columns, pa.array([raw[x:y].tobytes() for x, y in spans], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("bigint"), binary_of(F.col("text")).alias("t"))
    return rows.mapInArrow(run, _PIECES + (", ids binary" if keep_ids else ""))


def packed(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece, and its ``ids`` if kept."""
    cut = materialize(pieces(docs, tokenizer, capacity, keep_ids), "pieces")
    met = materialize(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in met.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row per length
        counts[row.length] = row.n
    places, _ = planned(counts, capacity)
    shift = 62 - int(capacity).bit_length()
    keys = (places[:, 0] << shift) + places[:, 1]
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = met.select("part", "length", F.coalesce(earlier, F.lit(0)).alias("before"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    ranked = cut.join(before, ["part", "length"]).select(*kept, (F.col("before") + F.col("nth")).alias("rank"))

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            place = places[np.searchsorted(keys, (length << shift) + rank, side="right") - 1]
            nth, each = rank - place[:, 1], place[:, 4]
            columns = [batch.column(c) for c in kept] + [pa.array(place[:, 3] + nth // each), pa.array(place[:, 5] + nth % each * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if keep_ids else "")
    return ranked.mapInArrow(run, schema + ", sequence_id bigint, offset bigint")


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and the ``ids`` (little-endian unsigned 32-bit) of every sequence of ``packed(keep_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence has at most ``capacity`` pieces
    joined = F.aggregate(parts, F.lit(b""), lambda all_ids, p: F.concat(all_ids, p["ids"]))
    return packed_pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
